"""Document fingerprints: a canonical exact digest, by DataFrame functions alone.

A text's canonical form is its NFKC normal form, case folded, normalised again, with each run of white space as one
space and none at the ends. Its digest is 128 bits of xxhash64 under two seeds. Where texts share a digest, their
canonical forms are compared byte by byte: all equal ones have the digest as their fingerprint, and any other form in
the same bucket has the digest and its place among the bucket's forms. So fingerprints are equal exactly if canonical
forms are, whatever the hash does. Two fingerprints' likeness is 1 if they are equal, else 0.

Spark has no function for Unicode normal forms; `reflect`, a built-in function, calls the static methods of the ICU
library that Spark itself ships with for collations. Nothing runs in Python.

The edit needs a row's next document, so texts are dealt by id once and each row gets the beginning of the next text,
never more than a quarter of its own length. The comparison needs the texts of buckets with several members: a bitmap
of bounded size, made of the ids in question, keeps most other texts from being dealt again.

Null texts are empty. The next document is that of the next larger doc_id (the largest one's is the smallest's, with
one document its own); of several rows with that id it is the text with the smallest SHA-256. Rows of one doc_id all
have the same next one; a null doc_id's is the smallest one's, or none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import marked, saved

_NORMALIZER, _CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


Digest = Callable[[Column], Column]


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit(_NORMALIZER), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit(_CHARACTER), F.lit("foldCase"), c, F.lit(True))
    # an ASCII text is its own normal form, and lower() folds it
    return F.trim(F.when(F.octet_length(text) == F.length(text), F.regexp_replace(F.lower(text), r"\s+", " ")).otherwise(F.regexp_replace(nfkc(fold(nfkc(text))), r"(?U)\s+", " ")))


def wide_digest(form: Column) -> Column:
    """128 bits, as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), form)), 16, "0") for seed in (1, 2)]))


def _key(doc_id: str) -> Column:
    """The id as a join key without nulls."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def next_documents(rows: DataFrame) -> DataFrame:
    """k, doc_id, next, quarter: for each distinct id (null too) the next one's key, and the most code points that a row
    of it takes from there. Ids are put in order by ranges, not in one task; one row a range meets in one."""
    ids = rows.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("quarter"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    known = dealt.filter("doc_id is not null")
    firsts = known.groupBy("part").agg(F.min("doc_id").alias("first"))
    smallest = firsts.agg(F.min("first")).first()[0]
    after = firsts.select("part", F.lead("first", 1, smallest).over(Window.orderBy("part")).alias("after"))
    inside = known.select("doc_id", "quarter", "part", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")).alias("inside"))
    placed = inside.join(after, "part").select("doc_id", "quarter", F.coalesce("inside", "after").alias("next_id"))
    placed = placed.unionAll(dealt.filter("doc_id is null").select("doc_id", "quarter", F.lit(smallest).cast("long").alias("next_id")))
    return placed.select(_key("doc_id").alias("k"), "doc_id", _key("next_id").alias("next"), "quarter")


def _edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """k, doc_id, next, n_chars, text, edited for the rows whose id is in `order`. Both joins read one exchange of the
    texts."""
    dealt = rows.select(_key("doc_id").alias("k"), "text").repartition("k")
    asked = order.groupBy(F.col("next").alias("k")).agg(F.max("quarter").alias("most"))
    begins = dealt.join(asked, "k").select("k", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.substring(F.col("text"), F.lit(1), F.col("most").cast("int")).alias("begin"))
    begins = begins.groupBy(F.col("k").alias("next")).agg(F.min(F.struct("sha", "begin")).alias("x")).select("next", F.col("x.begin").alias("begin"))
    given = order.join(begins, "next", "left").select("k", "doc_id", "next", F.coalesce("begin", F.lit("")).alias("begin"))
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - quarter), F.substring(F.col("begin"), F.lit(1), quarter))
    return dealt.join(given, "k").select("k", "doc_id", "next", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def fingerprints(docs: DataFrame, digest: Digest = wide_digest) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next. The edited text has its last quarter replaced by the beginning of the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = saved(next_documents(rows), "order")
    forms = _forms(_edited(rows, order), digest)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    marks = saved(forms.select("k", "doc_id", "next", "n_chars", sha("text").alias("sha"), sha("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "marks")
    # buckets with several members: their forms byte by byte
    both = marks.select("k", "next", F.explode(F.array("fingerprint", "edited_fingerprint")).alias("digest"))
    shared = saved(both.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "shared")
    holders = saved(both.join(shared, "digest", "left_semi").select("k", "next").distinct(), "holders")
    wanted = holders.select("k").unionAll(holders.select(F.col("next").alias("k")))
    some = marked(rows, _key("doc_id"), saved(wanted.distinct(), "wanted")).filter("__hit").drop("__hit")
    again = _forms(_edited(some, order.join(holders.select("k"), "k", "left_semi")), digest)
    members = again.select(F.explode(F.array(F.struct("fingerprint", "form"), F.struct(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_form").alias("form")))).alias("x")).select(F.col("x.fingerprint").alias("digest"), "x.form")
    found = saved(members.join(shared, "digest", "left_semi").groupBy("digest", "form").agg(F.count("*").alias("n")), "members")
    several = found.groupBy("digest").agg(F.count("*").alias("forms")).filter("forms > 1").select("digest")
    if not several.isEmpty():
        marks = _told_apart(marks, again, found.join(several, "digest", "left_semi"))
    nexts = marks.groupBy(F.col("k").alias("next")).agg(F.min(F.struct("sha", "fingerprint")).alias("x")).select("next", F.col("x.fingerprint").alias("next_fingerprint"))
    near = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    return marks.join(nexts, "next", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("fingerprint", "edited_fingerprint").alias("near_edited"), near("fingerprint", "next_fingerprint").alias("near_next"))


def _forms(texts: DataFrame, digest: Digest) -> DataFrame:
    formed = texts.withColumn("form", canonical(F.col("text"))).withColumn("edited_form", canonical(F.col("edited")))
    return formed.withColumn("fingerprint", digest(F.col("form"))).withColumn("edited_fingerprint", digest(F.col("edited_form")))


def _told_apart(marks: DataFrame, forms: DataFrame, several: DataFrame) -> DataFrame:
    """Fingerprints with their form's place, where a digest stands for several forms."""
    places = several.select("digest", "form", (F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1).alias("place")).filter("place > 0")
    placed = forms.select("k", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "fingerprint", "form", "edited_fingerprint", "edited_form")
    for kind in ("", "edited_"):
        at = places.select(F.col("digest").alias(f"{kind}fingerprint"), F.col("form").alias(f"{kind}form"), F.col("place").alias(f"{kind}place"))
        placed = placed.join(at, [f"{kind}fingerprint", f"{kind}form"], "left")
    placed = placed.select("k", "sha", "place", "edited_place").filter("place is not null or edited_place is not null").distinct()
    name = lambda kind: F.concat_ws("-", f"{kind}fingerprint", F.col(f"{kind}place").cast("string")).alias(f"{kind}fingerprint")
    return marks.join(placed, ["k", "sha"], "left").select("k", "doc_id", "next", "n_chars", "sha", "edited_sha256", name(""), name("edited_"))
