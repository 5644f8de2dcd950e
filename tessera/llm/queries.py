"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, slot, table


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary files are; nothing is copied from there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held(condition: Column) -> Column:
    """held_out; a null doc_id is never held out."""
    return F.coalesce(condition, F.lit(False)).alias("held_out")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.records import read_index, write_records

    path = scratch(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    fit = fit_quality(docs, table(spark, sf_dir, "labels"), "quality", slot(5) != 0)
    return score_quality(docs, fit, 0.3).select("doc_id", held(slot(5) == 0), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "toxic", slot(4) != 2)
    return score_toxicity(docs, model, 0.3).select("doc_id", held(slot(4) == 2), "score", "predicted", "offending")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 4's result."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 6's result."""
    return op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 7's result, which needs no training."""
    from tessera.llm.hmm import score_texts

    found = score_texts(table(spark, sf_dir, "documents"), rounds=0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_records, op2_quality, op3_bpe, op4_fingerprints, op5_html, op6_licenses, op7_hmm, op8_near_duplicates, op9_decontaminate, op10_toxicity, fingerprint_edits, license_places, lm_base_scores)}


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

_OP9 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
k as (select distinct item_id, least(8, len(w)) as n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as s
      from (select item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) as i from b where len(w) > 0)),
n as (select distinct n from k),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n where len(w) >= n),
h as (select p.doc_id, p.i, p.n, k.item_id from p join k on k.n = p.n and k.s = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from h) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"""regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"""

_OP8 = f"""
with recursive w as (select doc_id, {_SPACED} as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as s, least(3, len(w)) as n from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from w where len(w) > 0)),
z as (select doc_id, count(*) as n_shingles from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.n = b.n and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join z x on x.doc_id = a join z y on y.doc_id = b where 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select w.doc_id, coalesce(n_shingles, 0) as n_shingles, component_id, w.doc_id = component_id as kept from w join m on m.a = w.doc_id left join z on z.doc_id = w.doc_id
"""

_EDITS = """
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next, length(text) as n from d)
select doc_id, n as n_chars, sha256(left(text, n - n // 4) || left(next, n // 4)) as edited_sha256 from n
"""

_PLACES = f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select * from (values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) v(phrase, label)),
h as (select doc_id, i - 1 as place, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) q join p on q.w[i : i + len(phrase) - 1] = phrase),
g as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from h group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join g on g.doc_id = d.doc_id
"""

#: crc32 of the id as text, bit by bit: -1 stands for a shift.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end), 4294967295::bigint)"

_BASE = f"""
with d as (select doc_id, {_CRC} % 7 = 2 as held_out, list_append({_SPACED}, '') as w from documents),
t as (select doc_id, held_out, unnest(w) as t from d),
c as (select t, count(*) as c from t where not held_out group by t),
a as (select sum(c) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, cast(any_value(a.n) as bigint) as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (a.n + a.v + 1))), 4) as base_score
from t left join c on c.t = t.t cross join a group by doc_id, held_out
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_near_duplicates": _OP8, "op9_decontaminate": _OP9, "fingerprint_edits": _EDITS, "license_places": _PLACES, "lm_base_scores": _BASE}
