"""The naming rules of archives: 000__name.omap in maps, the same stem with .png in expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

DIGITS, SEPARATOR = 3, "__"
#: The kinds of problems, in the order in which they are noted.
NO_NUMBER, WIDTH, SEQUENCE, WRONG_SEPARATOR, SPACES, OTHER, FOLLOWS = (
    "no leading number",
    "leading number of the wrong width",
    "leading number out of sequence",
    "wrong separator after the leading number",
    "spaces in the name",
    "does not match the naming rules",
    "renamed with the map it belongs to",
)
MISSING, ORPHAN = "a map with no reference image", "a reference image belonging to no map"


def _reason(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))


def ordered(maps: DataFrame) -> DataFrame:
    """maps(archive, name) with stem, suffix, digits, separator, rest, ordinal, place (from 0: by number, those without
    one last, then by name) and width, the digits that the archive needs."""
    stem, suffix = T.split_suffix(F.col("name"))
    parsed = maps.select("archive", "name", stem.alias("stem"), suffix.alias("suffix"))
    digits, separator, rest = T.split_ordinal(F.col("stem"))
    parsed = parsed.select("*", digits.alias("digits"), separator.alias("separator"), rest.alias("rest"))
    number = F.col("digits").try_cast("decimal(38,0)")
    parsed = parsed.withColumn("ordinal", F.when((F.col("digits") != "") & (number < F.lit(str(2**64)).cast("decimal(38,0)")), number))
    own = Window.partitionBy("archive")
    place = F.row_number().over(own.orderBy(F.asc_nulls_last("ordinal"), "name")) - 1
    return parsed.withColumn("place", place).withColumn("width", F.greatest(F.lit(DIGITS), F.length((F.count("*").over(own) - 1).cast("string"))))


def plan(maps: DataFrame, images: DataFrame) -> DataFrame:
    """archive, folder, ordinal, original, corrected, reasons array<struct<kind, detail>>, problem (null, missing or
    orphan) for every file of maps(archive, name) and images(archive, name)."""
    own = ordered(maps)
    number = F.lpad(F.col("place").cast("string"), F.greatest(F.col("width"), F.length(F.col("place").cast("string"))), "0")
    own = own.withColumn("new_stem", F.concat(number, F.lit(SEPARATOR), T.no_space(F.col("rest")))).withColumn("corrected", F.concat("new_stem", "suffix"))
    has, many = F.col("ordinal").isNotNull(), F.length("digits")
    shown = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    noted = F.array_compact(
        F.array(
            F.when(~has, _reason(NO_NUMBER, F.lit("does not start with a number"))),
            F.when(has & (many != F.col("width")), _reason(WIDTH, F.concat(F.lit("leading number has "), many.cast("string"), F.when(many == 1, " digit").otherwise(" digits"), F.lit(", the suite needs "), F.col("width").cast("string")))),
            F.when(has & (F.col("ordinal") != F.col("place")), _reason(SEQUENCE, F.concat(F.lit("leading number "), F.col("ordinal").cast("string"), F.lit(" is out of sequence, expected "), F.col("place").cast("string")))),
            F.when(has & (F.col("separator") != SEPARATOR), _reason(WRONG_SEPARATOR, F.concat(shown(F.col("separator")), F.lit(" after the leading number, expected "), shown(F.lit(SEPARATOR))))),
            F.when(F.col("rest").rlike(T.SPACE), _reason(SPACES, F.lit("contains spaces"))),
        )
    )
    changed = F.col("corrected") != F.col("name")
    reasons = F.when(changed & (F.size(noted) == 0), F.array(_reason(OTHER, F.lit("does not match the naming rules")))).otherwise(noted)
    own = own.withColumn("reasons", reasons).withColumn("wanted", F.concat("stem", F.lit(".png")))
    there = images.select("archive", F.col("name").alias("wanted")).distinct().withColumn("found", F.lit(True))
    mapped = own.join(there, ["archive", "wanted"], "left")
    first = mapped.select("archive", F.lit("maps").alias("folder"), F.col("place").alias("ordinal"), F.col("name").alias("original"), "corrected", "reasons", F.when(F.col("found").isNull(), MISSING).alias("problem"))
    new = F.concat("new_stem", F.lit(".png"))
    follows = F.when(new == F.col("wanted"), F.array().cast("array<struct<kind:string,detail:string>>")).otherwise(F.array(_reason(FOLLOWS, F.concat(F.lit("follows maps/"), F.col("corrected")))))
    second = mapped.filter("found").select("archive", F.lit("expected").alias("folder"), F.col("place").alias("ordinal"), F.col("wanted").alias("original"), new.alias("corrected"), follows.alias("reasons"), F.lit(None).cast("string").alias("problem"))
    third = orphans(images, maps).select("archive", F.lit("expected").alias("folder"), F.lit(None).cast("int").alias("ordinal"), F.col("name").alias("original"), F.col("name").alias("corrected"), F.array().cast("array<struct<kind:string,detail:string>>").alias("reasons"), F.lit(ORPHAN).alias("problem"))
    return first.unionByName(second).unionByName(third)


def _wanted(maps: DataFrame) -> DataFrame:
    stem, _ = T.split_suffix(F.col("name"))
    return maps.select("archive", F.concat(stem, F.lit(".png")).alias("name"))


def orphans(images: DataFrame, maps: DataFrame) -> DataFrame:
    """Images whose name no map asks for."""
    return images.select("archive", "name").join(_wanted(maps), ["archive", "name"], "left_anti")


def missing(maps: DataFrame, images: DataFrame) -> DataFrame:
    """Maps whose image isn't there."""
    stem, _ = T.split_suffix(F.col("name"))
    return maps.select("archive", F.col("name").alias("map"), F.concat(stem, F.lit(".png")).alias("name")).join(images.select("archive", "name"), ["archive", "name"], "left_anti").select("archive", F.col("map").alias("name"))


def problems(planned: DataFrame) -> DataFrame:
    """archive, line: one for each changed name, missing image and orphan."""
    path = lambda c: F.concat(F.col("folder"), F.lit("/"), F.col(c))
    details = F.array_join(F.transform("reasons", lambda r: r["detail"]), "; ")
    renamed = planned.filter("original <> corrected").select("archive", F.concat(path("original"), F.lit(" -> "), path("corrected"), F.lit("  ("), details, F.lit(")")).alias("line"))
    lost = planned.filter(F.col("problem") == MISSING).select("archive", F.concat(F.lit("maps/"), F.col("original"), F.lit(" has no reference image in expected/ (not fixable)")).alias("line"))
    alone = planned.filter(F.col("problem") == ORPHAN).select("archive", F.concat(F.lit("expected/"), F.col("original"), F.lit(" belongs to no map in maps/ (not fixable)")).alias("line"))
    return renamed.unionAll(lost).unionAll(alone)


def summary(planned: DataFrame) -> DataFrame:
    """archive, kind, n, place: problems by kind, the most frequent first. Reasons count for unchanged names too."""
    kinds = planned.select("archive", F.explode(F.concat(F.transform("reasons", lambda r: r["kind"]), F.array_compact(F.array("problem")))).alias("kind"))
    counts = kinds.groupBy("archive", "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("archive").orderBy(F.desc("n"), "kind")))
