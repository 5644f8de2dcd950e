"""Image comparison as queries over pixel tables (image, y, x, r, g, b).

Both images' pixels go through one exchange by row, where they are paired, and one by column: the 3 x 3 neighbourhood is
the window over neighbours in a row, then over neighbours in a column. A pixel that both images have lies in the shared
rectangle, so nobody needs to know their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import tasks

AGREE, ANTIALIASING, REAL = 0, 1, 2
TOLERANCE, BLOCK, OVERVIEW_BYTES = 3, 16, 512 * 1024 * 1024
_CHANNELS = ("r", "g", "b")


def is_wrong(distance: Column, tolerance: int = TOLERANCE) -> Column:
    return distance > tolerance


def too_big_for_overview(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long") * 3 > OVERVIEW_BYTES


def mask(left: DataFrame, right: DataFrame, tolerance: int = TOLERANCE, keep_antialiasing: bool = False, parts: int | None = None) -> DataFrame:
    """image, y, x, class, distance over the union of two images of each name. A pixel outside the overlap is a real
    difference without a distance. Inside, one beyond the tolerance is antialiasing if both images have an edge there:
    the ranges of the three channels among its neighbours in the shared rectangle add up to more than the tolerance. parts: partitions; by the number of pixels
    if not given, so that a task's share doesn't grow with the tables."""
    parts = parts or tasks(left.sparkSession, left.count() + right.count())
    rows = lambda df, side: df.select("image", "y", "x", *[F.col(c).cast("int").alias(f"{c}{i}") if i == side else F.lit(None).cast("int").alias(f"{c}{i}") for i in (0, 1) for c in _CHANNELS], F.lit(side).alias("side"))
    # by rows of an image: pairs and neighbours in a row need no exchange but this
    both = rows(left, 0).unionAll(rows(right, 1)).repartition(parts, "image", "y")
    pixels = both.groupBy("image", "y", "x").agg((F.min("side") < F.max("side")).alias("inside"), *[F.max(f"{c}{i}").alias(f"{c}{i}") for i in (0, 1) for c in _CHANNELS])
    distance = F.when(F.col("inside"), sum((F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in _CHANNELS), F.lit(0)))
    across = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-1, 1)
    down = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-1, 1)
    shared = [(f"{c}{i}", F.when(F.col("inside"), F.col(f"{c}{i}"))) for i in (0, 1) for c in _CHANNELS]
    pixels = pixels.select("image", "y", "x", "inside", distance.alias("distance"), *[f(own).over(across).alias(f"{n}_{c}") for c, own in shared for n, f in (("low", F.min), ("high", F.max))])
    pixels = pixels.repartition(parts, "image", "x")
    span = lambda c: F.max(f"high_{c}").over(down) - F.min(f"low_{c}").over(down)
    edge = lambda side: sum((span(f"{c}{side}") for c in _CHANNELS), F.lit(0)) > tolerance
    pixels = pixels.select("image", "y", "x", "inside", "distance", (edge(0) & edge(1)).alias("edges"))
    kind = F.when(~F.col("inside"), REAL).when(~is_wrong(F.col("distance"), tolerance), AGREE)
    kind = kind.when(F.col("edges"), REAL if keep_antialiasing else ANTIALIASING).otherwise(REAL)
    return pixels.select("image", F.col("y").cast("long"), F.col("x").cast("long"), kind.cast("int").alias("class"), F.col("distance").cast("long").alias("distance"))


def summary(pixels: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """A row for each image of mask(): pixels of the union rectangle, counts by class, the largest distance of all shared
    pixels, and mean and population standard deviation over the wrong ones (null if there are none)."""
    d = F.col("distance")
    wrong = is_wrong(d, tolerance)
    n, s, q = F.count_if(wrong), F.sum(F.when(wrong, d)), F.sum(F.when(wrong, d * d))
    counts = pixels.groupBy("image").agg(
        ((F.max("x") + 1) * (F.max("y") + 1)).alias("size"), F.count_if(F.col("class") == ANTIALIASING).alias("n_aa"), F.count_if(F.col("class") == REAL).alias("n_real"), F.coalesce(F.max("distance"), F.lit(0)).alias("largest"), n.alias("n"), s.alias("s"), q.alias("q")
    )
    mean = F.try_divide("s", "n")
    return counts.select("image", "size", "n_aa", "n_real", ((F.col("n_aa") + F.col("n_real")) / F.col("size")).alias("differing"), (F.col("n_real") / F.col("size")).alias("real"), "largest", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("sd"))


def tally(found: DataFrame, references: DataFrame, rendered: DataFrame) -> DataFrame:
    """One row: references in all, those without a rendering, and how the compared pairs fared. found: summary();
    references(image); rendered(image)."""
    pairs = references.select("image").distinct().join(rendered.select("image", F.lit(True).alias("there")).distinct(), "image", "left").join(found, "image", "left")
    there = F.coalesce("there", F.lit(False))
    any_, real = F.col("n_aa") + F.col("n_real") > 0, F.col("n_real") > 0
    return pairs.agg(F.count("*").alias("total"), F.count_if(~there).alias("missing"), F.count_if(there & ~any_).alias("identical"), F.count_if(there & any_ & ~real).alias("antialiasing_only"), F.count_if(there & real).alias("differing"))


def report_order(found: DataFrame) -> DataFrame:
    """Rows with their place in the report: the worst first."""
    # ranks are needed for the report's rows alone: one an image
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("real"), F.desc("differing"), "image")))


def block_scores(pixels: DataFrame) -> DataFrame:
    """image, block_y, block_x, score: real differences in blocks of 16 x 16."""
    return pixels.filter(F.col("class") == REAL).groupBy("image", F.floor(F.col("y") / BLOCK).alias("block_y"), F.floor(F.col("x") / BLOCK).alias("block_x")).agg(F.count("*").alias("score"))


def count_in(pixels: DataFrame, squares: DataFrame, parts: int | None = None) -> DataFrame:
    """Real differences inside squares(image, x, y, size, ...). They meet by the blocks that a square touches, so one image
    may have many of both. parts: partitions; by the number of pixels if not given."""
    parts = parts or tasks(pixels.sparkSession, pixels.count())
    own = ["image", "sx", "sy", *[c for c in squares.columns if c not in ("image", "x", "y")]]
    touched = lambda c: F.explode(F.sequence(F.floor(F.col(c) / BLOCK), F.floor((F.col(c) + F.col("size") - 1) / BLOCK)))
    at = squares.withColumnsRenamed({"x": "sx", "y": "sy"}).withColumn("block_y", touched("sy")).withColumn("block_x", touched("sx"))
    blocks = ["image", "block_y", "block_x"]
    real = pixels.filter(F.col("class") == REAL).select("image", "y", "x", F.floor(F.col("y") / BLOCK).alias("block_y"), F.floor(F.col("x") / BLOCK).alias("block_x"))
    inside = (F.col("x") >= F.col("sx")) & (F.col("x") < F.col("sx") + F.col("size")) & (F.col("y") >= F.col("sy")) & (F.col("y") < F.col("sy") + F.col("size"))
    return at.join(real.repartition(parts, *blocks), blocks, "left").groupBy(*own).agg(F.count_if(inside).alias("real_px"))


def worst_block(pixels: DataFrame, size: int = 128) -> DataFrame:
    """The worst region of each image: around the block with most real differences, the first of equals."""
    best = block_scores(pixels).groupBy("image").agg(F.min_by(F.struct("block_y", "block_x"), F.struct(-F.col("score"), F.col("block_y"), F.col("block_x"))).alias("b"))
    limits = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    s = F.least(F.lit(size), "w", "h")
    centred = lambda block, limit: F.greatest(F.lit(0), F.least(block * BLOCK + BLOCK // 2 - F.floor(s / 2), limit - s))
    return best.join(limits, "image").select("image", centred(F.col("b.block_x"), F.col("w")).alias("x"), centred(F.col("b.block_y"), F.col("h")).alias("y"), s.alias("size"))


def worst_regions(pixels: DataFrame, count: int = 0, size: int = 128) -> DataFrame:
    """image, rank, x, y, real_px: the worst regions in turn; blocks that a region covers, if only in part, are out of
    the next choice. count 0: until nothing real is left. One group holds one image's 16 x 16 block scores."""
    parts = tasks(pixels.sparkSession, pixels.count())
    limits = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    # few rows an image, but a call of Python
    scores = block_scores(pixels).join(limits, "image").repartition(parts, "image")
    kind = dict(pixels.dtypes)["image"]

    def pick(key, blocks):
        import pandas as pd

        w, h = int(blocks.w.iloc[0]), int(blocks.h.iloc[0])
        side = min(size, w, h)
        left = {(int(a), int(b)): int(n) for a, b, n in zip(blocks.block_y, blocks.block_x, blocks.score, strict=True)}
        out = []
        while left and (not count or len(out) < count):
            by, bx = min(left, key=lambda b: (-left[b], b))
            if left[by, bx] <= 0:
                break
            x, y = (max(0, min(b * BLOCK + BLOCK // 2 - side // 2, limit - side)) for b, limit in ((bx, w), (by, h)))
            out.append((key[0], len(out) + 1, x, y, side))
            for b in [b for b in left if y // BLOCK <= b[0] < -(-(y + side) // BLOCK) and x // BLOCK <= b[1] < -(-(x + side) // BLOCK)]:
                del left[b]
        return pd.DataFrame(out, columns=["image", "rank", "x", "y", "size"])

    chosen = scores.groupBy("image").applyInPandas(pick, f"image {kind}, rank int, x long, y long, size long")
    return count_in(pixels, chosen, parts).select("image", "rank", F.col("sx").alias("x"), F.col("sy").alias("y"), "real_px")


def crop(pixels: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """Pixels of regions(image, x, y), as (image, rank, y, x, r, g, b); beyond the image's edge (32, 32, 32)."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    whole = regions.select("image", "rank", "x", "y", F.explode(steps).alias("dy")).withColumn("dx", F.explode(steps))
    there = pixels.select("image", F.col("x").alias("px"), F.col("y").alias("py"), *_CHANNELS)
    joined = whole.withColumn("px", F.col("x") + F.col("dx")).withColumn("py", F.col("y") + F.col("dy")).join(there, ["image", "px", "py"], "left")
    return joined.select("image", "rank", F.col("dy").alias("y"), F.col("dx").alias("x"), *[F.coalesce(c, F.lit(32)).alias(c) for c in _CHANNELS])


def magnify(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a square of factor x factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return pixels.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).select(*[c for c in pixels.columns if c not in ("y", "x", *_CHANNELS)], (F.col("y") * factor + F.col("dy")).alias("y"), (F.col("x") * factor + F.col("dx")).alias("x"), *_CHANNELS)
