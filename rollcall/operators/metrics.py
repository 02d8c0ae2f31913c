"""Evaluation metrics. The two definitions of average precision are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.windows import running


def pr_curve(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """AGG26: precision and recall at every distinct score, from the highest; tied scores are one threshold.

    Rows are first counted per score, and thresholds are summed up by ranges, so a group may be of any size.
    """
    at = df.groupBy(*keys, score).agg(F.sum(F.col(hit).cast("long")).alias("tp"), F.count("*").alias("n"))
    out = running(at, keys, [F.col(score).desc()], {"tps": F.col("tp"), "ns": F.col("n")}).withColumnRenamed("total_tps", "total")
    return out.select(*keys, score, "tp", (F.col("tps") / F.col("ns")).alias("precision"), F.try_divide(F.col("tps").cast("double"), F.col("total")).alias("recall"), "total")


def average_precision(df: DataFrame, keys: list[str], score: str, hit: str, out: str = "ap") -> DataFrame:
    """AGG24: sum of recall steps times precision over distinct scores; 0 where nothing is correct."""
    curve = pr_curve(df, keys, score, hit)
    return curve.groupBy(*keys).agg(F.coalesce(F.sum(F.try_divide(F.col("tp").cast("double"), F.col("total")) * F.col("precision")), F.lit(0.0)).alias(out))


def average_precision_total(df: DataFrame, key: str, score: str, hit: str) -> DataFrame:
    """AGG25: average precision of each group, and in the row with a null key that of all rows together; no rows give a total of 0."""
    both = df.select(F.col(key).cast("string").alias(key), score, hit, F.lit(0).alias("all")).unionByName(df.select(F.lit(None).cast("string").alias(key), score, hit, F.lit(1).alias("all")))
    out = average_precision(both, ["all", key], score, hit)
    empty = df.groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("all"), F.lit(None).cast("string").alias(key), F.lit(0.0).alias("ap"))
    return out.unionByName(empty).drop("all")


def roc_auc(df: DataFrame, keys: list[str], score: str, hit: str, out: str = "auc") -> DataFrame:
    """AGG27: share of (correct, wrong) pairs in the right order, ties a half; null where either kind is missing."""
    at = df.groupBy(*keys, score).agg(F.sum(F.col(hit).cast("long")).alias("p"), F.sum(1 - F.col(hit).cast("long")).alias("q"))
    below = running(at, keys, [F.col(score)], {"upto": F.col("q")}).withColumn("below", F.col("upto") - F.col("q"))
    won = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    return below.groupBy(*keys).agg(F.try_divide(won.cast("double"), F.sum("p") * F.sum("q")).alias(out))


def detection_ap(matches: DataFrame, keys: list[str], n_gt: str = "n_gt") -> DataFrame:
    """AGG28: rows ranked by score, ties in input order; sum of recall steps times precision, row by row.

    matches: keys, score, pos, tp (0 or 1) and n_gt, the number of true boxes of the whole set. Rows are ranked by ranges,
    so a group may be of any size.
    """
    ranked = running(matches, keys, [F.col("score").desc(), F.col("pos")], {"rank": F.lit(1), "tps": F.col("tp")})
    return ranked.groupBy(*keys).agg((F.sum(F.when(F.col("tp") == 1, F.col("tps") / F.col("rank")).otherwise(0.0)) / F.max(n_gt)).alias("ap"))


def mean_average_precision(aps: DataFrame, thresholds: int = 10) -> DataFrame:
    """AGG29: mean over thresholds; one without predictions has no row and is left out, all-empty gives null (D-11)."""
    return aps.agg(F.avg("ap").alias("map"), F.count("*").alias("n_thresholds"))


# Diarisation error

TICKS = 100  # per second


def der_sweep(truth: DataFrame, predicted: DataFrame, clip: str = "clip", collar: float = 0.25, other: str = "Other", bucket: float = 60.0) -> DataFrame:
    """AGG30: diarisation error of all clips together, with and without overlapped speech, by a sweep over segment edges.

    Both tables: clip, seg_pos, start, end (seconds), label. Time is counted in ticks of 10 ms; between two edges nothing
    changes, so each stretch between neighbouring edges is weighed by its ticks instead of visiting them. The span of a
    clip is that of its truth; clips whose truth is only `other` are left out; of overlapping segments the last listed
    labels a tick; ticks near an edge of any true segment, and those whose truth is `other`, do not count. A clip
    without predictions has them all wrong. Returns error, total, der, and the same without overlap; der is null where
    nothing is spoken. Stretches meet only the segments that cover their `bucket` of seconds, so long clips stay linear.
    """
    c = round(collar * TICKS)

    def ticks(df: DataFrame) -> DataFrame:
        return df.select(clip, F.col("seg_pos").alias("p"), F.round(F.col("start") * TICKS).cast("long").alias("s"), F.round(F.col("end") * TICKS).cast("long").alias("e"), F.col("label").alias("l"))

    g, p = ticks(truth), ticks(predicted)
    clips = g.groupBy(clip).agg(F.min("s").alias("t0"), F.max("e").alias("t1"), F.max((F.col("l") != other).cast("int")).alias("speech")).where("speech = 1").drop("speech")
    g, p = g.join(clips.select(clip), clip), p.join(clips, clip).where("s <= t1 and e > t0").drop("t0", "t1")
    # events: at a tick a segment, or a collar, opens (+1) or closes (-1)
    kind = lambda df, k, s, e: df.select(clip, F.lit(k).alias("k"), "p", "l", s.alias("s"), e.alias("e"))
    spans = kind(g, "g", F.col("s"), F.col("e")).unionByName(kind(p, "p", F.col("s"), F.col("e")))
    spans = spans.unionByName(kind(g, "c", F.col("s"), F.col("s") + c)).unionByName(kind(g, "c", F.col("e") - c, F.col("e"))).where("e > s")
    edges = spans.select(clip, F.explode(F.array("s", "e")).alias("t")).unionByName(clips.select(clip, F.explode(F.array(F.col("t0"), F.col("t1") + 1)).alias("t"))).distinct()
    edges = edges.join(clips, clip).where("t between t0 and t1 + 1")
    nxt = F.lead("t").over(Window.partitionBy(clip).orderBy("t"))
    pieces = edges.withColumn("u", nxt).where("u is not null").select(clip, "t", (F.col("u") - F.col("t")).alias("w"))
    size = round(bucket * TICKS)
    cover = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))))
    active = pieces.withColumn("b", F.floor(F.col("t") / size)).join(cover, [clip, "b"]).where("s <= t and e > t")
    state = active.groupBy(clip, "t", "w").agg(
        F.max_by(F.when(F.col("k") == "g", F.col("l")), F.when(F.col("k") == "g", F.col("p"))).alias("truth"),
        F.max_by(F.when(F.col("k") == "p", F.col("l")), F.when(F.col("k") == "p", F.col("p"))).alias("guess"),
        F.count_if(F.col("k") == "c").alias("collars"),
        F.count_if((F.col("k") == "g") & (F.col("l") != other)).alias("speakers"),
    )
    state = pieces.join(state, [clip, "t", "w"], "left")
    return _der(state, other)


def _der(state: DataFrame, other: str) -> DataFrame:
    counted = (F.coalesce("collars", F.lit(0)) == 0) & (F.coalesce("truth", F.lit("")) != other)
    wrong = F.when(F.col("truth").isNotNull(), ~F.col("truth").eqNullSafe(F.col("guess"))).otherwise(F.col("guess").isNotNull())
    alone = F.coalesce("speakers", F.lit(0)) <= 1

    def total(flag):  # noqa: ANN001, ANN202
        return F.coalesce(F.sum(F.when(flag, F.col("w"))), F.lit(0)) / F.lit(TICKS)

    sums = state.agg(
        total(counted & wrong).alias("error"), total(counted & F.col("truth").isNotNull()).alias("total"),
        total(counted & wrong & alone).alias("error_alone"), total(counted & F.col("truth").isNotNull() & alone).alias("total_alone"),
    )
    return sums.withColumns({"der": F.try_divide("error", "total"), "der_alone": F.try_divide("error_alone", "total_alone")})


def der_grid(truth: DataFrame, predicted: DataFrame, clip: str = "clip", collar: float = 0.25, other: str = "Other") -> DataFrame:
    """The same error tick by tick: the plain form, for tests and small clips."""
    from rollcall.operators.joins import label_at

    c = round(collar * TICKS)

    def ticks(df: DataFrame) -> DataFrame:
        return df.select(clip, F.col("seg_pos").alias("p"), F.round(F.col("start") * TICKS).cast("long").alias("s"), F.round(F.col("end") * TICKS).cast("long").alias("e"), F.col("label").alias("l"))

    g, p = ticks(truth), ticks(predicted)
    clips = g.groupBy(clip).agg(F.min("s").alias("t0"), F.max("e").alias("t1"), F.max((F.col("l") != other).cast("int")).alias("speech")).where("speech = 1")
    grid = clips.select(clip, F.explode(F.sequence("t0", "t1")).alias("t"))
    state = label_at(grid, g.withColumnRenamed("l", "truth"), [clip], "t", "s", "e", "truth", "p")
    state = label_at(state, p.withColumnRenamed("l", "guess"), [clip], "t", "s", "e", "guess", "p")
    near = ((F.col("t") >= F.col("s")) & (F.col("t") < F.col("s") + c)) | ((F.col("t") >= F.col("e") - c) & (F.col("t") < F.col("e")))
    count = grid.join(g, clip).groupBy(clip, "t").agg(F.count_if(near).alias("collars"), F.count_if((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")) & (F.col("l") != other)).alias("speakers"))
    return _der(state.join(count, [clip, "t"], "left").withColumn("w", F.lit(1)), other)
