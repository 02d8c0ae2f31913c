"""Aggregations whose tie rules matter: first, last, by position; and the ones that collect in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collect_ordered(df: DataFrame, keys: list[str], item: str, pos: str, out: str = "items") -> DataFrame:
    """AGG1: the items of each group as an array in the order of pos."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["x"]).alias(out))


def top_mean(df: DataFrame, keys: list[str], score: str, k: int = 3, out: str = "score") -> DataFrame:
    """AGG2: mean of the k highest scores, of all if there are fewer."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*keys).agg(F.avg(score).alias(out))


def argmax_first(df: DataFrame, keys: list[str], name: str, score: str, pos: str) -> DataFrame:
    """AGG4, AGG6, AGG8: the highest score's name, the first in order on ties; negative scores count."""
    best = F.max_by(F.struct(F.col(name).alias(name), F.col(score).alias(score)), F.struct(F.col(score), (-F.col(pos)).alias("p")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def argmax_last(df: DataFrame, keys: list[str], name: str, score: str, pos: str) -> DataFrame:
    """AGG5, AGG7: starts at 0 and takes equals, so the last wins and with only negative scores the name is null and the score 0."""
    ok = F.col(score) >= 0
    best = F.max_by(F.when(ok, F.col(name)), F.when(ok, F.struct(F.col(score), F.col(pos))))
    return df.groupBy(*keys).agg(best.alias(name), F.coalesce(F.max(F.when(ok, F.col(score))), F.lit(0.0)).alias(score))


def best_rows(df: DataFrame, keys: list[str], score: str, pos: str) -> DataFrame:
    """AGG8, GEO10, WIN16: the whole row of the highest score of each group, first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(pos))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def per_frame_best(df: DataFrame, floor: float, keys: list[str], frame: str, person: str, idx: str, score: str) -> DataFrame:
    """AGG9, FLT9: the best box of each person in each frame at or above the floor; then each person's boxes in frame order."""
    best = df.where(F.col(score) >= floor).groupBy(*keys, frame, person).agg(F.max_by(idx, F.struct(F.col(score), -F.col(idx))).alias(idx))
    return collect_ordered(best.withColumn("hit", F.struct(frame, idx)), [*keys, person], "hit", frame, "hits")


def crowd_exception(df: DataFrame, keys: list[str], label: str, crowd: str, score: str, pos: str) -> DataFrame:
    """AGG10: the best row of each label, and for the crowd label all of its rows besides."""
    return best_rows(df, [*keys, label], score, pos).unionByName(df.where(F.col(label) == crowd))


def best_per_label_shot(df: DataFrame, label: str = "label", shot: str = "shot", score: str = "score") -> DataFrame:
    """AGG11: highest score of each label and shot; a label is the same across movies."""
    return df.groupBy(label, shot).agg(F.max(score).alias(score))


def largest_cluster(df: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """AGG12: the cluster with most entries, the last on ties."""
    n = df.groupBy(*keys, cluster).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(cluster, F.struct("n", cluster)).alias(cluster), F.max("n").alias("n"))


def widest_cluster(df: DataFrame, keys: list[str], cluster: str, image: str, least: int = 2) -> DataFrame:
    """AGG13: the cluster with most distinct images, the first on ties; groups whose best has fewer than `least` are dropped."""
    n = df.groupBy(*keys, cluster).agg(F.count_distinct(image).alias("n"))
    out = n.groupBy(*keys).agg(F.max_by(cluster, F.struct(F.col("n"), -F.col(cluster))).alias(cluster), F.max("n").alias("n"))
    return out.where(F.col("n") >= least)


def centroid(df: DataFrame, keys: list[str], feature: str, mode: str = "mean_of_units") -> DataFrame:
    """AGG14 to AGG16: unit-length mean of unit vectors, their sum, or the raw mean, by dimension; each combines before the shuffle."""
    from rollcall.functions.vectors import normalise

    v = F.col(feature).cast("array<double>") if mode == "raw_mean" else normalise(F.col(feature))
    combine = F.sum if mode == "sum_of_units" else F.avg
    dims = df.select(*keys, F.posexplode(v).alias("_i", "_x")).groupBy(*keys, "_i").agg(combine("_x").alias("_x"))
    whole = dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("c"))
    return whole.select(*keys, normalise(F.col("c")).alias("centroid"))


def prototype(picks: DataFrame, anchors: DataFrame, keys: list[str], feature: str, sim: str, threshold: float = 0.5) -> DataFrame:
    """AGG17: unit-length mean of each anchor, counted once, and the picks at or above the threshold."""
    rows = anchors.select(*keys, feature).unionByName(picks.where(F.col(sim) >= threshold).select(*keys, feature))
    return centroid(rows, keys, feature, "raw_mean")


def category_counts(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """AGG18: rows of each value per group, 0 where there is none."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def extent(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """AGG19: first and last frame."""
    return df.groupBy(*keys).agg(F.min(frame).alias("start_idx"), F.max(frame).alias("end_idx"))


def track_mean_iou(a: DataFrame, b: DataFrame, keys: list[str], ids: tuple[str, str]) -> DataFrame:
    """AGG20, SET3: mean IoU over the frames that two tracks share, for each pair with any; absent pairs are 0."""
    from rollcall.functions.boxes import Box

    cols = ("x0", "y0", "x1", "y1")
    left = a.select(*keys, "frame", ids[0], *(F.col(c).alias(f"a_{c}") for c in cols))
    right = b.select(*keys, "frame", ids[1], *(F.col(c).alias(f"b_{c}") for c in cols))
    both = left.join(right, [*keys, "frame"])
    return both.groupBy(*keys, *ids).agg(F.avg(F.coalesce(Box.of("a_").iou(Box.of("b_")), F.lit(0.0))).alias("iou"))


def track_extent(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG21: largest width and height over a track's frames."""
    return df.groupBy(*keys).agg(F.max(F.col("x1") - F.col("x0")).alias("max_width"), F.max(F.col("y1") - F.col("y0")).alias("max_height"))


def score_grid(predictions: DataFrame, truth: DataFrame, unit: list[str], label: str = "label", score: str = "score", vocabulary_of: list[str] | None = None) -> DataFrame:
    """AGG23, SET2: for every unit and label of its vocabulary the highest score (0 where absent) and whether the label is true.

    The vocabulary is the union of predicted and true labels of each `vocabulary_of` group (all units by default).
    """
    group = vocabulary_of or []
    rows = predictions.select(*unit, label, F.col(score).cast("double").alias("score"), F.lit(0).alias("truth")).unionByName(truth.select(*unit, label, F.lit(None).cast("double").alias("score"), F.lit(1).alias("truth")))
    words = rows.select(*group, label).distinct()
    units = rows.select(*unit).distinct()
    grid = units.join(words, group) if group else units.crossJoin(words)  # the grid itself; Spark sends the vocabulary whole only if it is small
    seen = rows.groupBy(*unit, label).agg(F.max("score").alias("score"), F.max("truth").alias("truth"))
    out = grid.join(seen, [*unit, label], "left")
    return out.withColumns({"score": F.coalesce("score", F.lit(0.0)), "truth": F.coalesce("truth", F.lit(0))})


def max_pool(grid: DataFrame, unit: list[str], label: str = "label") -> DataFrame:
    """AGG22: highest score and truth flag of each pooled unit and label."""
    return grid.groupBy(*unit, label).agg(F.max("score").alias("score"), F.max("truth").alias("truth"))


def topk_accuracy(scores: DataFrame, k: int, row: str = "i", column: str = "j", score: str = "score") -> DataFrame:
    """AGG31: percentage of rows whose own column is among the k highest."""
    w = Window.partitionBy(row).orderBy(F.col(score).desc(), F.col(column))
    hit = scores.withColumn("_r", F.row_number().over(w)).where(F.col(row) == F.col(column))
    return hit.agg((F.avg((F.col("_r") <= k).cast("double")) * 100).alias(f"top{k}"))


def mean_of_batch_means(df: DataFrame, batch: str, value: str) -> DataFrame:
    """AGG32: each batch counts once, whatever its size."""
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def sync_score(cells: DataFrame, keys: list[str], frame: str = "t", cosine: str = "cos") -> DataFrame:
    """AGG33: highest (cos + 1) / 2 over the cells of a frame, averaged over frames."""
    top = cells.groupBy(*keys, frame).agg(F.max((F.col(cosine) + 1) / 2).alias("m"))
    return top.groupBy(*keys).agg(F.avg("m").alias("score"))


def best_offset(video: DataFrame, audio: DataFrame, keys: list[str], shifts: list[int], similarity: Column) -> DataFrame:
    """AGG34: the shift with the highest mean, over frames, of the highest similarity of a cell; the first on ties.

    video: keys, t, cell, ...; audio: keys, t, ...; similarity is an expression over both. Each audio row meets the
    frame it is shifted to by an equi join.
    """
    moved = audio.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("t", F.col("t") - F.col("shift"))
    both = video.join(moved, [*keys, "t"]).groupBy(*keys, "shift", "t").agg(F.max(similarity).alias("m"))
    mean = both.groupBy(*keys, "shift").agg(F.avg("m").alias("m"))
    return mean.groupBy(*keys).agg(F.max_by("shift", F.struct(F.col("m"), -F.col("shift"))).alias("shift"), F.max("m").alias("score"))


def nested_map(df: DataFrame, keys: list[str], key: str, value: Column) -> DataFrame:
    """ARR2: a map per group; of equal keys the greatest entry stays."""
    one = df.groupBy(*keys, key).agg(F.max(value).alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias("map"))


def mask_box(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """GEO5: inclusive extents of the pixels of each mask; a mask without pixels has no row."""
    return pixels.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
