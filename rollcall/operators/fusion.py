"""Joining what is heard with what is seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.aggregates import argmax_last


def fuse(audio: DataFrame, evidence: DataFrame, keys: list[str], threshold: float, alpha: float = 1.0) -> DataFrame:
    """AGG7, FLT30: the audio label where there is no visual evidence or its score reaches the threshold; else the best
    product of synchronisation, classification and alpha overrides it if that is at least the audio score.

    audio: keys, label, score; evidence: keys, label, synchronization_score, classification_score, pos. One label column
    comes out (D-4) and a flag that says whether it was overridden. All-negative evidence overrides with a null label
    where the audio score is not above 0.
    """
    e = evidence.withColumn("visual", F.col("synchronization_score") * F.col("classification_score") * alpha)
    best = argmax_last(e, keys, "label", "visual", "pos").select(*keys, F.col("label").alias("visual_label"), F.col("visual").alias("visual_score"))
    out = audio.join(best, keys, "left")
    override = F.col("visual_score").isNotNull() & (F.col("score") < threshold) & (F.col("visual_score") >= F.col("score"))
    return out.select(*audio.columns, F.coalesce(override, F.lit(False)).alias("overridden"), F.when(override, F.col("visual_label")).otherwise(F.col("label")).alias("fused_label"))


def visual_evidence(segments: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ2, JN7, JN8, FLT10, FLT11, AGG8: for each segment and label the best track that overlaps it.

    segments: keys, seg_pos, start_frame, end_frame; tracks: keys, track_id, set_idx, shot_idx, first, last, frames
    (array), label, score, pos.
    """
    from rollcall.operators.aggregates import best_rows
    from rollcall.operators.filters import confident_track
    from rollcall.operators.joins import interval_overlap

    pairs = interval_overlap(segments, tracks, keys, "start_frame", "end_frame", "first", "last")
    inside = F.filter("frames", lambda f: f.between(F.col("start_frame"), F.col("end_frame")))
    pairs = pairs.withColumn("frames", inside).where(confident_track(F.col("score"), F.size("frames")))
    return best_rows(pairs, [*keys, "seg_pos", "label"], "score", "pos")


def identify(queries: DataFrame, bank: DataFrame, keys: list[str], rule: str = "visual") -> DataFrame:
    """JN10, AGG2, AGG3 and the arg-max rule of a call site: visual and subtitling take the first best, audio the last at or above 0.

    queries: keys, unit, query_id, feature (several query vectors per unit, such as a track's frames).
    """
    from rollcall.operators.aggregates import argmax_first
    from rollcall.operators.joins import similarity_join

    scores = similarity_join(queries, bank, keys).withColumn("score", F.round("score", 6))
    units = queries.select(*keys, "query_id", "unit")
    per_unit = scores.join(units, [*keys, "query_id"]).groupBy(*keys, "unit", "character").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    pick = argmax_last if rule == "audio" else argmax_first
    return pick(per_unit, [*keys, "unit"], "character", "score", "pos")
