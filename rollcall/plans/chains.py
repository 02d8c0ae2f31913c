"""The chains of stages that users run, as single plans: no file passes between their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import text as X
from rollcall.functions.boxes import Box
from rollcall.operators import aggregates as A
from rollcall.operators import filters as L
from rollcall.operators import fusion, matching
from rollcall.operators import joins as J
from rollcall.operators import metrics as M
from rollcall.operators import windows as W


def character_anchors(cast: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """Anchors of a movie's characters: credits to pages by exact, then by fuzzy name; infobox image first, with confidence.

    cast: movie, character, billing_pos; pages: movie, title, pos; images: movie, title, url, source (infobox or page).
    """
    named = cast.where(~F.coalesce(X.generic_role(F.col("character")), F.lit(True)))
    roles = W.first_occurrence(named, ["movie", "character"], "billing_pos")
    good = pages.where(~X.junk_title(F.col("title")))
    key = lambda c: X.normalise_name(F.col(c))
    first = good.groupBy("movie", key("title").alias("key")).agg(F.min_by("title", "pos").alias("title"))
    exact = roles.withColumn("key", key("character")).join(first, ["movie", "key"]).select("movie", "character", "title", F.lit("exact").alias("match"))
    rest = J.pending(roles, exact, ["movie", "character"])
    loose = J.token_prefix_match(rest.withColumnRenamed("character", "name"), good, keys=["movie"])
    fuzzy = loose.select("movie", F.col("name").alias("character"), "title", F.lit("fuzzy").alias("match"))
    matched = exact.unionByName(fuzzy)
    best = W.first_occurrence(images.withColumn("_p", F.when(F.col("source") == "infobox", 0).otherwise(1)), ["movie", "title"], "_p").drop("_p")
    out = roles.join(matched, ["movie", "character"], "left").join(best, ["movie", "title"], "left")
    return out.select("movie", "character", "billing_pos", "title", "match", "url", "source", L.confidence_class(F.col("url"), F.col("source"), F.coalesce("match", F.lit("none"))).alias("anchor_confidence"))


def classify_tracks(track_frames: DataFrame, bank: DataFrame, frames: int = 5) -> DataFrame:
    """Tracks to characters: sampled frames, cosine with the movie's bank, mean of the best three, best frame, first best character.

    track_frames: movie, clip, shot_idx, set_idx, track_id, frame, feature; bank: movie, character, pos, feature.
    """
    keys = ["movie", "clip", "shot_idx", "set_idx", "track_id"]
    few = W.hash_sample(track_frames, keys, ["frame"], frames)
    q = few.withColumn("query_id", F.xxhash64(*keys, "frame")).withColumn("unit", F.struct(*keys[1:]))
    best = fusion.identify(q, bank, ["movie"])
    return best.select("movie", "unit.*", F.col("character").alias("label"), "score")


def detection_map(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Mean average precision of boxes: aliases on both sides, suppression, area floor, greedy matching at ten thresholds.

    Both: keys, x0..y1, label, pos (unique in the set); predictions also score.
    """
    label = L.alias(L.label_prefix(F.col("label")))
    kept = matching.nms(predictions.withColumn("label", label), keys, eps=1e-6).where(L.large_enough(Box.of()))
    gt = truth.withColumn("label", L.alias(F.col("label"))).where(L.large_enough(Box.of()))
    n = gt.agg(F.count("*").alias("n_gt"))
    matches = matching.detection_matches(kept, gt, keys).crossJoin(F.broadcast(n))
    return M.mean_average_precision(M.detection_ap(matches, ["threshold"]))


def speech_scores(segments: DataFrame, evidence: DataFrame, threshold: float) -> DataFrame:
    """Average precision of speech labels per movie and in total, after fusion with visual evidence and the open-set rule.

    segments: movie, clip, seg_pos, truth, label, score; evidence as in fuse().
    """
    keys = ["movie", "clip", "seg_pos"]
    fused = fusion.fuse(segments, evidence, keys, threshold)
    label, score = L.open_set(F.col("fused_label"), F.col("score"))
    hits = fused.select("movie", score.alias("score"), label.eqNullSafe(L.clean_truth(F.col("truth"))).cast("int").alias("hit"))
    return M.average_precision_total(hits, "movie", "score", "hit")


def name_scores(predictions: DataFrame, truth: DataFrame, frames: int = 8, whole: bool = True) -> DataFrame:
    """Names per segment of three shots: dense label grid of the clip, max pool, then average precision and AUC over all.

    predictions: movie, clip, shot_idx, frame_idx, label, score; truth the same without score. With whole all frames of a
    segment count; else up to `frames`, chosen by a hash (D-9).
    """
    truth = truth.withColumn("label", L.movie_alias(F.col("movie"), F.col("label")))
    unit = ["movie", "clip", "shot_idx", "frame_idx"]
    grid = A.score_grid(predictions, truth, unit, vocabulary_of=["movie", "clip"]).withColumn("segment", W.bucket_by_floor(F.col("shot_idx"), 3))
    if not whole:
        chosen = W.hash_sample(grid.select("movie", "clip", "segment", "shot_idx", "frame_idx").distinct(), ["movie", "clip", "segment"], ["shot_idx", "frame_idx"], frames)
        grid = grid.join(chosen, ["movie", "clip", "segment", "shot_idx", "frame_idx"], "left_semi")
    pooled = A.max_pool(grid, ["movie", "clip", "segment"])
    return M.average_precision(pooled, [], "score", "truth").crossJoin(M.roc_auc(pooled, [], "score", "truth"))


def describe_frames(annotations: DataFrame, hits: DataFrame, roles: DataFrame) -> DataFrame:
    """Prompts' character lists: texts of fit length, ids by first appearance, their colours and names.

    annotations: anno_idx, text; hits: anno_idx, person, pos; roles: person, role.
    """
    kept = annotations.where(X.fits_length(F.col("text")))
    ids = W.ids_by_first_appearance(hits.join(kept.select("anno_idx"), "anno_idx", "left_semi"), ["anno_idx"], "person", "pos")
    named = ids.join(roles, "person").withColumn("colour", W.colour_of(F.col("id"), X.COLOURS))
    ordered = A.collect_ordered(named.withColumn("x", F.struct("role", "colour")), ["anno_idx"], "x", "id")
    listed = ordered.select("anno_idx", X.character_list(F.transform("items", lambda i: i["role"]), F.transform("items", lambda i: i["colour"])).alias("characters"))
    return kept.join(listed, "anno_idx", "left").withColumn("characters", F.coalesce("characters", F.lit("")))
