from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollcall.plans import chains


def test_anchors(spark):
    cast = spark.createDataFrame([("m", "The Grinch", 0), ("m", "Lillian Deville", 1), ("m", "Boy", 2), ("m", "Zed", 3), ("n", "Lou", 0)], "movie string, character string, billing_pos long")
    pages = spark.createDataFrame([("m", "Grinch", 0), ("m", "Lil DeVille", 1), ("m", "List of Grinch", 2), ("m", "Louise", 3)], "movie string, title string, pos long")
    images = spark.createDataFrame([("m", "Grinch", "u1", "page"), ("m", "Grinch", "u0", "infobox"), ("m", "Lil DeVille", "u2", "infobox")], "movie string, title string, url string, source string")
    out = {(r.movie, r.character): (r.title, r.match, r.url, r.anchor_confidence) for r in chains.character_anchors(cast, pages, images).collect()}
    assert out == {("m", "The Grinch"): ("Grinch", "exact", "u0", "confident"), ("m", "Lillian Deville"): ("Lil DeVille", "fuzzy", "u2", "low"), ("m", "Zed"): (None, None, None, "missing"), ("n", "Lou"): (None, None, None, "missing")}


def test_classify_tracks(spark):
    frames = spark.createDataFrame([("m", "c", 0, s, 1, f, [1.0, float(s)]) for s in (0, 1) for f in range(9)], "movie string, clip string, shot_idx int, set_idx int, track_id int, frame int, feature array<double>")
    bank = spark.createDataFrame([("m", "A", 0, [1.0, 0.0]), ("m", "B", 1, [1.0, 1.0])], "movie string, character string, pos long, feature array<double>")
    out = {r.set_idx: (r.label, r.score) for r in chains.classify_tracks(frames, bank).collect()}
    assert out == {0: ("A", 1.0), 1: ("B", 1.0)}


def test_detection_map(spark):
    s = "image int, x0 double, y0 double, x1 double, y1 double, label string, pos long"
    gt = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0, "Gru", 0), (1, 0.0, 0.0, 5.0, 5.0, "Gru", 1)], s)
    pred = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 49.0, "Gru/x", 0, 0.9), (1, 1.0, 0.0, 50.0, 50.0, "Gru", 1, 0.8)], s + ", score double")
    r = chains.detection_map(pred, gt, ["image"]).first()
    assert r.map == pytest.approx(1.0) and r.n_thresholds == 10


def test_scores(spark):
    seg = spark.createDataFrame([("m", "c", 0, "A", "A", 0.9), ("m", "c", 1, "B", "A", 0.2), ("n", "d", 0, "Nancy", "A", 0.1)], "movie string, clip string, seg_pos int, truth string, label string, score double")
    ev = spark.createDataFrame([("m", "c", 1, "B", 0.5, 0.6, 0)], "movie string, clip string, seg_pos int, label string, synchronization_score double, classification_score double, pos int")
    out = {r.movie: r.ap for r in chains.speech_scores(seg, ev, 0.3).collect()}
    assert out == {"m": 1.0, "n": 1.0, None: 1.0}
    p = spark.createDataFrame([("Despicable Me", "c", s, s, "Agnes Gru", 0.5 + 0.1 * s) for s in range(6)], "movie string, clip string, shot_idx int, frame_idx int, label string, score double")
    t = spark.createDataFrame([("Despicable Me", "c", 5, 5, "Agnes")], "movie string, clip string, shot_idx int, frame_idx int, label string")
    for whole in (True, False):
        r = chains.name_scores(p, t, whole=whole).first()
        assert (r.ap, r.auc) == (1.0, 1.0)


def test_descriptions(spark):
    notes = spark.createDataFrame([(1, "two words"), (2, "one")], "anno_idx int, text string")
    hits = spark.createDataFrame([(1, "p2", 0), (1, "p1", 1), (1, "p2", 2), (2, "p1", 0)], "anno_idx int, person string, pos int")
    roles = spark.createDataFrame([("p1", "Ann"), ("p2", "Bob")], "person string, role string")
    assert [tuple(r) for r in chains.describe_frames(notes, hits, roles).select("anno_idx", "characters").collect()] == [(1, "Bob (red), Ann (green)")]
    assert chains.describe_frames(notes, hits.limit(0), roles).select(F.max("characters")).first()[0] == ""
