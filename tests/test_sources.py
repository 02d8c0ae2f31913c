from __future__ import annotations

import dataclasses
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.functions import registry
from rollcall.operators.joins import IntegrityError
from rollcall.sources import config, readers, writers


def test_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"m1": {"c1": [1, 2]}, "m2": {"c2": []}}))
    rows = readers.nested_map(spark, str(tmp_path / "m.json"), "array<int>").collect()
    assert sorted((r.movie, r.clip, r.value) for r in rows) == [("m1", "c1", [1, 2]), ("m2", "c2", [])]
    (tmp_path / "a.json").write_text(json.dumps([{"movie_title": "m", "clip_idx": "c", "key_frames": [{"shot_idx": 1, "frame_idx": 2, "bbox_ls": [[0, 0, 1, 1]], "labels": ["x"]}]}]))
    r = readers.record_array(spark, str(tmp_path / "a.json"), readers.SCHEMAS["key_frame_annotations"]).first()
    assert r.key_frames[0].labels == ["x"] and r.year is None
    (tmp_path / "l.jsonl").write_text('{"video_idx": "v", "shot_idx": 1}\n\n{"video_idx": "w", "shot_idx": "bad"}\n{broken\n{"shot_idx": 2}\n')
    good = readers.tolerant_jsonl(spark, str(tmp_path / "l.jsonl"), "video_idx string, shot_idx int", {"video_idx": "string", "shot_idx": "int"})
    assert [tuple(r) for r in good.collect()] == [("v", 1)]
    readers.repair_jsonl(spark, str(tmp_path / "l.jsonl"), "video_idx string, shot_idx int", {"video_idx": "string", "shot_idx": "int"})
    assert readers.jsonl(spark, str(tmp_path / "l.jsonl"), "video_idx string, shot_idx int").count() == 1


def test_aliases(spark):
    box = {"3": [0.0, 1.0, 2.0, 3.0], "10": [4.0, 5.0, 6.0, 7.0]}
    rows = [{"video_idx": "v", "shot_idx": 0, "start_idx": 5, "end_idx": 9, "classified_tracks": [{"track_id": 1, "set_idx": 0, "track": box, "label": "A", "score": 0.5}]}]
    df = spark.createDataFrame(rows, readers.SCHEMAS["shots"])
    assert sorted((r.clip, r.frame, r.x0) for r in readers.track_boxes(df).collect()) == [("v", 3, 0.0), ("v", 10, 4.0)]
    with pytest.raises(ValueError, match="none of"):
        readers.either(df, "z", "q")
    s = spark.createDataFrame([{"temporal_range": [1.0, 2.0], "prediction": "A", "character": "B"}], readers.SCHEMAS["speech_segments"])
    r = readers.speech(s).first()
    assert (r.start, r.end, r.label, r.truth) == (1.0, 2.0, "A", "B")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(0, 'say "hi",\nthere', 1.5), (1, None, 2.5)], "i int, text string, x double")
    writers.by_extension(df, str(tmp_path / "o.csv"))
    assert [r.text for r in readers.csv(spark, str(tmp_path / "o.csv")).orderBy("x").collect()] == ['say "hi",\nthere', None]
    writers.write_csv(df, str(tmp_path / "p.csv"), index="i")
    assert readers.csv(spark, str(tmp_path / "p.csv")).columns == ["text", "x"]
    writers.write_csv(df.select("x"), str(tmp_path / "q.csv"))
    both = readers.csv_shards(spark, [str(tmp_path / "p.csv"), str(tmp_path / "q.csv")])
    assert both.count() == 4 and both.where("text is null").count() == 3
    writers.by_extension(df, str(tmp_path / "o.json"))
    assert spark.read.json(str(tmp_path / "o.json")).count() == 2


def test_vectors(spark, tmp_path):
    for name, v in (("a_b_0", np.ones(3)), ("c_12", np.zeros(3))):
        buffer = io.BytesIO()
        np.savez(buffer, feature=v)
        (tmp_path / f"{name}.npz").write_bytes(buffer.getvalue())
    out = readers.vector_archives(spark, str(tmp_path))
    assert sorted((r.character, r.exemplar_id, r.feature) for r in out.collect()) == [("a_b", "0", [1.0] * 3), ("c", "12", [0.0] * 3)]
    index = spark.createDataFrame([("m", "a", [f"file:{tmp_path}/a_b_0.npz", "missing"])], "movie string, character string, paths array<string>")
    assert readers.dereference(index, out).count() == 1
    buffer = io.BytesIO()
    np.savez(buffer, feature=np.ones((2, 2)))
    (tmp_path / "bad_1.npz").write_bytes(buffer.getvalue())
    with pytest.raises(Exception, match="dimensions"):
        readers.vector_archives(spark, str(tmp_path)).collect()


def test_media(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for f in ("x/one.MP4", "two.wav", "skip.txt"):
        (tmp_path / f).write_bytes(b"1")
    assert sorted(r.stem for r in readers.media_index(spark, str(tmp_path)).collect()) == ["one", "two"]
    (tmp_path / "one.mkv").write_bytes(b"1")
    with pytest.raises(IntegrityError):
        readers.media_index(spark, str(tmp_path))


def test_expressions(spark):
    df = spark.createDataFrame([("/d/m/actor/clip.wav", "Mr_X_0.png", "[(1, 2), (3, 4)]", "{7: [(0, 1)]}")], "path string, name string, lit string, ids string")
    r = readers.path_parts(df, F.col("path"), "movie", "actor", "file").first()
    assert (r.movie, r.actor, r.file) == ("m", "actor", "clip.wav")
    r = readers.file_name_parts(df, F.col("name")).first()
    assert (r.character, r.idx, r.is_anchor) == ("Mr_X", 0, True)
    assert readers.file_name_parts(df, F.col("name"), greedy=False).first().character is None
    r = df.select(readers.python_literal(F.col("lit"), "array<array<int>>"), readers.python_literal(F.col("ids"), "map<string, array<array<int>>>"), readers.frame_name(F.lit("d"), F.lit(7))).first()
    assert tuple(r) == ([[1, 2], [3, 4]], {"7": [[0, 1]]}, "d/00007.jpg")
    html = F.lit('<ul class="x trending y"><li><a href="/a">A</a><a href="/a">A</a></li></ul><a href="/z">')
    r = spark.range(1).select(readers.trending_links(html), readers.trending_links(F.lit("")), readers.first_description(F.lit("short"), F.lit("y" * 31))).first()
    assert tuple(r) == (["/a"], [], "y" * 31)
    body = json.dumps({"data": {"title": {"cast": {"edges": [{"node": {"name": {"nameText": {"text": "Act"}}, "characters": [{"name": "A"}, {"name": "B"}]}}]}}}})
    cast = readers.cast_list(spark.createDataFrame([("m", body)], "movie string, body string")).orderBy("billing_pos").collect()
    assert [(r.actor, r.character) for r in cast] == [("Act", "A"), ("Act", "B")]
    pages = [(i, json.dumps({"query": {"pages": {str(k): {"title": f"t{k}"}, "-1": {"title": "no", "missing": ""}}}})) for i, k in enumerate((1, 2, 1))]
    assert sorted(r.title for r in readers.api_pages(spark.createDataFrame(pages, "pos int, body string")).collect()) == ["t1", "t2"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m1", "c1", 1), ("m1", "c2", 2), ("m2", "c3", 3)], "movie string, clip string, v int")
    writers.nested_json(df, str(tmp_path / "n"), ["movie", "clip"], "v")
    text = "".join(p.read_text() for p in (tmp_path / "n").glob("part-*"))
    assert json.loads(text) == {"m1": {"c1": 1, "c2": 2}, "m2": {"c3": 3}}
    for _ in range(2):
        writers.append_jsonl(df, str(tmp_path / "log"), "movie")
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert writers.done_units(spark, str(tmp_path / "done"), "clip string").count() == 0
    writers.mark_done(df.select("clip").limit(2), str(tmp_path / "done"))
    writers.mark_done(df.select("clip").limit(1), str(tmp_path / "done"))
    assert writers.done_units(spark, str(tmp_path / "done"), "clip string").count() == 2
    writers.write_bank(df, str(tmp_path / "bank"))
    assert spark.read.parquet(str(tmp_path / "bank")).where("movie = 'm1'").count() == 2


@dataclasses.dataclass(frozen=True)
class Model:
    width: int = 8
    rate: float = 0.1


@dataclasses.dataclass(frozen=True)
class Settings:
    name: str = "x"
    fast: bool = False
    model: Model = Model()


def test_config():
    c = config.load(Settings(), {"model": {"width": 16}, "fast": True}, ["model.rate=1", "name=y"])
    assert c == Settings("y", True, Model(16, 1.0))
    with pytest.raises(KeyError):
        config.load(Settings(), {"model": {"depth": 1}})
    with pytest.raises(TypeError):
        config.load(Settings(), {"model": {"width": 1.5}})
    with pytest.raises(ValueError):
        config.load(Settings(), None, ["name"])


def test_registry(spark):
    registry.register("summarise", lambda: lambda text: text.str.upper())
    df = spark.createDataFrame([("a", "m")], "text string, movie string")
    assert df.select(registry.model("summarise")("text").alias("s")).first().s == "A"
    with pytest.raises(KeyError):
        registry.register("nothing", lambda: None)
    assert registry.mel(np.zeros(16000)).shape == (99, 80)
    r = spark.range(1).select(registry.whole_shot(F.array().cast("array<struct<start:int,end:int>>"), F.lit(9)).alias("s")).first()
    assert [tuple(x) for x in r.s] == [(0, 9)]
    registry.register_dataset("d", dict)
    assert registry.dataset("d") is dict
    with pytest.raises(KeyError):
        registry.dataset("e")
