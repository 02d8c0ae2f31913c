"""Readers: fixed schemas, aliases of drifting field names coalesced, shapes that fit none rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.joins import require_unique

TRACKS = "array<struct<track_id: int, set_idx: int, track: map<string, array<double>>, label: string, score: double>>"
#: Schemas of the files that the stages exchange.
SCHEMAS = {
    "source_links": "movie string, wiki_link string, imdb_link string, pos long",
    "character_table": "movie string, character string, anchor_confidence string, anchor_source string, page_match string, wiki_page string, anchor_url string",
    "cast_info": "movie string, character string, actor string, billing_pos long",
    "movie_clips": "movie string, year string, clip string",
    "bank": "movie string, character string, exemplar_id string, source string, pos long, feature array<float>",
    "shots": f"clip_idx string, video_idx string, shot_idx int, start_idx int, end_idx int, tracks {TRACKS}, track {TRACKS}, classified_tracks {TRACKS}",
    "key_frame_annotations": "movie_title string, year string, clip_idx string, video_idx string, key_frames array<struct<shot_idx: int, frame_idx: int, bbox_ls: array<array<double>>, labels: array<string>>>",
    "key_frame_predictions": "movie_title string, year string, clip_idx string, video_idx string, predictions array<struct<frame_idx: int, bbox_ls: array<array<double>>, labels: array<string>, cls_scores: array<double>>>",
    "speech_segments": "temporal_range array<double>, start double, `end` double, text string, character string, prediction string, label string, score double",
    "transcripts": "start double, `end` double, text string, speaker string",
}

def either(df: DataFrame, out: str, *names: str) -> DataFrame:
    """One column from the first non-null of its aliases; none of them present is an error."""
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of the columns {names} is there")
    return df.withColumn(out, F.coalesce(*(F.col(n) for n in have))).drop(*(n for n in have if n != out))


def nested_map(spark: SparkSession, path: str, value: str = "string", levels: int = 2, names: tuple[str, ...] = ("movie", "clip")) -> DataFrame:
    """SRC1: a file with one JSON object keyed by `levels` levels of names, as rows: the names and `value` (of a given type)."""
    kind = value
    for _ in range(levels):
        kind = f"map<string, {kind}>"
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("m"))
    keys: list[str] = []
    for name in names[:levels]:
        df = df.select(*keys, F.explode("m").alias(name, "m"))
        keys.append(name)
    return df.withColumnRenamed("m", "value")


def record_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2: a file with one JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC3: an object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str, required: dict[str, str]) -> DataFrame:
    """SRC4: without lines that don't parse or lack a required column of a required type."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    ok = F.col("r._corrupt_record").isNull()
    for name, kind in required.items():
        ok = ok & F.get_json_object("value", f"$.{name}").try_cast(kind).isNotNull()
    return raw.where(ok).select("r.*").drop("_corrupt_record")


def repair_jsonl(spark: SparkSession, path: str, schema: str, required: dict[str, str]) -> None:
    """SRC4: the file's good lines replace it. They are written beside it first, so a failure leaves the old ones."""
    side = path.rstrip("/") + "_repaired"
    tolerant_jsonl(spark, path, schema, required).write.mode("overwrite").json(side)
    spark.read.schema(schema).json(side).write.mode("overwrite").json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC5: with a header; texts may hold line ends and doubled quotes; an unnamed index column is dropped."""
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
    df = spark.read.options(**options).csv(path, schema=schema) if schema else spark.read.options(inferSchema=True, **options).csv(path)
    return df.drop(*(c for c in df.columns if c in ("", "_c0") or c.startswith("Unnamed")))


def csv_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC6: union in the order of paths; columns that a shard lacks are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (csv(spark, p) for p in sorted(paths)))


VECTOR = "character string, exemplar_id string, path string, feature array<float>"


def vector_archives(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: exemplar vectors from .npz files named by the grammar of SRC13 (D-13). Unreadable or not one-dimensional ones raise."""
    import io
    from collections.abc import Iterator

    import pandas as pd

    from rollcall.storage import ship

    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    v = z["feature"]
                if v.ndim != 1:
                    raise ValueError(f"{where}: a vector has {v.ndim} dimensions")
                stem = where.rsplit("/", 1)[-1].removesuffix(".npz")
                name, _, number = stem.rpartition("_")
                rows.append((name or stem, number, where, v.astype(np.float32).tolist()))
            yield pd.DataFrame(rows, columns=["character", "exemplar_id", "path", "feature"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, VECTOR)


def dereference(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """SRC8: (movie, character, paths) with each path's vector; paths without one are dropped."""
    flat = index.select("movie", "character", F.posexplode("paths").alias("pos", "path"))
    return flat.join(vectors.select("path", "feature"), "path")


def frame_bank(rows: DataFrame, ids: str = "ids", roles: str = "roles") -> DataFrame:
    """SRC9: (movie, id, role) from the first row of each movie's table. Pickles are never opened; convert them first."""
    first = rows.groupBy("movie").agg(F.min_by(F.struct(ids, roles), "pos").alias("r"))
    return first.select("movie", F.explode(F.arrays_zip(F.col(f"r.{ids}").alias("id"), F.col(f"r.{roles}").alias("role"))).alias("z")).select("movie", "z.id", "z.role")


def role_bank(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: (imdbid, roles: map of id to role) of a JSON object of lists."""
    rows = nested_map(spark, path, "array<struct<id: string, role: string>>", 1, ("imdbid",))
    return rows.select("imdbid", F.map_from_entries("value").alias("roles"))


MEDIA = ("mp4", "mkv", "avi", "mov", "webm", "wav", "mp3", "jpg", "jpeg", "png")


def media_index(spark: SparkSession, path: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """SRC11: (stem, path) of media files below a folder; two files with one stem are an error. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions))
    return require_unique(files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "path"), ["stem"], "two files for")


def path_parts(df: DataFrame, path: Column, *names: str) -> DataFrame:
    """SRC12: columns from the last parts of a path, the last name being the last part."""
    parts = F.split(path, "/")
    return df.withColumns({n: F.try_element_at(parts, F.lit(i - len(names))) for i, n in enumerate(names)})


def file_name_parts(df: DataFrame, name: Column, greedy: bool = True) -> DataFrame:
    """SRC13: character, idx and whether it is the anchor (idx 0) of image names; other names give nulls.

    The character may hold underscores when greedy, else it ends before the first.
    """
    pattern = rf"^({'.+' if greedy else '[^_]+'})_(\d+)\.(?:jpg|jpeg|png)$"
    idx = F.regexp_extract(name, pattern, 2)
    return df.withColumns({"character": F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), "idx": F.nullif(idx, F.lit("")).cast("int")}).withColumn("is_anchor", F.when(F.col("idx").isNotNull(), F.col("idx") == 0))


def python_literal(column: Column, schema: str) -> Column:
    """SRC14: a list, tuple or dict literal of numbers and quoted names as a typed value; null where it is none."""
    text = F.translate(F.translate(column, "()", "[]"), "'", '"')
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r",\s*\]", "]"), r"\bNone\b", "null"), r"([{,]\s*)(-?\d+)\s*:", r'$1"$2":')
    return F.from_json(text, schema)


def frame_name(folder: Column, idx: Column) -> Column:
    """SRC16: a frame's member name in a tar file."""
    return F.concat(folder, F.lit("/"), F.lpad(idx.cast("string"), 5, "0"), F.lit(".jpg"))


def api_pages(responses: DataFrame) -> DataFrame:
    """SRC18, SRC19: pages of stored API responses (column `body`), whichever batch or continuation they came in; first title wins."""
    pages = F.from_json(F.get_json_object("body", "$.query.pages"), "map<string, struct<pageid: long, title: string, missing: string, categories: array<struct<title: string>>, length: long>>")
    from rollcall.operators.windows import first_occurrence

    flat = responses.select("pos", F.explode(pages).alias("key", "p")).select("pos", "key", "p.*").where("missing is null")
    return first_occurrence(flat, ["title"], "pos").drop("pos", "key", "missing")


def cast_list(responses: DataFrame) -> DataFrame:
    """SRC20: (movie, actor, character, billing_pos) of stored cast answers, in billing order; nameless ones are dropped."""
    edge = "struct<node: struct<name: struct<nameText: struct<text: string>>, characters: array<struct<name: string>>>>"
    edges = F.from_json(F.get_json_object("body", "$.data.title.cast.edges"), f"array<{edge}>")
    rows = responses.select("movie", F.posexplode(edges).alias("p", "e"))
    rows = rows.select("movie", "p", F.trim("e.node.name.nameText.text").alias("actor"), F.posexplode("e.node.characters").alias("q", "c"))
    rows = rows.where("actor <> '' and c.name <> ''")
    return rows.select("movie", "actor", F.col("c.name").alias("character"), (F.col("p") * 1000 + F.col("q")).cast("long").alias("billing_pos"))


def trending_links(html: Column) -> Column:
    """SRC21: targets of links inside a page's first list of trending pages; an empty array where there is none."""
    block = F.regexp_extract(html, r'(?is)<ul[^>]*class="[^"]*trending[^"]*"[^>]*>(.*?)</ul>', 1)
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r'(?i)href="([^"#]+)"'), F.lit(1)))


def first_description(*texts: Column, least: int = 30) -> Column:
    """SRC22: the first of several sources with more than `least` characters."""
    return F.coalesce(*(F.when(F.length(t) > least, t) for t in texts))


def aliases(people: DataFrame) -> DataFrame:
    """SRC24: (person, aliases): label and aliases in lower case as a set."""
    return people.select("person", F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x))).alias("aliases"))


def tracks(shots: DataFrame) -> DataFrame:
    """A row per track of shot records, whichever of the three field names holds them; the map of boxes keyed by int."""
    s = either(either(shots, "clip", "clip_idx", "video_idx"), "tracks", "tracks", "track", "classified_tracks")
    flat = s.select("clip", "shot_idx", "start_idx", "end_idx", F.explode("tracks").alias("t")).select("clip", "shot_idx", "start_idx", "end_idx", "t.*")
    return flat.withColumn("track", F.transform_keys("track", lambda k, _: k.cast("int")))


def track_boxes(shots: DataFrame) -> DataFrame:
    """ARR3: a row per frame of each track: clip, shot_idx, set_idx, track_id, frame, x0, y0, x1, y1."""
    flat = tracks(shots).select("clip", "shot_idx", "set_idx", "track_id", F.explode("track").alias("frame", "b"))
    return flat.select("clip", "shot_idx", "set_idx", "track_id", "frame", *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def speech(segments: DataFrame) -> DataFrame:
    """Speech segments with one start, end, truth and label, whichever names hold them (D-4, D-7)."""
    s = either(either(segments, "label", "label", "prediction"), "truth", "truth", "character")
    if "temporal_range" in s.columns:
        s = s.withColumns({"start": F.coalesce(F.col("start") if "start" in s.columns else F.lit(None), F.col("temporal_range")[0]), "end": F.coalesce(F.col("end") if "end" in s.columns else F.lit(None), F.col("temporal_range")[1])}).drop("temporal_range")
    return s
