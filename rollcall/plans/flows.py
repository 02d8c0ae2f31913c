"""Queries of the chains of stages, of files written and read back, of stored service answers and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import windows as W
from rollcall.plans import chains
from rollcall.plans.inventory import _frames
from rollcall.plans.recognition import Q24
from rollcall.plans.tables import SEGMENTS_SQL, boxes, segments, table
from rollcall.sources import readers as S
from rollcall.sources import writers as O
from rollcall.storage import new_path
from rollcall.streaming import operators as T


def q52_chain_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of characters: brands are movies, part names their credits, some abbreviated or generic; pages and images by part number."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("movie"), F.col("p_name").alias("n"), F.col("p_partkey").alias("k"))
    short = F.array_join(F.transform(F.split("n", " "), lambda w: F.substring(w, 1, 4)), " ")
    name = F.when(F.col("k") % 5 == 0, F.lit("Narrator")).when(F.col("k") % 3 == 0, short).otherwise(F.concat(F.lit("The "), F.initcap("n")))
    cast = p.select("movie", name.alias("character"), F.col("k").alias("billing_pos"))
    title = F.when(F.col("k") % 7 == 0, F.concat("n", F.lit(" gallery"))).otherwise(F.col("n"))
    pages = p.where("k % 2 = 0").select("movie", title.alias("title"), F.col("k").alias("pos"))
    images = p.where("k % 4 = 0").groupBy("movie", F.col("n").alias("title"), F.when(F.col("k") % 8 == 0, "infobox").otherwise("page").alias("source")).agg(F.min("k").cast("string").alias("url"))
    return chains.character_anchors(cast, pages, images)


Q52 = """WITH p AS (SELECT p_brand AS movie, p_name AS n, p_partkey AS k FROM part),
c AS (SELECT movie, k, n, CASE WHEN k % 3 = 0 THEN array_to_string([x[1:4] for x in string_split(n, ' ')], ' ') ELSE 'The ' || array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(n, ' ')], ' ') END AS character FROM p WHERE k % 5 > 0),
r AS (SELECT *, lower(CASE WHEN character LIKE 'The %' THEN character[5:] ELSE character END) AS key FROM c QUALIFY row_number() OVER (PARTITION BY movie, character ORDER BY k) = 1),
g AS (SELECT movie, n AS title, min(k) AS pos FROM p WHERE k % 2 = 0 AND k % 7 > 0 GROUP BY 1, 2),
e AS (SELECT r.movie, character, title FROM r JOIN g ON g.movie = r.movie AND g.title = r.key),
f AS (SELECT r.movie, character, arg_min(title, (length(title), pos)) AS title FROM r JOIN g ON g.movie = r.movie WHERE (r.movie, character) NOT IN (SELECT (movie, character) FROM e)
  AND len(list_filter(string_split(key, ' '), lambda a: len(list_filter(string_split(title, ' '), lambda b: starts_with(b, a) OR starts_with(a, b))) = 0)) = 0 GROUP BY 1, 2),
m AS (SELECT *, 'exact' AS match FROM e UNION ALL SELECT *, 'fuzzy' FROM f),
i AS (SELECT movie, n AS title, CASE WHEN k % 8 = 0 THEN 'infobox' ELSE 'page' END AS source, min(k) AS url FROM p WHERE k % 4 = 0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY movie, title ORDER BY source) = 1)
SELECT r.movie, r.character, r.k AS billing_pos, m.title, match, url::VARCHAR AS url, source, CASE WHEN url IS NULL THEN 'missing' WHEN source = 'infobox' AND match = 'exact' THEN 'confident' ELSE 'low' END AS anchor_confidence
FROM r LEFT JOIN m ON m.movie = r.movie AND m.character = r.character LEFT JOIN i ON i.movie = m.movie AND i.title = m.title"""


def q53_chain_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of up to four vectors, one in five of all, classified by a bank of the others: best frame of each track."""
    e = table(spark, sf_dir, "embeddings")
    seen, known = e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0")
    k = F.floor(F.col("vec_id") / 20)
    frames = seen.select(F.lit("m").alias("movie"), (k % 3).cast("string").alias("clip"), F.lit(0).alias("shot_idx"), F.lit(0).alias("set_idx"), k.alias("track_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("feature"))
    bank = known.select(F.lit("m").alias("movie"), F.col("label").cast("string").alias("character"), F.col("label").cast("long").alias("pos"), F.col("embedding").alias("feature"))
    return chains.classify_tracks(frames, bank).select("clip", "track_id", "label", "score")


Q53 = """WITH s AS (SELECT q.vec_id AS q, q.vec_id // 20 AS k, b.label, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings b ON q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
t AS (SELECT k, label, max(score) AS score FROM (SELECT q, k, label, round(avg(sim), 6) AS score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY sim DESC) <= 3) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT (k % 3)::VARCHAR AS clip, k AS track_id, arg_max(label, (score, -label))::VARCHAR AS label, max(score) AS score FROM t GROUP BY k"""


def q54_chain_detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision of boxes by the whole chain; labels carry a suffix that the chain removes."""
    b = boxes(spark, sf_dir)
    rank = F.row_number().over(W.Window.partitionBy("image").orderBy("pos"))
    b = b.withColumn("pos", F.col("image") * 1000 + rank).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    truth = b.where("line % 2 = 0").select("image", "x0", "y0", "x1", "y1", "label", "pos")
    seen = b.select("image", "x0", "y0", "x1", "y1", F.concat("label", F.lit("/a")).alias("label"), "score", "pos")
    return chains.detection_map(seen, truth, ["image"]).select(F.round("map", 4).alias("map"), "n_thresholds")


Q54 = f"SELECT round(avg(ap), 4) AS map, count(*) AS n_thresholds FROM ({Q24})"


def q55_chain_speech_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of speech labels per movie and in total, after fusion with what was seen one segment before."""
    s = segments(spark, sf_dir).withColumn("movie", (F.col("clip") % 4).cast("string"))
    heard = s.select("movie", "clip", "seg_pos", F.when(F.col("seg_pos") % 3 == 0, "Nancy").otherwise(F.col("label")).alias("truth"), "label", F.round(F.col("value") / 490, 4).alias("score"))
    seen = s.select("movie", "clip", "seg_pos", "label", F.lit(0.5).alias("synchronization_score"), F.round(F.col("value") / 250, 4).alias("classification_score"), F.col("seg_pos").alias("pos"))
    return chains.speech_scores(heard, seen.where("seg_pos % 2 = 0"), 0.2).select("movie", F.round("ap", 6).alias("ap"))


Q55 = f"""WITH {SEGMENTS_SQL}, h AS (SELECT (clip % 4)::VARCHAR AS movie, CASE WHEN seg_pos % 3 = 0 THEN 'Other' ELSE label END AS truth, label, round(value / 490, 4) AS score FROM segments),
o AS (SELECT movie, CASE WHEN score <= 0.15 THEN 'Other' ELSE label END = truth AS hit, CASE WHEN score <= 0.15 THEN (1 - score) * 0.15::DOUBLE ELSE score END AS score FROM h),
k AS (SELECT movie, score, sum(hit::INT) AS tp, count(*) AS n FROM o GROUP BY GROUPING SETS ((movie, score), (score))),
w AS (SELECT movie, tp, sum(tp) OVER x AS tps, sum(n) OVER x AS ns, sum(tp) OVER (PARTITION BY movie) AS total FROM k WINDOW x AS (PARTITION BY movie ORDER BY score DESC))
SELECT movie, round(coalesce(sum(tp / nullif(total, 0)::DOUBLE * (tps / ns::DOUBLE)), 0), 6) AS ap FROM w GROUP BY movie"""


def q56_chain_name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of segments of three shots against the truth, over all segments together."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("movie"), F.col("user_id").alias("clip"), (F.col("event_id") % 12).alias("shot_idx"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("label"), F.round("value", 2).alias("score"))
    return chains.name_scores(e.where("frame_idx % 5 > 0"), e.where("frame_idx % 2 = 0").drop("score")).select(F.round("ap", 6).alias("ap"), F.round("auc", 6).alias("auc"))


Q56 = """WITH e AS (SELECT user_id AS c, event_id % 12 AS shot, event_id AS k, event_type AS label, round(value, 2) AS score FROM events WHERE event_id % 5 > 0 OR event_id % 2 = 0),
g AS (SELECT u.c, u.shot // 3 AS seg, v.label, CASE WHEN u.label = v.label AND u.k % 5 > 0 THEN u.score ELSE 0 END AS score, (u.label = v.label AND u.k % 2 = 0)::INT AS truth FROM e u JOIN (SELECT DISTINCT c, label FROM e) v USING (c)),
p AS (SELECT c, seg, label, max(score) AS score, max(truth) AS hit FROM g GROUP BY 1, 2, 3), k AS (SELECT score, sum(hit) AS tp, count(*) AS n FROM p GROUP BY score),
w AS (SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS tps, sum(n) OVER (ORDER BY score DESC) AS ns, sum(tp) OVER () AS total FROM k),
r AS (SELECT hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2::DOUBLE AS r FROM p)
SELECT (SELECT round(sum(tp / total::DOUBLE * (tps / ns::DOUBLE)), 6) FROM w) AS ap, (SELECT round((sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2::DOUBLE) / (sum(hit) * sum(1 - hit)), 6) FROM r) AS auc"""


def q57_chain_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character lists of texts of fit length: people of a turn in the order of their first event, with colours and roles."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("anno_idx"), "text")
    e = table(spark, sf_dir, "events")
    hits = c.select("anno_idx", (F.col("anno_idx") % 150).alias("user_id")).join(e, "user_id").select("anno_idx", F.col("event_type").alias("person"), F.col("event_id").alias("pos"))
    roles = e.select(F.col("event_type").alias("person"), F.initcap("event_type").alias("role")).distinct()
    return chains.describe_frames(c, hits, roles)


Q57 = r"""WITH c AS (SELECT conv_id * 100 + turn AS k, text, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w FROM conversations),
f AS (SELECT user_id AS u, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS i FROM events GROUP BY 1, 2),
l AS (SELECT u, string_agg(upper(t[1]) || t[2:] || ' (' || ['red', 'green', 'blue', 'yellow', 'pink', 'cyan', 'white', 'black'][i] || ')', ', ' ORDER BY i) AS characters FROM f GROUP BY u)
SELECT k AS anno_idx, text, coalesce(characters, '') AS characters FROM c LEFT JOIN l ON l.u = k % 150 WHERE w > 1 AND w < 64 AND length(text) < 250"""


def q58_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written in each file format and read back: every row comes back once from each."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "text")
    kind, base = "conv string, turn string, text string", new_path(spark, "files")
    O.nested_json(c, f"{base}/nested", ["conv", "turn"], "text")
    O.append_jsonl(c.where("conv % 2 = 0"), f"{base}/lines")
    O.append_jsonl(c.where("conv % 2 = 1"), f"{base}/lines")
    O.write_csv(c.withColumn("pos", F.monotonically_increasing_id()), f"{base}/a.csv", "pos")
    O.by_extension(c.where("conv % 2 = 0"), f"{base}/b.csv")
    O.by_extension(c.where("conv % 2 = 1"), f"{base}/c.json")
    c.groupBy().agg(F.to_json(F.collect_list(F.struct(*c.columns))).alias("value")).write.text(f"{base}/array")  # a report's size
    broken = c.select(F.to_json(F.struct(*c.columns)).alias("value")).unionByName(spark.createDataFrame([("{\"conv\": \"1\", \"tu",), ('{"conv": "x", "text": "no turn"}',), ("",)], "value string"))
    broken.write.text(f"{base}/broken")
    S.repair_jsonl(spark, f"{base}/broken", kind, {"turn": "long"})
    O.write_bank(c.select(F.col("conv").alias("movie"), "turn", "text"), f"{base}/bank")
    O.mark_done(c.select("conv", "turn", "text"), f"{base}/done")
    ids = c.groupBy(F.col("conv").alias("imdbid")).agg(F.collect_list(F.struct(F.col("turn").alias("id"), F.col("text").alias("role"))).alias("v"))
    O.nested_json(ids, f"{base}/roles", ["imdbid"], "v")
    read = {
        "nested": S.nested_map(spark, f"{base}/nested", names=("conv", "turn")).withColumnRenamed("value", "text"),
        "lines": S.jsonl(spark, f"{base}/lines", kind),
        "csv": S.csv(spark, f"{base}/a.csv", "pos long, conv string, turn string, text string").drop("pos"),
        "shards": S.csv_shards(spark, [f"{base}/b.csv"]).withColumns({"conv": F.col("conv").cast("string"), "turn": F.col("turn").cast("string")}).unionByName(S.jsonl(spark, f"{base}/c.json", kind)),
        "array": S.record_array(spark, f"{base}/array", kind),
        "repaired": S.tolerant_jsonl(spark, f"{base}/broken", kind, {"conv": "long"}),
        "bank": spark.read.schema("turn string, text string, movie string").parquet(f"{base}/bank").withColumnRenamed("movie", "conv"),
        "done": O.done_units(spark, f"{base}/done", kind),
        "roles": S.role_bank(spark, f"{base}/roles").select(F.col("imdbid").alias("conv"), F.explode("roles").alias("turn", "text")),
    }
    out = W.bag_union(*(df.select(F.lit(name).alias("kind"), "conv", "turn", F.sha2("text", 256).alias("text")) for name, df in read.items()))
    none = O.done_units(spark, f"{base}/absent", kind).groupBy().agg(F.count("*").alias("absent"))
    return out.join(F.broadcast(none))


Q58 = "SELECT kind, conv_id::VARCHAR AS conv, turn::VARCHAR AS turn, sha256(text) AS text, 0::BIGINT AS absent FROM conversations, (SELECT unnest(['nested', 'lines', 'csv', 'shards', 'array', 'repaired', 'bank', 'done', 'roles']) AS kind)"


def q59_stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers of services as JSON: pages in batches, cast lists, records of shots with their three spellings."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey")).alias("r"))
    page = lambda title: F.struct(F.col("k").alias("pageid"), title.alias("title"), F.when(F.col("k") % 5 == 0, "").alias("missing"), (F.col("k") * 10).alias("length"))
    twice = n.select("k", "r", page(F.col("name")).alias("p")).unionByName(n.select((F.col("k") + 100).alias("k"), (F.col("r") + 10).alias("r"), page(F.col("name")).alias("p")))
    bodies = twice.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), "p"))).alias("pages"))
    pages = S.api_pages(bodies.select(F.col("r").alias("pos"), F.to_json(F.struct(F.struct("pages").alias("query"))).alias("body")))
    pages = pages.select(F.lit("page").alias("kind"), F.col("title").alias("a"), F.col("pageid").cast("string").alias("b"), F.col("length").alias("n"))
    node = F.struct(F.struct(F.struct(F.col("name").alias("text")).alias("nameText")).alias("name"), F.array(F.struct(F.concat(F.lit("R"), F.col("k").cast("string")).alias("name")), F.struct(F.when(F.col("k") % 2 == 0, "Z").otherwise("").alias("name"))).alias("characters"))
    answer = n.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", node.alias("node")))), lambda s: F.struct(s["node"].alias("node"))).alias("edges"))
    cast = S.cast_list(answer.select(F.col("r").cast("string").alias("movie"), F.to_json(F.struct(F.struct(F.struct(F.struct("edges").alias("cast")).alias("title")).alias("data"))).alias("body")))
    cast = cast.select(F.concat(F.lit("cast"), "movie").alias("kind"), F.col("actor").alias("a"), F.col("character").alias("b"), F.col("billing_pos").alias("n"))
    f = _frames(spark, sf_dir).where("set_idx = 1")
    track = f.groupBy("shot", "track_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.array("x0", "y0", "x1", "y1")))).alias("track"))
    one = F.struct(F.col("track_id"), F.lit(1).alias("set_idx"), "track", F.lit("x").alias("label"), F.lit(0.5).alias("score"))
    shots = track.groupBy("shot").agg(F.collect_list(one).alias("t"))
    pick = lambda i: F.when(F.col("shot") % 3 == i, F.col("t"))
    shots = shots.select(F.when(F.col("shot") % 2 == 0, F.col("shot").cast("string")).alias("clip_idx"), F.when(F.col("shot") % 2 == 1, F.col("shot").cast("string")).alias("video_idx"), F.lit(0).alias("shot_idx"), F.lit(0).alias("start_idx"), F.lit(1).alias("end_idx"), pick(0).alias("tracks"), pick(1).alias("track"), pick(2).alias("classified_tracks"))
    rows = S.track_boxes(shots).groupBy("clip").agg(F.count("*").alias("n"), F.sum(F.col("x1") * F.col("frame")).alias("s"))
    rows = rows.select(F.lit("boxes").alias("kind"), F.col("clip").alias("a"), F.col("s").cast("long").cast("string").alias("b"), F.col("n"))
    speech = segments(spark, sf_dir).select(F.when(F.col("seg_pos") % 2 == 0, F.array(F.col("start").cast("double"), F.col("end").cast("double"))).alias("temporal_range"), F.when(F.col("seg_pos") % 2 == 1, F.col("start").cast("double")).alias("start"), F.when(F.col("seg_pos") % 2 == 1, F.col("end").cast("double")).alias("end"), F.when(F.col("seg_pos") % 3 == 0, F.col("label")).alias("label"), F.when(F.col("seg_pos") % 3 > 0, F.col("label")).alias("prediction"), F.col("label").alias("character"))
    said = S.speech(speech).groupBy("label").agg(F.count_if(F.col("truth") == F.col("label")).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").cast("string").alias("b"))
    said = said.select(F.lit("speech").alias("kind"), F.col("label").alias("a"), "b", "n")
    return pages.unionByName(cast).unionByName(rows).unionByName(said)


Q59 = f"""WITH {SEGMENTS_SQL}, f AS (SELECT l_orderkey % 200 AS shot, (l_orderkey // 200) % 4 AS track_id, dayofyear(l_shipdate)::INT % 40 AS frame, min(l_partkey % 20) + 30 + max(l_quantity::BIGINT) AS x1 FROM lineitem WHERE l_orderkey % 3 = 1 GROUP BY 1, 2, 3)
SELECT 'page' AS kind, n_name AS a, n_nationkey::VARCHAR AS b, (n_nationkey * 10)::BIGINT AS n FROM nation WHERE n_nationkey % 5 > 0
UNION ALL SELECT 'cast' || n_regionkey, n_name, b, (1000 * p + q)::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p FROM nation),
  LATERAL (SELECT 'R' || n_nationkey AS b, 0 AS q UNION ALL SELECT 'Z', 1 WHERE n_nationkey % 2 = 0)
UNION ALL SELECT 'boxes', shot::VARCHAR, sum(x1 * frame)::BIGINT::VARCHAR, count(*) FROM f GROUP BY shot
UNION ALL SELECT 'speech', label, sum(fin - start)::BIGINT::VARCHAR, count(*) FROM segments GROUP BY label"""


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of one micro-batch. The file source wants a folder, so the table is written to one."""
    path = new_path(spark, "source")
    table(spark, sf_dir, name).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives until its source is read up."""
    out = new_path(stream.sparkSession, "sink")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def q60_stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log and restarted, worked off in batches with failures set apart, seen ones dropped, counted by window."""
    e = _stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    log, state = new_path(spark, "log"), new_path(spark, "state")
    for _ in range(2):  # the second start finds nothing new
        T.append_log(e.select("event_id", "event_type"), log, state).awaitTermination()
    logged = spark.read.schema("event_id long, event_type string").json(log).select(F.lit("log").alias("kind"), F.col("event_type").alias("a"), F.col("event_id").alias("n"))
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    work = lambda df: df.select("event_id", "event_type", F.when(F.col("event_id") % 10 == 0, "odd").alias("error"))
    T.process_units(e, work, good, bad, new_path(spark, "state")).awaitTermination()
    worked = W.bag_union(*(spark.read.parquet(p).select(F.lit(k).alias("kind"), F.col("event_type").alias("a"), F.col("event_id").alias("n")) for k, p in (("good", good), ("bad", bad))))
    seen = _drained(T.drop_seen(e.select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "60 days"))
    seen = seen.select(F.lit("first").alias("kind"), F.col("event_type").alias("a"), F.col("user_id").alias("n"))
    counted = _drained(T.frame_windows(e.select("event_type", "at"), ["event_type"], "at", "1 day", "1 day"))
    counted = counted.select(F.concat(F.lit("day"), F.date_format("window.start", "dd")).alias("kind"), F.col("event_type").alias("a"), "n")
    out = W.bag_union(logged, worked, seen, counted)
    return out.groupBy("kind", "a").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))


Q60 = """WITH e AS (SELECT event_id, event_type AS a, user_id, ts FROM events),
u AS (SELECT 'log' AS kind, a, event_id AS n FROM e UNION ALL SELECT CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE 'good' END, a, event_id FROM e UNION ALL SELECT DISTINCT 'first', a, user_id FROM e
  UNION ALL SELECT 'day' || strftime(date_trunc('day', ts), '%d'), a, count(*) FROM e WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM e) GROUP BY date_trunc('day', ts), a)
SELECT kind, a, count(*) AS rows, sum(n)::BIGINT AS total FROM u GROUP BY 1, 2"""


def q61_stream_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of a stream of vectors by label, in the order of their ids."""
    s = _stream(spark, sf_dir, "embeddings").select(F.col("label").alias("movie"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("feature"))
    return _drained(T.online_speakers(s))


Q61 = """WITH RECURSIVE e AS (SELECT label AS movie, vec_id AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT a.movie, a.k, list(b.k) AS near FROM e a JOIN e b ON a.movie = b.movie AND b.k < a.k AND list_cosine_similarity(a.v, b.v) > 0.25 GROUP BY 1, 2),
s AS (SELECT movie, 1 AS k, [0]::BIGINT[] AS c FROM e WHERE k = 1
  UNION ALL SELECT s.movie, s.k + 1, list_append(s.c, coalesce(list_min(list_transform(n.near, lambda i: s.c[i])), list_max(s.c) + 1)) FROM s JOIN e ON e.movie = s.movie AND e.k = s.k + 1 LEFT JOIN n ON n.movie = s.movie AND n.k = s.k + 1),
f AS (SELECT movie, arg_max(c, k) AS c FROM s GROUP BY movie) SELECT e.movie, e.pos, f.c[e.k]::INT AS cluster FROM e JOIN f USING (movie)"""


def q62_stream_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident hits that join their character's bank, and items unlike all kept before, from streams of orders and parts."""
    o = _stream(spark, sf_dir, "orders").select(F.lit("m").alias("movie"), (F.col("o_custkey") % 20).cast("string").alias("character"), F.col("o_orderkey").cast("string").alias("exemplar_id"), (F.col("o_totalprice") / 500000).alias("score"))
    bank = _drained(T.grow_bank(o, least=0.4, most=12)).select(F.lit("bank").alias("kind"), F.col("character").alias("a"), F.col("exemplar_id").cast("long").alias("n"))
    p = _stream(spark, sf_dir, "part").select(F.col("p_brand").alias("movie"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 37 % 4096).alias("code"))
    kept = _drained(T.drop_near_seen(p, "movie", most=2)).select(F.lit("kept").alias("kind"), F.col("movie").alias("a"), F.col("pos").alias("n"))
    return bank.unionByName(kept)


Q62 = """WITH RECURSIVE p AS (SELECT p_brand AS b, p_partkey AS k, (p_partkey * 37) % 4096 AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
s AS (SELECT b, 1 AS i, [c] AS kept, true AS keep FROM p WHERE i = 1
  UNION ALL SELECT b, i, CASE WHEN keep THEN list_append(kept, c) ELSE kept END, keep FROM (SELECT p.b, p.i, kept, p.c, len(list_filter(kept, lambda x: bit_count(xor(x, p.c)) <= 2)) = 0 AS keep FROM s JOIN p ON p.b = s.b AND p.i = s.i + 1))
SELECT 'kept' AS kind, p.b AS a, p.k AS n FROM p JOIN s ON s.b = p.b AND s.i = p.i AND s.keep
UNION ALL (SELECT 'bank', (o_custkey % 20)::VARCHAR, o_orderkey FROM orders WHERE o_totalprice / 500000 >= 0.4 QUALIFY row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) <= 12)"""
