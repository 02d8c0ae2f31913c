"""Queries of the row rules, lookups, aggregates and set operations that the other modules' queries do not call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import boxes as G
from rollcall.functions import registry as R
from rollcall.functions import text as X
from rollcall.functions import vectors as V
from rollcall.operators import aggregates as A
from rollcall.operators import clustering as K
from rollcall.operators import filters as L
from rollcall.operators import joins as J
from rollcall.operators import matching as H
from rollcall.operators import windows as W
from rollcall.plans.tables import BOXES_SQL, SEGMENTS_SQL, boxes, segments, table
from rollcall.sources import readers as S


def _pick(number: Column, *values: Column | str | None) -> Column:
    """The value at a number modulo how many there are."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def q40_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits, titles, file names and links made of part names, and what each text rule says of them."""
    k, name = F.col("p_partkey"), F.col("p_name")
    credit = _pick(k, F.concat(name, F.lit(" (voice)")), F.concat(name, F.lit("(voice) / Other")), "Additional voices (voice)", "(voice)", "Narrator", "Guard #2", F.concat(name, F.lit(" (uncredited)")), "the villager")
    title = _pick(k, F.concat(F.lit("List of "), name), F.concat(name, F.lit("/x")), F.concat(name, F.lit(" gallery")), name, F.concat(F.lit("File:"), name), F.concat(name, F.lit(" (species)")))
    image = _pick(k, F.concat(name, F.lit("_"), (k % 3).cast("string"), F.lit(".jpg")), "a_b_0.png", "noidx.jpg", "x_1.gif")
    link = _pick(k, F.concat(F.lit("https://x.org/title/tt"), k.cast("string"), F.lit("/?ref=tt9")), None, "https://x.org/none")
    wikitext = _pick(k, F.concat(F.lit("{{Infobox\n| image = [[File:"), name, F.lit(".png|200px]]")), "{{Infobox\n| title = x}}", None)
    out = table(spark, sf_dir, "part").select(
        "p_partkey", X.drop_voice_suffix(credit).alias("dropped"), X.drop_voice_suffix(credit, True).alias("dropped_spaced"), X.voiced_role(credit).alias("role"), X.generic_role(credit).alias("generic"),
        X.junk_title(title).alias("junk"), X.title_id(link).alias("title_id"), X.search_query(name, F.col("p_brand")).alias("query"), X.infobox_file(wikitext).alias("file"),
        X.chrome_file(_pick(k, "Site-logo.png", "Portrait.png", "Award 1.jpg", "Editor.png")).alias("chrome"),
        X.repair_output(_pick(k, "{'summarised_AD': 'He runs.'}", "{plain}", "1. Main characters: x", "ok")).alias("repaired"), X.unstable_output(F.repeat(name, (k % 300).cast("int"))).alias("unstable"),
        X.fill_template("{a} in {b}!", a=name, b=_pick(k, F.col("p_brand"), None)).alias("prompt"), X.character_list(F.array(name, F.col("p_brand")), F.array(F.lit("red"), F.lit("blue"))).alias("characters"),
        S.frame_name(F.col("p_brand"), k).alias("frame"), S.first_description(_pick(k, None, "short"), F.repeat(name, 5)).alias("description"),
        L.movie_alias(_pick(k, "Despicable Me", "Coraline"), _pick(k, "Agnes", "Gru", "Bob")).alias("movie_alias"), L.clean_truth(_pick(k, "Felonious Gru", "Nancy", "X")).alias("truth"),
        L.in_subset(_pick(k, "Coraline", "Sing", "Nothing")).alias("in_subset"), L.speaker(_pick(k, None, "S1")).alias("speaker"), L.encode_row("p_partkey", "p_size").alias("json"),
        L.nested_get(F.to_json(F.struct(F.struct(F.col("p_size").alias("b")).alias("a"))), "a.b", F.lit("none")).alias("found"), L.nested_get(F.lit('{"a": 1}'), "a.b", F.lit("none")).alias("missing"),
        S.python_literal(F.concat(F.lit("("), k.cast("string"), F.lit(", 2,)")), "array<long>")[0].alias("literal"), F.size(S.python_literal(F.lit("{1: 'a', 2: None}"), "map<string, string>")).alias("literals"),
        F.array_join(S.trending_links(F.concat(F.lit('<ul class="top trending"><a href="/'), k.cast("string"), F.lit('">x</a><a href="/b">y</a><a href="#">z</a></ul><a href="/c">'))), ",").alias("trending"),
        F.size(R.whole_shot(F.array().cast("array<struct<start: int, end: int>>"), k)).alias("shots"), image.alias("image"), F.concat(F.lit("/d/vid/"), "p_brand", F.lit("/"), name, F.lit(".v"), k.cast("string"), F.lit(".mp4")).alias("path"),
    )
    out = S.path_parts(S.file_name_parts(out, F.col("image")).drop("image"), F.col("path"), "folder", "clip")
    p = F.col("path")
    return out.select("*", X.basename(p).alias("base"), X.parent(p).alias("parent"), X.stem(p).alias("stem"), L.wav_path(p).alias("wav"), L.audio_path(p).alias("aud"), L.clean_audio_path(p).alias("clean_wav")).drop("path")


Q40 = r"""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size AS z, p_name || '.v' || p_partkey AS v FROM part)
SELECT k AS p_partkey, [n, n || ' / Other', 'Additional voices', '', 'Narrator', 'Guard #2', n || ' (uncredited)', 'the villager'][k % 8 + 1] AS dropped,
[n, n || '(voice) / Other', 'Additional voices', '(voice)', 'Narrator', 'Guard #2', n || ' (uncredited)', 'the villager'][k % 8 + 1] AS dropped_spaced,
[n, n, NULL, NULL, 'Narrator', 'Guard #2', n || ' (uncredited)', 'the villager'][k % 8 + 1] AS role, [false, false, true, false, true, true, true, true][k % 8 + 1] AS generic,
[true, true, true, false, true, false][k % 6 + 1] AS junk, CASE WHEN k % 3 = 0 THEN 'tt' || k END AS title_id, '"' || n || '" ' || b AS query, CASE WHEN k % 3 = 0 THEN 'File:' || n || '.png' END AS file,
k % 4 <> 1 AS chrome, ['He runs.', 'plain', '', 'ok'][k % 4 + 1] AS repaired, length(n) * (k % 300) > 1500 AS unstable, n || ' in ' || CASE WHEN k % 2 = 0 THEN b ELSE '' END || '!' AS prompt,
n || ' (red), ' || b || ' (blue)' AS characters, b || '/' || lpad(k::VARCHAR, 5, '0') || '.jpg' AS frame, CASE WHEN length(n) * 5 > 30 THEN repeat(n, 5) END AS description,
CASE WHEN k % 2 = 0 THEN ['Agnes Gru', 'Felonius Gru', 'Bob'][k % 3 + 1] ELSE ['Agnes', 'Gru', 'Bob'][k % 3 + 1] END AS movie_alias, ['Felonius Gru', 'Other', 'X'][k % 3 + 1] AS truth, k % 3 < 2 AS in_subset,
CASE WHEN k % 2 = 0 THEN 'Unknown' ELSE 'S1' END AS speaker, '{"p_partkey":' || k || ',"p_size":' || z || '}' AS json, z::VARCHAR AS found, 'none' AS missing, k AS literal, 2 AS literals, '/' || k || ',/b' AS trending, 1 AS shots,
[n, 'a_b', NULL, NULL][k % 4 + 1] AS character, [k % 3, 0, NULL, NULL][k % 4 + 1]::INT AS idx, [k % 3 = 0, true, NULL, NULL][k % 4 + 1] AS is_anchor, b AS folder, v || '.mp4' AS clip, v || '.mp4' AS base, b AS parent, v AS stem,
'/d/vid/' || b || '/' || v || '.wav' AS wav, '/d/aud/' || b || '/' || v || '.wav' AS aud, '/d/wav/clean/' || b || '/' || v || '.wav' AS clean_wav FROM p"""


def q41_box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of boxes, images and scores says of a box."""
    b = boxes(spark, sf_dir)
    box = G.Box.of()
    wide = box.pad(F.lit(120.0), F.lit(110.0))
    cut = box.clip(F.lit(60), F.lit(60))
    return b.select(
        "image", "pos", L.large_enough(box).alias("large"), L.has_area(box).alias("has_area"), L.confident_track(F.col("score") * 10, F.col("line") * 4).alias("confident"), L.open_set_label(F.col("label"), F.col("score") * 2).alias("label"),
        L.of_class(F.col("line"), 1).alias("of_class"), L.sharp(box.width.cast("double")).alias("sharp"), L.image_size_ok(box.width * 5, box.height * 5).alias("portrait"), L.image_size_ok(box.width * 5, box.height * 5, "gallery").alias("gallery"),
        L.image_size_ok(box.width * 10, box.height * 3, "search").alias("search"), L.short_media(F.when(F.col("line") > 2, F.col("line") * 900)).alias("short"),
        F.round(wide.x0, 4).alias("wide_x0"), F.round(wide.y1, 4).alias("wide_y1"), cut.x1.alias("cut_x1"), box.clipped_array(F.lit(60), F.lit(60)).isNull().alias("outside"), F.array_join(G.argsort_desc(F.array("x0", "y0", "x1")), ",").alias("order"),
        V.hamming(F.col("x0"), F.col("y1")).cast("int").alias("bits"),
    )


Q41 = f"""WITH {BOXES_SQL}, b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM boxes)
SELECT image, pos, w * h >= 1296 AS large, w * h > 0 AS has_area, score * 10 > 0.5 AND line * 4 > 15 AS confident, CASE WHEN score * 2 <= 0.15 THEN 'Other' ELSE label END AS label, line = 1 AS of_class, w >= 15 AS sharp,
least(w, h) * 5 >= 120 AS portrait, least(w, h) * 5 >= 200 AS gallery, least(w * 10, h * 3) >= 128 AND greatest(w * 10, h * 3) <= 3 * least(w * 10, h * 3) AS search, line <= 2 OR line * 900 <= 2700 AS short,
round(greatest(x0 - 0.1::DOUBLE * w, 0), 4) AS wide_x0, round(least(y1 + 0.1::DOUBLE * h, 110), 4) AS wide_y1, least(x1, 60) AS cut_x1, NOT (least(x1, 60) > x0 AND least(y1, 60) > y0) AS outside,
array_to_string(list_transform(list_sort([{{'a': -x0, 'i': 0}}, {{'a': -y0, 'i': 1}}, {{'a': -x1, 'i': 2}}]), lambda s: s.i), ',') AS "order", bit_count(xor(x0, y1))::INT AS bits FROM b"""


def q42_time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, seconds and samples of speech segments."""
    s = segments(spark, sf_dir).withColumn("frame", (F.col("start") % 1000).cast("int")).withColumn("n", F.lit(600))
    s = L.clip_range(s.withColumns({"a": F.col("frame") - 100, "b": F.col("frame") + 40}), "a", "b", "n")
    low = s.groupBy("clip").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    audio = F.sequence(F.lit(1), F.col("frame") % 50 + 1)
    first, last = G.track_audio_window(F.col("a"), F.col("b"), F.lit(25.0))
    grid = G.time_grid(F.col("a").cast("double"), F.col("b").cast("double"), 7.0)
    heard, seen = G.common_frames(audio, F.sequence(F.lit(1), F.lit(9)), 4)
    return s.join(low, "clip").select(
        "clip", "seg_pos", "a", "b", L.local_to_global(F.col("a"), F.col("seg_pos") % 30).alias("whole"), L.global_to_local(F.col("a"), F.col("b")).alias("local"), F.round(first, 4).alias("first"), F.round(last, 4).alias("last"),
        F.size(grid).alias("points"), F.element_at(grid, -1).alias("end"), F.array_join(G.fps_grid(F.col("b").cast("long"), F.lit(50).cast("long")), ",").alias("middles"), F.size(heard).alias("heard"), F.size(seen).alias("seen"),
        F.array_join(G.frame_samples(audio, F.lit(2), 2, 100, 25.0), ",").alias("samples"), F.size(G.waveform_slice(audio, F.lit(0.1), F.lit(0.35), 100)).alias("sliced"), F.round(F.array_max(G.mono(F.array("a", "b"), F.array("b", "b"))), 2).alias("mono"),
        F.round(V.minmax_scale(F.col("value"), F.col("low"), F.col("high")), 6).alias("scaled"), F.round(V.log_softmax(F.array(F.col("value") / 100, F.lit(1.0), F.lit(2.0)))[0], 6).alias("log_share"),
    )


Q42 = f"""WITH {SEGMENTS_SQL}, s AS (SELECT *, (start % 1000)::INT AS f FROM segments), r AS (SELECT *, greatest(f - 100, 0) AS a, least(f + 40, 600) AS b, f % 50 + 1 AS n, min(value) OVER w AS low, max(value) OVER w AS high
  FROM s WHERE greatest(f - 100, 0) < least(f + 40, 600) WINDOW w AS (PARTITION BY clip)), t AS (SELECT *, ceil((b + 7 - a) / 7.0)::INT AS points FROM r)
SELECT clip, seg_pos, a, b, (a + seg_pos % 30)::INT AS whole, b - a AS local, CASE WHEN a = 0 THEN 0 ELSE round((a + 1) / 25::DOUBLE, 4) END AS first, round((b + 1) / 25::DOUBLE, 4) AS last, points, (a + 7 * (points - 1))::DOUBLE AS "end",
array_to_string(range(25, b, 50), ',') AS middles, least(n // 4, 9) * 4 AS heard, least(n // 4, 9) AS seen, array_to_string(range(9, least(n, 16) + 1), ',') AS samples, greatest(least(n, 35) - 10, 0)::INT AS sliced, b::DOUBLE AS mono,
round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE value END, 6) AS scaled, round(value / 100 - ln(exp(value / 100) + exp(1::DOUBLE) + exp(2::DOUBLE)), 6) AS log_share FROM t"""


def q43_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people, parts as cast, files and pages: matches by alias, redirect, path part, position and id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    people = S.aliases(c.select(F.col("k").alias("person"), F.upper("name").alias("label"), F.array(F.concat(F.lit("A"), (F.col("k") % 40).cast("string"))).alias("aliases")))
    cast = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"), F.array(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")), F.lit("a3")).alias("aliases"))
    matched = J.alias_match(cast, people).select(F.col("person").alias("k"), F.col("name").alias("alias_match"))
    normal = c.where("k % 3 = 0").select(F.col("name").alias("source"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("target"))
    redirects = c.where("k % 6 = 0").select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("source"), F.lit("Home").alias("target"))
    pages = c.where("k % 2 = 0").select(F.col("name").alias("page")).unionByName(spark.createDataFrame([("Home",)], "page string"))
    page = J.resolve_redirects(c.select("k", "name"), normal, redirects, pages).select("k", "page", F.col("match").alias("page_match"))
    paths = c.where("k % 4 = 0").select(F.concat(F.lit("/m/"), F.col("name"), F.lit("/f"), F.col("nation").cast("string"), F.lit(".mp4")).alias("path"))
    found = J.path_contains(c.select("k", F.col("name").alias("clip")), paths).select("k", "path")
    later = J.cast_to_bank(c.select(F.lit("m").alias("movie"), (F.col("k") % 100).alias("actor"), F.col("name").alias("character"), F.col("k").alias("billing_pos"))).select(F.col("actor").alias("k"), F.col("character").alias("last_role"))
    lists = c.groupBy("segment").agg(F.slice(F.sort_array(F.collect_list("k")), 1, 30).alias("ids"), F.slice(F.sort_array(F.collect_list("name")), 1, 20).alias("names"))
    zipped = J.positional_join(lists.select("segment", "ids"), lists.select("segment", "names"), "segment", "ids", "names").select(F.col("ids").alias("k"), F.col("names").alias("zipped"))
    rows = L.zip_rows(lists.select("segment", F.slice("ids", 1, 20).alias("ids"), "names"), k="ids", parallel="names").select("k", "parallel")
    bank = S.frame_bank(c.select(F.col("segment").alias("movie"), F.col("k").alias("pos"), F.array("k", "nation").alias("ids"), F.array("name", "segment").alias("roles"))).select(F.col("id").alias("k"), F.col("role").alias("bank_role")).where("bank_role like 'Cust%'")
    roles = F.array_join(J.roles_of(F.array(F.col("k") % 5, F.lit(99)), F.create_map(F.lit(0).cast("long"), F.lit("zero"), F.lit(1).cast("long"), F.lit("one"))), ",", "-")
    out = c.select("k", roles.alias("roles"))
    for part in (matched, page, found, later, zipped, rows, bank):
        out = out.join(part, "k", "left")
    return out


Q43 = """WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS low FROM customer),
x AS (SELECT k % 100 AS k, max_by(name, k) AS last_role FROM c GROUP BY 1), p AS (SELECT name, 'N' || k AS n, k FROM c),
z AS (SELECT segment, r, list_sort(list(name) OVER (PARTITION BY segment))[r] AS z, k FROM c)
SELECT c.k, [CASE c.k % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE '-' END][1] || ',-' AS roles, (SELECT n_name FROM nation WHERE n_nationkey = CASE WHEN c.k % 40 = 3 THEN 0 WHEN c.k % 40 < 25 THEN c.k % 40 END) AS alias_match,
CASE WHEN c.k % 6 = 0 THEN 'Home' WHEN c.k % 3 <> 0 AND c.k % 2 = 0 THEN c.name END AS page, CASE WHEN c.k % 6 = 0 THEN 'redirect' WHEN c.k % 3 <> 0 AND c.k % 2 = 0 THEN 'exact' END AS page_match,
CASE WHEN c.k % 4 = 0 THEN '/m/' || c.name || '/f' || nation || '.mp4' END AS path, last_role, CASE WHEN c.r <= 20 THEN z.z END AS zipped, CASE WHEN c.r <= 20 THEN z.z END AS parallel, CASE WHEN c.k = low THEN c.name END AS bank_role
FROM c LEFT JOIN x USING (k) LEFT JOIN z ON z.k = c.k"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of tracks: an order is a track of one of three sets, its ship day modulo 40 the frame."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        (F.col("l_orderkey") % 200).alias("shot"), (F.col("l_orderkey") % 3).cast("int").alias("set_idx"), (F.floor(F.col("l_orderkey") / 200) % 4).cast("int").alias("track_id"), (F.dayofyear("l_shipdate") % 40).alias("frame"),
        (F.col("l_partkey") % 20).alias("x"), (F.col("l_suppkey") % 20).alias("y"), F.col("l_quantity").cast("long").alias("q"),
    )
    keys = ["shot", "set_idx", "track_id", "frame"]
    one = rows.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("q").alias("q"))
    return one.select(*keys, *(F.col(a).cast("double").alias(a) for a in ("x0", "y0")), (F.col("x0") + 30 + F.col("q")).cast("double").alias("x1"), (F.col("y0") + 40).cast("double").alias("y1"))


FRAMES_SQL = """frames AS (SELECT l_orderkey % 200 AS shot, (l_orderkey % 3)::INT AS set_idx, ((l_orderkey // 200) % 4)::INT AS track_id, dayofyear(l_shipdate)::INT % 40 AS frame, min(l_partkey % 20)::DOUBLE AS x0, min(l_suppkey % 20)::DOUBLE AS y0,
  min(l_partkey % 20)::DOUBLE + 30 + max(l_quantity::BIGINT) AS x1, min(l_suppkey % 20)::DOUBLE + 40 AS y1 FROM lineitem GROUP BY 1, 2, 3, 4)"""
_IOU = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


def q44_track_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of tracks, their mean overlap with the tracks of another set over shared frames, and pixels to boxes."""
    f = _frames(spark, sf_dir)
    keys = ["shot", "set_idx", "track_id"]
    shape = A.extent(f, keys, "frame").join(A.track_extent(f, keys), keys).join(A.mask_box(f, keys, "x0", "y0"), keys)
    a = f.where("set_idx = 0").withColumnRenamed("track_id", "a").drop("set_idx")
    b = f.where("set_idx = 1").withColumnRenamed("track_id", "b").drop("set_idx")
    shared = A.track_mean_iou(a, b, ["shot"], ("a", "b")).groupBy("shot").agg(F.round(F.sum("iou"), 4).alias("overlap"), F.count("*").alias("pairs"))
    close = J.box_pairs(a, b, ["shot", "frame"], 0.5).groupBy("shot").agg(F.count("*").alias("close"))
    large = A.best_rows(f.withColumn("area", G.Box.of().area()), keys, "area", "frame").select(*keys, F.col("frame").alias("largest"))
    return shape.join(large, keys).join(shared, "shot", "left").join(close, "shot", "left")


Q44 = f"""WITH {FRAMES_SQL}, p AS (SELECT a.shot, a.track_id AS i, b.track_id AS j, {_IOU} AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM frames a JOIN frames b ON a.shot = b.shot AND a.frame = b.frame AND a.set_idx = 0 AND b.set_idx = 1),
m AS (SELECT shot, round(sum(iou), 4) AS overlap, count(*) AS pairs FROM (SELECT shot, i, j, avg(c / (s - c)) AS iou FROM p GROUP BY 1, 2, 3) GROUP BY 1), n AS (SELECT shot, count(*) AS close FROM p WHERE c / (s - c) >= 0.5 GROUP BY 1)
SELECT f.shot, set_idx, track_id, min(frame) AS start_idx, max(frame) AS end_idx, max(x1 - x0) AS max_width, max(y1 - y0) AS max_height, min(x0) AS x0, min(y0) AS y0, max(x0) AS x1, max(y0) AS y1,
arg_min(frame, (-(x1 - x0) * (y1 - y0), frame)) AS largest, any_value(overlap) AS overlap, any_value(pairs) AS pairs, any_value(close) AS close FROM frames f LEFT JOIN m USING (shot) LEFT JOIN n USING (shot) GROUP BY 1, 2, 3"""


def q45_sync_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronisation of cells with frames, the best shift, accuracy of a score matrix and means of batches, per user group."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("g"), (F.col("event_id") % 50).alias("t"), F.col("event_id").alias("cell"), (F.round(F.col("value")) % 100 / 100).alias("cos"))
    score = A.sync_score(e, ["g"]).select("g", F.round("score", 6).alias("score"))
    loud = e.groupBy("g", "t").agg(F.max("cos").alias("loud"))
    moved = A.best_offset(e, loud, ["g"], [-2, -1, 0, 1, 2], 1 - F.abs(F.col("cos") - F.col("loud"))).select("g", "shift", F.round("score", 6).alias("best"))
    aligned = W.shift_align(e.select("g", "t", "cell"), loud, ["g"], "t", 3).groupBy("g").agg(F.count("*").alias("aligned"))
    cells = e.groupBy("g", F.col("t").alias("i")).agg(F.max("cos").alias("cos")).where("i < 30")
    matrix = cells.select(F.col("g").alias("i"), F.col("i").alias("j"), F.col("cos").alias("score"))
    top = A.topk_accuracy(matrix, 5).withColumn("top5", F.round("top5", 4))
    mean = A.mean_of_batch_means(e, "g", "cos").select(F.round("mean", 6).alias("mean"))
    return score.join(moved, "g").join(aligned, "g", "left").join(F.broadcast(top)).join(F.broadcast(mean))


Q45 = """WITH e AS (SELECT user_id % 30 AS g, event_id % 50 AS t, event_id AS cell, round(value) % 100 / 100 AS cos FROM events),
s AS (SELECT g, round(avg(m), 6) AS score FROM (SELECT g, t, max((cos + 1) / 2) AS m FROM e GROUP BY 1, 2) GROUP BY 1), l AS (SELECT g, t, max(cos) AS loud FROM e GROUP BY 1, 2),
o AS (SELECT g, shift, avg(m) AS m FROM (SELECT e.g, shift, e.t, max(1 - abs(cos - loud)) AS m FROM e JOIN (SELECT g, t - shift AS t, loud, shift FROM l, range(-2, 3) r(shift)) l ON l.g = e.g AND l.t = e.t GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT g, arg_max(shift, (m, -shift))::INT AS shift, round(max(m), 6) AS best FROM o GROUP BY g), a AS (SELECT e.g, count(*) AS aligned FROM e JOIN l ON l.g = e.g AND l.t - 3 = e.t GROUP BY 1),
k AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY loud DESC, t) AS r FROM l WHERE t < 30)
SELECT s.g, score, shift, best, aligned, (SELECT round(avg((r <= 5)::INT) * 100, 4) FROM k WHERE g = t) AS top5, (SELECT round(avg(m), 6) FROM (SELECT avg(cos) AS m FROM e GROUP BY g)) AS mean FROM s JOIN b USING (g) LEFT JOIN a USING (g)"""


def q46_sets_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions in which the left wins, fallbacks, running sums, steps, pools, trims and maps over orders of a customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round(F.col("o_totalprice") * 100).cast("long").alias("p"))
    one, two = o.where("k % 3 = 0").select("k", F.lit("one").alias("from")), o.where("k % 2 = 0").select("k", F.lit("two").alias("from"))
    both = W.keyed_union([one, two], ["k"])
    every = W.bag_union(one, two.withColumn("extra", F.lit(1))).groupBy("k").agg(F.count("*").alias("times"), F.sum("extra").alias("extras"))
    holes = o.select("k", F.when(F.col("k") % 5 > 0, F.col("s")).alias("s"), F.when(F.col("k") % 5 > 0, F.lit("own")).alias("by"))
    filled = W.fill_missing(holes, o.where("k % 10 = 0").select("k", F.lit("late").alias("s")), ["k"], "s", "by", "other")
    sums = W.running_sum(o, ["c"], W.desc_stable("p", "k"), "p", "running").select("k", "running")
    step = W.steps(o, ["c"], "k", "s").select("k", F.lit(True).alias("step"))
    order = F.row_number().over(W.Window.partitionBy("c").orderBy(*W.shot_order("s", "s", "kk"))).alias("place")
    placed = o.withColumn("kk", F.col("k").cast("string")).select("k", order, F.row_number().over(W.Window.partitionBy("c").orderBy(W.int_order("kk").desc())).alias("back"))
    split = W.hold_out(o, ["c"], "k", 0.3).select("k", "split")
    trimmed = J.trim_to(o.withColumns({"a": F.lit(1000), "b": F.lit(3000)}), "k", "a", "b").select("k", F.lit(True).alias("inside"))
    maps = A.nested_map(o, ["c"], "s", F.col("k")).select("c", F.array_join(F.map_keys("map"), "").alias("statuses"), F.map_values("map")[0].alias("last_of_first"), F.size(J.trim_map(F.map_from_arrays(F.map_values("map"), F.map_keys("map")), F.lit(0), F.lit(2000))).alias("low"))
    apart = o.groupBy("c").agg(W.disjoint(F.collect_set("s"), F.array(F.lit("F"))).alias("apart"))
    out = o.select("c", "k").join(filled, "k").join(sums, "k").join(placed, "k").join(split, "k").join(maps, "c").join(apart, "c")
    for part in (both, every, step, trimmed):
        out = out.join(part, "k", "left")
    return out


Q46 = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, round(o_totalprice * 100)::BIGINT AS p FROM orders), l AS (SELECT c, s, max(k) AS m FROM o GROUP BY 1, 2),
g AS (SELECT c, string_agg(s, '' ORDER BY s) AS statuses, arg_min(m, s) AS last_of_first, count(*) FILTER (m BETWEEN 0 AND 2000)::INT AS low, bool_and(s <> 'F') AS apart FROM l GROUP BY c),
w AS (SELECT *, sum(p) OVER (PARTITION BY c ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING)::BIGINT AS running, lead(s) OVER (PARTITION BY c ORDER BY k) AS nxt, row_number() OVER (PARTITION BY c ORDER BY s, k)::INT AS place,
  row_number() OVER (PARTITION BY c ORDER BY k DESC)::INT AS back, row_number() OVER (PARTITION BY c ORDER BY k) <= greatest(1, floor(count(*) OVER (PARTITION BY c) * 0.3)) AS val FROM o)
SELECT c, k, CASE WHEN k % 5 > 0 THEN s WHEN k % 10 = 0 THEN 'late' END AS s, CASE WHEN k % 5 > 0 THEN 'own' WHEN k % 10 = 0 THEN 'other' END AS by, running, place, back, CASE WHEN val THEN 'val' ELSE 'train' END AS split, statuses, last_of_first, low, apart,
CASE WHEN k % 3 = 0 THEN 'one' WHEN k % 2 = 0 THEN 'two' END AS "from", nullif((k % 3 = 0)::INT + (k % 2 = 0)::INT, 0)::BIGINT AS times, CASE WHEN k % 2 = 0 THEN 1 END::BIGINT AS extras, CASE WHEN nxt <> s THEN true END AS step,
CASE WHEN k BETWEEN 1000 AND 3000 THEN true END AS inside FROM w JOIN g USING (c)"""


def q47_pools_and_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as detections: best of each label, the crowd's all, pools that are filled up, category pages."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), F.round("s_acctbal", 2).alias("score"), (F.col("s_suppkey") % 3).alias("label"))
    crowd = A.crowd_exception(s, ["g"], "label", "2", "score", "k").groupBy("g").agg(F.count("*").alias("crowd"), F.sum("k").alias("crowd_keys"))
    shots = A.best_per_label_shot(s, "label", "g").groupBy("g").agg(F.round(F.sum("score"), 2).alias("best_sum"))
    members = s.where("k % 2 = 0").select("g", "k")
    groups = s.select("g", F.floor(F.col("k") / 10).alias("subgroup"), (F.floor(F.col("k") / 10) % 20).alias("sub_pos"), F.col("k").alias("pos"), "k")
    pool = W.capped_pool(members, groups, ["g"], "pos", 3, 4).groupBy("g").agg(F.count("*").alias("pool"))
    pages = table(spark, sf_dir, "part").select(F.col("p_size").alias("g"), "p_partkey", F.array(F.when(F.col("p_partkey") % 3 == 0, F.lit("Main Characters")).otherwise(F.lit("Places"))).alias("categories"))
    kept = L.category_members(pages, ["g"], "categories").groupBy("g").agg(F.count("*").alias("pages"))
    en, other = L.by_language(table(spark, sf_dir, "documents"))
    langs = en.unionByName(other).groupBy((F.col("doc_id") % 25).cast("int").alias("g")).agg(F.count("*").alias("docs"))
    out = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"))
    for part in (crowd, shots, pool, kept, langs):
        out = out.join(part, "g", "left")
    return out


Q47 = """WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, round(s_acctbal, 2) AS score, s_suppkey % 3 AS label FROM supplier),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g, label ORDER BY score DESC, k) = 1), c AS (SELECT g, count(*) AS crowd, sum(k)::BIGINT AS crowd_keys FROM (SELECT g, k FROM b UNION ALL SELECT g, k FROM s WHERE label = 2) GROUP BY g),
m AS (SELECT g, count(*) AS n FROM s WHERE k % 2 = 0 GROUP BY g),
p AS (SELECT g, count(*) AS pool FROM (SELECT g FROM s WHERE k % 2 = 0 UNION ALL SELECT s.g FROM s LEFT JOIN m USING (g) WHERE coalesce(n, 0) < 3 AND (k // 10) % 20 < 4) GROUP BY g),
t AS (SELECT g, count(*) AS pages FROM (SELECT p_size AS g, p_partkey AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part) WHERE n <= 20 OR k % 3 = 0 GROUP BY g)
SELECT n_nationkey AS g, crowd, crowd_keys, (SELECT round(sum(score), 2) FROM b WHERE b.g = n_nationkey) AS best_sum, pool, pages, (SELECT count(*) FROM documents WHERE doc_id % 25 = n_nationkey) AS docs
FROM nation LEFT JOIN c ON c.g = n_nationkey LEFT JOIN p ON p.g = n_nationkey LEFT JOIN t ON t.g = n_nationkey"""


def q48_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by hash: how many rows each takes of a group, that they are rows of it and taken once. Which ones is the hash's choice."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("g"), F.col("event_id").alias("k"), "event_type")
    seen = lambda df, name: df.join(e.select("g", "k"), ["g", "k"], "left_semi").groupBy("g").agg(F.count_distinct("k").alias(name))
    sampled = seen(W.hash_sample(e, ["g"], ["k"], 7), "sampled")
    thirds = W.stratified_thirds(e, ["g"], "k")
    place = e.withColumn("i", F.row_number().over(W.Window.partitionBy("g").orderBy("k")) - 1).withColumn("n", F.count("*").over(W.Window.partitionBy("g")))
    ok = thirds.join(place.select("g", "k", "i", "n"), ["g", "k"]).groupBy("g").agg(F.count("*").alias("strata"), F.bool_and(F.floor(F.col("i") / F.floor(F.col("n") / 3)) == F.col("stratum")).alias("in_stratum"))
    parts = W.hash_split(e, ["k"]).groupBy("g").agg(F.count("*").alias("split"), (F.abs(F.avg((F.col("split") == "train").cast("int")) - 0.95) < 0.15).alias("near_95"))
    mix = W.ratio_mix(e.where("g < 20"), e.where("g >= 20"), ["k"], 100, 0.3)
    mixed = mix.agg(F.count_if(F.col("g") < 20).alias("synthetic"), F.count("*").alias("mixed"))
    pairs = W.contrastive_pairs(e, ["g"], "event_type", "k")
    right = pairs.join(e.select("g", F.col("k").alias("positive"), F.col("event_type").alias("t")), ["g", "positive"])
    right = right.groupBy("g").agg(F.count("*").alias("pairs"), F.bool_and((F.col("t") == F.col("event_type")) & (F.size("negatives") == 4) & ~F.array_contains("negatives", F.col("k"))).alias("sound"))
    thin = e.select(F.lit("m").alias("movie"), F.col("g").cast("string").alias("character"), F.col("k").alias("exemplar_id"))
    bank = J.top_up_bank(thin.where("exemplar_id % 11 = 0"), thin.where("exemplar_id % 11 = 1"), 30).groupBy(F.col("character").cast("long").alias("g")).agg(F.count("*").alias("bank"))
    return sampled.join(ok, "g").join(parts, "g").join(right, "g").join(bank, "g").join(F.broadcast(mixed))


Q48 = """WITH e AS (SELECT user_id % 40 AS g, event_id AS k, event_type AS t FROM events), n AS (SELECT g, count(*) AS n, count(*) FILTER (k % 11 = 0) AS a, count(*) FILTER (k % 11 = 1) AS b FROM e GROUP BY g),
p AS (SELECT g, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS pairs FROM (SELECT g, t, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY g)
SELECT g, least(n, 7) AS sampled, 3::BIGINT AS strata, true AS in_stratum, n AS split, true AS near_95, pairs, true AS sound, CASE WHEN a < 30 THEN a + least(b, 30 - a) ELSE a END AS bank, (SELECT least(30, count(*) FILTER (g < 20)) FROM e) AS synthetic, (SELECT least(30, count(*) FILTER (g < 20)) + least(70, count(*) FILTER (g >= 20)) FROM e) AS mixed FROM n JOIN p USING (g)"""


def q49_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors are of one speaker, their contrast between two others, and the widest cluster of a label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "label", F.col("embedding").alias("v"))
    first, last = e.groupBy("label").agg(F.min_by("v", "k").alias("a"), F.max_by("v", "k").alias("z")), e.groupBy().agg(F.min_by("v", "k").alias("o"))
    out = e.join(first, "label").join(F.broadcast(last))
    return out.select("k", V.same_speaker(F.col("v"), F.col("a"), 0.1).alias("same"), F.round(V.contrast(F.col("v"), F.col("a"), F.col("z")), 6).alias("contrast"), V.contrast(F.col("v"), F.col("a"), F.lit(None).cast("array<float>")).alias("none"), F.round(V.dot(F.col("v"), F.col("o")), 6).alias("dot"))


Q49 = """WITH e AS (SELECT vec_id AS k, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, arg_min(v, k) AS a, arg_max(v, k) AS z FROM e GROUP BY label)
SELECT k, list_cosine_similarity(v, a) >= 0.1 AS same, round(list_cosine_similarity(v, a) - list_cosine_similarity(v, z), 6) AS contrast, '-inf'::DOUBLE AS none, round(list_dot_product(v, (SELECT arg_min(v, k) FROM e)), 6) AS dot FROM e JOIN f USING (label)"""


def q50_merged_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the three sets of a shot: optimal links of every two sets, and how many of them each shot has."""
    f = _frames(spark, sf_dir)
    links = H.link_tracks(f, ["shot"], 0.3)
    return links.groupBy("shot", "set_a", "set_b").agg(F.count("*").alias("links"), F.round(F.sum("iou"), 4).alias("iou"))


Q50 = f"""WITH RECURSIVE {FRAMES_SQL}, u AS (SELECT a.shot, a.set_idx AS sa, b.set_idx AS sb, a.track_id AS i, b.track_id AS j, avg(iou) AS iou FROM
  (SELECT a.shot, a.set_idx AS sa, b.set_idx AS sb, a.track_id AS i, b.track_id AS j, {_IOU} AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM frames a JOIN frames b ON a.shot = b.shot AND a.frame = b.frame AND a.set_idx < b.set_idx) p,
  LATERAL (SELECT p.c / (p.s - p.c) AS iou), LATERAL (SELECT p.shot, p.sa AS set_idx, p.i AS track_id) a, LATERAL (SELECT p.sb AS set_idx, p.j AS track_id) b GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT shot, sa, sb, list(DISTINCT i ORDER BY i) AS rows, list(DISTINCT j ORDER BY j) AS cols FROM u GROUP BY 1, 2, 3),
t AS (SELECT shot, sa, sb, 0 AS n, []::INT[] AS used, 0::DOUBLE AS total, 0::DOUBLE AS accepted, 0 AS links FROM k
  UNION ALL SELECT shot, sa, sb, n, used, max(total), arg_max(accepted, total), arg_max(links, total) FROM
   (SELECT t.shot, t.sa, t.sb, t.n + 1 AS n, CASE WHEN u.j IS NULL THEN t.used ELSE list_sort(list_append(t.used, u.j)) END AS used, t.total + coalesce(u.iou, 0) AS total,
    t.accepted + CASE WHEN u.iou >= 0.3 THEN u.iou ELSE 0 END AS accepted, t.links + (coalesce(u.iou, 0) >= 0.3)::INT AS links
    FROM t JOIN k USING (shot, sa, sb) JOIN (SELECT shot, sa, sb, i, j, iou FROM u UNION ALL SELECT DISTINCT shot, sa, sb, i, NULL::INT, NULL::DOUBLE FROM u) u ON u.shot = t.shot AND u.sa = t.sa AND u.sb = t.sb AND u.i = k.rows[t.n + 1]
    WHERE t.n < len(k.rows) AND (u.j IS NULL OR NOT list_contains(t.used, u.j))) GROUP BY shot, sa, sb, n, used)
SELECT shot, sa AS set_a, sb AS set_b, arg_max(links, (n, total))::BIGINT AS links, round(arg_max(accepted, (n, total)), 4) AS iou FROM t GROUP BY 1, 2, 3 HAVING arg_max(links, (n, total)) > 0"""


def q51_speaker_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local speakers of files by their centroids, clustered greedily; segments of the largest cluster of each label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("movie"), (F.col("vec_id") % 5).alias("file"), (F.col("vec_id") % 3).alias("speaker"), F.col("vec_id").alias("k"), F.col("embedding").alias("feature"))
    return K.match_speakers(e, ["movie"], "file", "speaker", threshold=0.6).select("movie", "file", "speaker", "k")


Q51 = """WITH RECURSIVE e AS (SELECT label AS movie, vec_id % 5 AS file, vec_id % 3 AS speaker, vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT movie, file, speaker, d, avg(v[d] / sqrt(list_dot_product(v, v))) AS x FROM e, range(1, 65) r(d) GROUP BY ALL), l AS (SELECT movie, file, speaker, list(x ORDER BY d) AS v, row_number() OVER (PARTITION BY movie ORDER BY file, speaker) AS n FROM x GROUP BY 1, 2, 3),
p AS (SELECT a.movie, a.n, list(b.n) AS near FROM l a JOIN l b ON a.movie = b.movie AND b.n < a.n AND list_cosine_similarity(a.v, b.v) > 0.6 GROUP BY 1, 2),
s AS (SELECT movie, 1 AS n, [0]::BIGINT[] AS c FROM l WHERE n = 1
  UNION ALL SELECT s.movie, s.n + 1, list_append(s.c, coalesce(list_min(list_transform(p.near, lambda i: s.c[i])), list_max(s.c) + 1)) FROM s JOIN l ON l.movie = s.movie AND l.n = s.n + 1 LEFT JOIN p ON p.movie = s.movie AND p.n = s.n + 1),
f AS (SELECT movie, arg_max(c, n) AS c FROM s GROUP BY movie), m AS (SELECT l.movie, file, speaker, f.c[l.n] AS c FROM l JOIN f USING (movie)), w AS (SELECT movie, arg_max(c, (n, c)) AS c FROM (SELECT movie, c, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY movie)
SELECT e.movie, e.file, e.speaker, e.k FROM e JOIN m ON m.movie = e.movie AND m.file = e.file AND m.speaker = e.speaker JOIN w ON w.movie = m.movie AND w.c = m.c"""
