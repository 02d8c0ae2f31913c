"""Queries of the join, window, filter and text families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import boxes as G
from rollcall.functions import text as X
from rollcall.functions.vectors import cosine
from rollcall.operators import aggregates as A
from rollcall.operators import filters as L
from rollcall.operators import joins as J
from rollcall.operators import windows as W
from rollcall.plans.tables import BOXES_SQL, SEGMENTS_SQL, bank, boxes, segments, table


def _anchor_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir)
    anchors = b.groupBy("character").agg(F.min_by("feature", "vec_id").alias("anchor"), F.min("vec_id").alias("anchor_id"))
    return b.join(anchors, "character").where("vec_id <> anchor_id").select("character", "vec_id", F.round(cosine(F.col("feature"), F.col("anchor")), 6).alias("sim"))


SIMS_SQL = """anchors AS (SELECT label, min(vec_id) AS anchor_id, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label),
sims AS (SELECT e.label::VARCHAR AS character, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 6) AS sim
         FROM embeddings e JOIN anchors USING (label) WHERE vec_id <> anchor_id)"""


def q2_topk_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_k(_anchor_sims(spark, sf_dir), ["character"], [F.col("sim").desc(), F.col("vec_id")], 8)


Q2 = f"WITH {SIMS_SQL} SELECT *, row_number() OVER (PARTITION BY character ORDER BY sim DESC, vec_id)::INT AS rank FROM sims QUALIFY rank <= 8"


def q3_quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.threshold_or_quota(_anchor_sims(spark, sf_dir), ["character"], "sim", "vec_id", 0.2, 0.1, 5)


Q3 = f"""WITH {SIMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY character ORDER BY sim DESC, vec_id)::INT AS rank FROM sims)
SELECT * FROM r WHERE sim >= 0.2 OR (rank <= 5 AND sim >= 0.1)"""


def q4_confidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    image = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name"))
    source = F.when(F.col("s_suppkey") % 2 == 0, "infobox").otherwise("gallery")
    match = F.element_at(F.array(*map(F.lit, ("exact", "redirect", "fuzzy", "category"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    c = s.select("n_name", L.confidence_class(image, source, match).alias("confidence"))
    return A.category_counts(c, ["n_name"], "confidence", ["confident", "low", "missing"])


Q4 = """SELECT n_name, count(*) FILTER (c = 'confident') AS confident, count(*) FILTER (c = 'low') AS low, count(*) FILTER (c = 'missing') AS missing
FROM (SELECT n_name, CASE WHEN s_suppkey % 7 = 0 THEN 'missing' WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 IN (0, 1) THEN 'confident' ELSE 'low' END AS c
      FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name"""


def q5_ordered_group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return A.collect_ordered(o, ["o_custkey"], "o_orderpriority", "o_orderkey", "list").select("o_custkey", F.array_join("list", "|").alias("priorities"))


Q5 = "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY o_custkey"


def q6_alias_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = list(L.LABEL_ALIASES)
    raw = F.concat(F.element_at(F.array(*map(F.lit, [*names, "Nobody"])), (F.col("p_partkey") % (len(names) + 1) + 1).cast("int")), F.lit("/"), F.col("p_brand"))
    return p.select("p_partkey", L.alias(L.label_prefix(raw)).alias("label"))


_NAMES = [*L.LABEL_ALIASES, "Nobody"]
_TO = [*L.LABEL_ALIASES.values(), "Nobody"]
Q6 = f"SELECT p_partkey, ({[x.replace(chr(39), '') for x in _TO]!r})[(p_partkey % {len(_TO)} + 1)::INT] AS label FROM part"


def q7_renumber_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", X.content_key(F.col("text")).alias("content"))
    return W.exact_dedup_renumber(d, ["source"], "content", "doc_id", "idx").select("source", "doc_id", "idx")


Q7 = """WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, sha256(text))
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS idx FROM f"""


def q8_balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    chunks = W.balanced_split(o, [F.col("o_orderkey")], 7)
    workers = W.round_robin_split(o, [F.col("o_orderkey")], 4)
    return chunks.join(workers, "o_orderkey")


Q8 = """SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS chunk, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 4)::INT AS worker FROM orders"""


def q9_first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = W.ids_by_first_appearance(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")
    return ids.select("user_id", "event_type", "first_pos", "id", W.colour_of(F.col("id"), X.COLOURS).alias("colour"))


Q9 = f"""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_pos FROM events GROUP BY ALL),
i AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY first_pos, event_type) - 1)::INT AS id FROM f)
SELECT *, ({X.COLOURS!r})[id + 1] AS colour FROM i"""


def q10_relative_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = W.relative_to_best(boxes(spark, sf_dir).where("score > 0"), ["image"], "score")
    return kept.where(L.min_side(G.Box.of(), 20)).select("image", "pos", "score")


Q10 = f"""WITH {BOXES_SQL} SELECT image, pos, score FROM (SELECT *, max(score) OVER (PARTITION BY image) AS m FROM boxes WHERE score > 0)
WHERE score >= 0.5 * m AND least(x1 - x0, y1 - y0) >= 20"""


def q11_sliding_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    win = W.sliding_windows(e, ["user_id"], "event_id", "cents", 5).select("user_id", "event_id", F.aggregate("window", F.lit(0).cast("long"), lambda s, x: s + x).alias("window_sum"))
    avg = W.centred_average(e, ["user_id"], "event_id", "cents").select("user_id", "event_id", F.round("average", 4).alias("centred"))
    return avg.join(win, ["user_id", "event_id"], "left")


Q11 = """WITH e AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS cents FROM events),
w AS (SELECT *, sum(cents) OVER f AS s, count(*) OVER f AS n, avg(cents) OVER c AS a, count(*) OVER c AS m FROM e
      WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), c AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
x AS (SELECT user_id, event_id, CASE WHEN n = 5 THEN s END AS window_sum, CASE WHEN m = 5 THEN a END AS a FROM w)
SELECT user_id, event_id, window_sum::BIGINT AS window_sum, round(coalesce(a, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS centred FROM x"""


def q12_deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = boxes(spark, sf_dir).groupBy("image").agg(F.count("*").cast("int").alias("n"))
    grid = n.select("image", "n", G.linspace_indices(F.col("n"), 16).alias("at"))
    return grid.select("image", "n", F.array_join("at", ",").alias("grid"), F.array_join(G.every_second(F.col("at")), ",").alias("every_second"), F.floor(F.col("n") / 3).cast("int").alias("stratum_size"))


Q12 = """WITH n AS (SELECT l_orderkey AS image, count(*)::INT AS n FROM lineitem GROUP BY 1)
SELECT image, n, array_to_string([(i * n) // 16 for i in range(16)], ',') AS grid, array_to_string([(2 * i * n) // 16 for i in range(8)], ',') AS every_second, n // 3 AS stratum_size FROM n"""


def q13_strict_lookup_and_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    clips = J.invert_map(o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("clips")), "o_custkey")
    rows = J.strict_lookup(clips, c, ["o_custkey"])
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("clips"), F.min("clip").alias("first_clip"))


Q13 = "SELECT c_mktsegment, count(*) AS clips, min(o_orderkey) AS first_clip FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def q14_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return J.left_with_default(d, lab, ["doc_id"], quality=F.lit(-1), toxic=F.lit(-1))


Q14 = "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)"


def q15_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    done, todo = J.known_only(c, o, ["k"]).withColumn("state", F.lit("done")), J.pending(c, o, ["k"]).withColumn("state", F.lit("pending"))
    return done.unionByName(todo).groupBy("c_mktsegment", "state").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


Q15 = """SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'done' ELSE 'pending' END AS state,
count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1, 2"""


def q16_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    a, b = s.select("clip", F.col("seg_pos").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1")), s.select("clip", F.col("seg_pos").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    pairs = J.interval_overlap(a, b, ["clip"], "s1", "e1", "s2", "e2", bucket=14400).where("a < b")
    shared = (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared")
    return pairs.select("clip", "a", "b", shared, (F.least("e1", "e2") - F.greatest("s1", "s2") > 15).alias("long_enough"))


Q16 = f"""WITH {SEGMENTS_SQL} SELECT x.clip, x.seg_pos AS a, y.seg_pos AS b, least(x.fin, y.fin) - greatest(x.start, y.start) AS shared,
least(x.fin, y.fin) - greatest(x.start, y.start) > 15 AS long_enough FROM segments x JOIN segments y ON x.clip = y.clip AND x.seg_pos < y.seg_pos AND x.start <= y.fin AND x.fin >= y.start"""


def q17_point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels every ten minutes from the first start to the last end of each clip."""
    s = segments(spark, sf_dir)
    span = s.groupBy("clip").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    points = span.select("clip", F.explode(F.sequence(F.col("t0"), F.greatest("t0", "t1"), F.lit(600).cast("long"))).alias("t"))
    points = points.hint("merge")  # Spark takes the grid for as small as its clips and would broadcast it
    return J.label_at(points, s, ["clip"], "t", "start", "end", "label", "seg_pos", bucket=14400)


Q17 = f"""WITH {SEGMENTS_SQL}, p AS (SELECT clip, unnest(range(min(start), greatest(min(start), max(fin)) + 1, 600)) AS t FROM segments GROUP BY clip)
SELECT p.clip, p.t, arg_max(label, seg_pos) AS label FROM p LEFT JOIN segments s ON s.clip = p.clip AND p.t >= s.start AND p.t < s.fin GROUP BY 1, 2"""


def q18_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("m").alias("movie"), (F.col("o_custkey") % 50).alias("clip"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("frame"), "o_orderkey")
    pred = o.groupBy("movie", "clip", "frame").agg(F.array_sort(F.collect_list("o_orderkey")).alias("boxes"))
    clips = o.groupBy("movie", "clip").agg((F.max("frame") + 1).alias("n_frames"))
    return J.dense_frames(pred, clips).groupBy("clip").agg(F.count("*").alias("frames"), F.sum(F.size("boxes")).alias("boxes"), F.count_if(F.size("boxes") == 0).alias("gaps"))


Q18 = """WITH o AS (SELECT o_custkey % 50 AS clip, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS frame FROM orders)
SELECT clip, max(frame) + 1 AS frames, count(*) AS boxes, max(frame) + 1 - count(DISTINCT frame) AS gaps FROM o GROUP BY clip"""


def q19_normalised_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    # every third credit names a page that does not exist, so that the second tier has work
    credit = names.select(F.concat(F.lit("The "), F.initcap("p_name"), F.when(F.col("pos") % 3 == 0, F.lit(" Jr.")).otherwise(F.lit("")), F.lit(" (voice)")).alias("name"))
    titles = names.select(F.col("p_name").alias("title"), "pos")
    exact = J.normalised_match(credit, titles)
    loose = credit.select("name", F.split_part(X.normalise_name(F.col("name")), F.lit(" "), F.lit(1)).alias("w")).join(titles.groupBy(F.split_part("title", F.lit(" "), F.lit(1)).alias("w")).agg(F.min("title").alias("title")), "w").select("name", "title")
    return J.cascade(credit, "name", [("exact", exact.select("name", "title")), ("first_word", loose)]).withColumn("clean", X.clean_name(F.col("name")))


Q19 = """WITH n AS (SELECT p_name, min(p_partkey) AS pos FROM part GROUP BY p_name),
t AS (SELECT p_name AS title FROM n), f AS (SELECT split_part(title, ' ', 1) AS w, min(title) AS title FROM t GROUP BY 1),
c AS (SELECT p_name, pos % 3 > 0 AS known, 'The ' || array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') || CASE WHEN pos % 3 = 0 THEN ' Jr.' ELSE '' END AS clean FROM n)
SELECT clean || ' (voice)' AS name, coalesce(t.title, f.title) AS title, CASE WHEN t.title IS NOT NULL THEN 'exact' ELSE 'first_word' END AS tier_name, clean
FROM c LEFT JOIN t ON t.title = p_name AND known LEFT JOIN f ON f.w = split_part(p_name, ' ', 1) WHERE coalesce(t.title, f.title) IS NOT NULL"""


def q20_token_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    short = names.select(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 3)), " ").alias("name")).distinct()
    return J.token_prefix_match(short, names.withColumnRenamed("p_name", "title"))


Q20 = """WITH t AS (SELECT p_name AS title, string_split(p_name, ' ') AS tb, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
s AS (SELECT DISTINCT array_to_string([w[1:3] for w in tb], ' ') AS name, [w[1:3] for w in tb] AS ta FROM t),
p AS (SELECT name, title, pos, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS a, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS b FROM s, t)
SELECT name, arg_min(title, (len(title), pos)) AS title FROM p
WHERE len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(y, x) OR starts_with(x, y))) = 0)) = 0 GROUP BY name"""


def q34_url_and_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    wiki = F.concat(F.lit("https://w.example.org/wiki/Category:A_"), F.col("page_id").cast("string"), F.lit("%20+x"))
    svg = F.concat(F.lit("https://img.example.org/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".svg?v=1").otherwise(".png?v=1"))
    return p.select("page_id", X.wiki_api(F.col("url")).alias("api"), X.wiki_title(wiki).alias("title"), X.rasterise_url(svg).alias("image"), F.length(X.strip_tags(F.col("html"))).alias("text_length"))


Q34 = r"""SELECT page_id, 'https://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || '/api.php' AS api, 'Category:A ' || page_id || ' +x' AS title,
'https://img.example.org/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.svg/scale-to-width-down/800?v=1' ELSE '.png?v=1' END AS image,
length(regexp_replace(html, '<[^>]+>', '', 'g'))::INT AS text_length FROM pages"""


def q35_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.missing.deep").isNull()).alias("absent"), F.max(F.to_json(F.struct(k.alias("k")))).alias("largest"))


Q35 = """SELECT event_type, sum(coalesce((props::JSON->>'$.k')::BIGINT, 0))::BIGINT AS total, count(*) AS absent, max('{"k":' || coalesce((props::JSON->>'$.k')::BIGINT, 0) || '}') AS largest FROM events GROUP BY 1"""


def q36_text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    words = X.word_count(F.col("text"))
    return c.select("conv_id", "turn", words.alias("words"), X.fits_length(F.col("text")).alias("fits"), L.speech_rate(F.length("text") / 10, words, 0.6).alias("spoken"), X.word_budget(words.cast("double"), 0.5).alias("budget"))


Q36 = r"""WITH c AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::INT AS words FROM conversations)
SELECT conv_id, turn, words, words > 1 AND words < 64 AND length(text) < 250 AS fits, coalesce(length(text) / 10.0::DOUBLE / nullif(words, 0) < 0.6, false) AS spoken, floor(words / 0.5::DOUBLE + 1)::INT AS budget FROM c"""


def q37_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    inner = b.select("image", F.col("pos").alias("other"), *(F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = b.join(inner, "image").where("pos < other")
    one, two = G.Box.of(), G.Box.of("i_")
    slid = one.slide_into(F.lit(150), F.lit(200))
    measured = pairs.select("image", "pos", "other", F.round(one.iou(two), 6).alias("iou"), F.round(one.iou_eps(two), 6).alias("iou_eps"), F.round(one.containment(two), 6).alias("inside"), one.area().alias("area"), slid.x0.cast("long").alias("slid_x0"), slid.y1.cast("long").alias("slid_y1"), one.recentre(F.lit(10), F.lit(10)).x0.alias("centred_x0"))
    kept = L.without_group_boxes(b, ["image"], "pos", 0.5).select("image", "pos", F.lit(True).alias("kept"))
    return measured.join(kept, ["image", "pos"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


Q37 = f"""WITH {BOXES_SQL}, p AS (SELECT a.*, b.pos AS other, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS area, (b.x1 - b.x0) * (b.y1 - b.y0) AS other_area FROM boxes a JOIN boxes b ON a.image = b.image AND a.pos <> b.pos),
g AS (SELECT image, pos FROM p WHERE i / nullif(other_area, 0)::DOUBLE > 0.5 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p.image, p.pos, other, round(i / (area + other_area - i)::DOUBLE, 6) AS iou, round(i / (area + other_area - i + 1e-6::DOUBLE), 6) AS iou_eps, round(i / other_area::DOUBLE, 6) AS inside, area,
CASE WHEN x1 > 150 THEN 150 - (x1 - x0) ELSE x0 END AS slid_x0, CASE WHEN y1 > 200 THEN 200 ELSE y1 END AS slid_y1, (x0 + x1) / 2::DOUBLE - 5 AS centred_x0, g.image IS NULL AS kept
FROM p LEFT JOIN g ON g.image = p.image AND g.pos = p.pos WHERE p.pos < other"""


def q38_per_frame_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    rows = s.select("clip", G.time_to_frame(F.col("start").cast("double"), F.lit(1 / 86400)).alias("frame"), F.col("label").alias("person"), F.col("seg_pos").alias("idx"), "value")
    hits = A.per_frame_best(rows, 45.0, ["clip"], "frame", "person", "idx", "value")
    return hits.select("clip", "person", F.array_join(F.transform("hits", lambda h: F.concat(h["frame"].cast("string"), F.lit(":"), h["idx"].cast("string"))), ",").alias("hits"))


Q38 = f"""WITH {SEGMENTS_SQL}, b AS (SELECT clip, start // 86400 AS frame, label AS person, arg_max(seg_pos, (value, -seg_pos)) AS idx FROM segments WHERE value >= 45 GROUP BY 1, 2, 3)
SELECT clip, person, string_agg(frame || ':' || idx, ',' ORDER BY frame) AS hits FROM b GROUP BY 1, 2"""
