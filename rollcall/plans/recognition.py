"""Queries of matching, metrics, clustering and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.operators import aggregates as A
from rollcall.operators import clustering as K
from rollcall.operators import filters as L
from rollcall.operators import fusion, matching
from rollcall.operators import joins as J
from rollcall.operators import metrics as M
from rollcall.operators import windows as W
from rollcall.plans.tables import BOXES_SQL, SEGMENTS_SQL, bank, boxes, segments, table


def q1_bank_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is classified by the others: cosine, mean of the best three per character, first best, and the total AP."""
    b = bank(spark, sf_dir)
    q = b.where("vec_id % 5 = 0").select("movie", F.col("vec_id").alias("query_id"), "feature", F.col("character").alias("truth"))
    scores = J.similarity_join(q.drop("truth"), b.where("vec_id % 5 <> 0"), ["movie"]).withColumn("score", F.round("score", 6))
    best = A.argmax_first(scores, ["query_id"], "character", "score", "pos").join(q.select("query_id", "truth"), "query_id")
    best = best.withColumn("correct", (F.col("character") == F.col("truth")).cast("int"))
    ap = M.average_precision(best, [], "score", "correct")
    return best.crossJoin(F.broadcast(ap)).select("query_id", "character", "score", "correct", F.round("ap", 4).alias("ap"))


Q1 = """WITH s AS (SELECT q.vec_id AS query_id, q.label AS truth, b.label, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings q JOIN embeddings b ON q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
t AS (SELECT query_id, truth, label, round(avg(sim), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC) AS r FROM s) WHERE r <= 3 GROUP BY ALL),
p AS (SELECT query_id, arg_max(label, (score, -label)) AS c, max(score) AS score, any_value(truth) AS truth FROM t GROUP BY query_id),
h AS (SELECT query_id, c::VARCHAR AS character, score, (c = truth)::INT AS correct FROM p),
k AS (SELECT score, sum(correct) AS tp, count(*) AS n FROM h GROUP BY score),
w AS (SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS tps, sum(n) OVER (ORDER BY score DESC) AS ns, sum(tp) OVER () AS total FROM k)
SELECT h.*, (SELECT round(coalesce(sum(tp / nullif(total, 0)::DOUBLE * (tps / ns::DOUBLE)), 0), 4) FROM w) AS ap FROM h"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    label, score = L.open_set(F.when(F.col("quality") == 1, "good").otherwise("bad"), (F.col("n_chars") % 97) / 96)
    return d.select("lang", "doc_id", F.round(score, 6).alias("score"), (label == F.when(F.col("toxic") == 1, "bad").otherwise("good")).cast("int").alias("hit"))


SCORED = """scored AS (SELECT lang, doc_id, round(CASE WHEN (n_chars % 97) / 96::DOUBLE <= 0.15 THEN (1 - (n_chars % 97) / 96::DOUBLE) * 0.15::DOUBLE ELSE (n_chars % 97) / 96::DOUBLE END, 6) AS score,
  (CASE WHEN (n_chars % 97) / 96::DOUBLE <= 0.15 THEN 'Other' WHEN quality = 1 THEN 'good' ELSE 'bad' END = CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END)::INT AS hit
  FROM documents JOIN labels USING (doc_id))"""


def q21_ap_total_and_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision_total(_scored(spark, sf_dir), "lang", "score", "hit").withColumn("ap", F.round("ap", 6))


Q21 = f"""WITH {SCORED}, b AS (SELECT lang, score, hit, 0 AS a FROM scored UNION ALL SELECT NULL, score, hit, 1 FROM scored),
k AS (SELECT a, lang, score, sum(hit) AS tp, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT a, lang, tp, sum(tp) OVER (PARTITION BY a, lang ORDER BY score DESC) AS tps, sum(n) OVER (PARTITION BY a, lang ORDER BY score DESC) AS ns, sum(tp) OVER (PARTITION BY a, lang) AS total FROM k)
SELECT lang, round(coalesce(sum(tp / nullif(total, 0)::DOUBLE * (tps / ns::DOUBLE)), 0), 6) AS ap FROM w GROUP BY a, lang"""


def q22_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(_scored(spark, sf_dir), ["lang"], "score", "hit").withColumn("auc", F.round("auc", 6))


Q22 = f"""WITH {SCORED}, r AS (SELECT lang, hit, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2::DOUBLE AS r FROM scored)
SELECT lang, round((sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2::DOUBLE) / nullif(sum(hit) * sum(1 - hit), 0), 6) AS auc FROM r GROUP BY lang"""


def q23_segment_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = segments(spark, sf_dir).withColumn("hour", W.bucket_by_floor(F.col("start"), 21600)).withColumn("score", F.round("value", 2))
    seen = e.select("clip", "hour", "seg_pos", "label", "score")
    truth = e.where("seg_pos % 3 = 0").select("clip", "hour", "seg_pos", "label")
    grid = A.score_grid(seen, truth, ["clip", "hour", "seg_pos"], vocabulary_of=["clip"])
    return A.max_pool(grid, ["clip", "hour"])


Q23 = f"""WITH {SEGMENTS_SQL}, e AS (SELECT clip, start // 21600 AS hour, seg_pos, label, round(value, 2) AS score FROM segments),
g AS (SELECT u.clip, u.hour, u.seg_pos, v.label FROM e u JOIN (SELECT DISTINCT clip, label FROM e) v USING (clip))
SELECT g.clip, g.hour, g.label, max(coalesce(e.score, 0)) AS score, max((e.label IS NOT NULL AND g.seg_pos % 3 = 0)::INT)::INT AS truth
FROM g LEFT JOIN e ON e.seg_pos = g.seg_pos AND e.clip = g.clip AND e.label = g.label GROUP BY 1, 2, 3"""


def q24_detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy("pos")).cast("long"))
    shape = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    gt = b.where("line % 2 = 0").select("image", *shape, "label", F.col("rank").alias("pos"))
    kept = matching.nms(b.select("image", *shape, "label", "score", F.col("rank").alias("pos")), ["image"], eps=1e-6)
    pred = kept.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 36 * 36)
    gt = gt.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 36 * 36)
    m = matching.detection_matches(pred, gt, ["image"]).withColumn("pos", F.col("image") * 1000 + F.col("pos"))
    n = gt.agg(F.count("*").alias("n_gt"))
    return M.detection_ap(m.crossJoin(F.broadcast(n)), ["threshold"]).select("threshold", F.round("ap", 6).alias("ap"))


Q24 = f"""WITH RECURSIVE {BOXES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY pos) AS id, (x1 - x0) * (y1 - y0) AS area FROM boxes),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS k FROM b),
pairs AS (SELECT a.image, a.id AS i, b.id AS j, a.k AS ka, b.k AS kb, a.label = b.label AS same, b.line % 2 = 0 AND b.area >= 1296 AS is_gt,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS c, a.area + b.area AS s FROM r a JOIN r b ON a.image = b.image),
u AS (SELECT *, c / (s - c + 1e-6::DOUBLE) AS iou FROM pairs),
m AS (SELECT image, kb, list(ka) AS before FROM u WHERE ka < kb AND iou >= 0.5 GROUP BY 1, 2),
n AS (SELECT image, 1 AS k, [1]::BIGINT[] AS kept FROM r WHERE k = 1
  UNION ALL SELECT n.image, n.k + 1, CASE WHEN m.before IS NOT NULL AND list_has_any(m.before, n.kept) THEN n.kept ELSE list_append(n.kept, r.k) END
  FROM n JOIN r ON r.image = n.image AND r.k = n.k + 1 LEFT JOIN m ON m.image = n.image AND m.kb = n.k + 1),
f AS (SELECT image, arg_max(kept, k) AS kept FROM n GROUP BY image),
p AS (SELECT r.*, row_number() OVER (PARTITION BY r.image ORDER BY score DESC, id) AS o FROM r JOIN f ON f.image = r.image AND list_contains(f.kept, r.k) WHERE area >= 1296),
cand AS (SELECT image, i, list({{'j': j, 'iou': iou, 'same': same}} ORDER BY iou DESC, j) AS c FROM u WHERE is_gt AND iou > 0 GROUP BY 1, 2),
q AS (SELECT p.image, p.o, p.score, p.id, coalesce(cand.c, []) AS c FROM p LEFT JOIN cand ON cand.image = p.image AND cand.i = p.id),
t AS (SELECT round(0.5::DOUBLE + 0.05::DOUBLE * i, 2) AS t FROM range(10) x(i)),
g AS (SELECT q.image, t, 0::BIGINT AS o, []::BIGINT[] AS used, 0 AS tp FROM q, t WHERE o = 1
  UNION ALL SELECT image, t, o, CASE WHEN ok THEN list_append(used, best.j) ELSE used END, ok::INT FROM
   (SELECT *, coalesce(best.iou >= t AND best.same, false) AS ok FROM
    (SELECT g.image, g.t, q.o, g.used, list_filter(q.c, lambda x: NOT list_contains(g.used, x.j))[1] AS best FROM g JOIN q ON q.image = g.image AND q.o = g.o + 1))),
h AS (SELECT g.t, g.tp, row_number() OVER w AS rank, sum(g.tp) OVER (w ROWS UNBOUNDED PRECEDING) AS tps FROM g JOIN q USING (image, o) WINDOW w AS (PARTITION BY g.t ORDER BY score DESC, image * 1000 + id))
SELECT t AS threshold, round(sum(CASE WHEN tp = 1 THEN tps / rank::DOUBLE ELSE 0 END) / (SELECT count(*) FROM b WHERE line % 2 = 0 AND area >= 1296), 6) AS ap FROM h GROUP BY t"""


def _der_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    truth = s.select("clip", "seg_pos", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.when(F.col("label") == "view", "Other").otherwise(F.col("label")).alias("label"))
    guess = truth.select("clip", "seg_pos", (F.col("start") + 30).alias("start"), (F.col("end") + 30).alias("end"), F.when(F.col("seg_pos") % 5 == 0, "wrong").otherwise(F.col("label")).alias("label"))
    return truth, guess


def q25_der(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, guess = _der_tables(spark, sf_dir)
    out = M.der_sweep(truth, guess, collar=1.0, bucket=3600)
    return out.select(*(F.round(c, 2).alias(c) for c in ("error", "total", "error_alone", "total_alone")), F.round("der", 6).alias("der"), F.round("der_alone", 6).alias("der_alone"))


Q25 = f"""WITH {SEGMENTS_SQL}, g AS (SELECT clip, seg_pos AS p, start * 100 AS s, fin * 100 AS e, CASE WHEN label = 'view' THEN 'Other' ELSE label END AS l FROM segments),
h AS (SELECT clip, p, s + 3000 AS s, e + 3000 AS e, CASE WHEN p % 5 = 0 THEN 'wrong' ELSE l END AS l FROM g),
c AS (SELECT clip, min(s) AS t0, max(e) AS t1 FROM g GROUP BY clip HAVING bool_or(l <> 'Other')),
x AS (SELECT DISTINCT clip, t FROM (SELECT clip, s AS t FROM g UNION ALL SELECT clip, e FROM g UNION ALL SELECT clip, s + 100 FROM g UNION ALL SELECT clip, e - 100 FROM g
  UNION ALL SELECT clip, s FROM h UNION ALL SELECT clip, e FROM h UNION ALL SELECT clip, t0 FROM c UNION ALL SELECT clip, t1 + 1 FROM c) JOIN c USING (clip) WHERE t BETWEEN t0 AND t1 + 1),
w AS (SELECT clip, t, lead(t) OVER (PARTITION BY clip ORDER BY t) - t AS w FROM x QUALIFY w IS NOT NULL),
a AS (SELECT w.clip, w.t, w.w, arg_max(l, p) AS truth, count(*) FILTER (l <> 'Other') AS speakers FROM w LEFT JOIN g ON g.clip = w.clip AND g.s <= t AND g.e > t GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT w.clip, w.t FROM w JOIN g ON g.clip = w.clip AND ((t >= s AND t < s + 100) OR (t >= e - 100 AND t < e))),
b AS (SELECT w.clip, w.t, arg_max(l, p) AS guess FROM w JOIN h ON h.clip = w.clip AND h.s <= t AND h.e > t GROUP BY 1, 2),
z AS (SELECT a.*, guess, coalesce(CASE WHEN truth IS NOT NULL THEN guess IS NULL OR guess <> truth ELSE guess IS NOT NULL END, false) AS bad
      FROM a LEFT JOIN b USING (clip, t) WHERE coalesce(truth, '') <> 'Other' AND (a.clip, a.t) NOT IN (SELECT (clip, t) FROM k)),
r AS (SELECT coalesce(sum(w) FILTER (bad), 0) / 100.0::DOUBLE AS error, coalesce(sum(w) FILTER (truth IS NOT NULL), 0) / 100.0::DOUBLE AS total,
  coalesce(sum(w) FILTER (bad AND coalesce(speakers, 0) <= 1), 0) / 100.0::DOUBLE AS error_alone, coalesce(sum(w) FILTER (truth IS NOT NULL AND speakers <= 1), 0) / 100.0::DOUBLE AS total_alone FROM z)
SELECT round(error, 2) AS error, round(total, 2) AS total, round(error_alone, 2) AS error_alone, round(total_alone, 2) AS total_alone, round(error / nullif(total, 0), 6) AS der, round(error_alone / nullif(total_alone, 0), 6) AS der_alone FROM r"""


def q26_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).drop("label", "line").withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    return matching.nms(b, ["image"]).select("image", "pos", "score")


Q26 = f"""WITH RECURSIVE {BOXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, pos) AS k FROM boxes),
o AS (SELECT a.image, a.k AS i, b.k AS j FROM r a JOIN r b ON a.image = b.image AND a.k < b.k
  WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
   / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))::DOUBLE >= 0.5),
m AS (SELECT image, j, list(i) AS before FROM o GROUP BY 1, 2),
s AS (SELECT image, 1 AS k, [1]::BIGINT[] AS kept FROM r WHERE k = 1
  UNION ALL SELECT s.image, s.k + 1, CASE WHEN m.before IS NOT NULL AND list_has_any(m.before, s.kept) THEN s.kept ELSE list_append(s.kept, r.k) END
  FROM s JOIN r ON r.image = s.image AND r.k = s.k + 1 LEFT JOIN m ON m.image = s.image AND m.j = s.k + 1),
f AS (SELECT image, arg_max(kept, k) AS kept FROM s GROUP BY image)
SELECT r.image, r.pos, r.score FROM r JOIN f ON f.image = r.image AND list_contains(f.kept, r.k)"""


def q27_track_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tracks of a shot in three sets (line number); two tracks are linked where they share a part number modulo 50."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("shot"), (F.col("l_linenumber") % 3).alias("set_idx"), (F.col("l_orderkey") % 7).alias("track_id"), (F.col("l_partkey") % 2000).alias("part")).distinct()
    a, b = (line.select("shot", "part", F.col("set_idx").alias(f"set_{s}"), F.col("track_id").alias(f"track_{s}")) for s in "ab")
    links = a.join(b, ["shot", "part"]).where("set_a < set_b").groupBy("shot", "set_a", "track_a", "set_b", "track_b").agg(F.count("*").alias("shared")).where("shared >= 1")
    ious = links.withColumn("iou", F.col("shared") / 10)
    members = matching.components(links, ["shot"])
    best = matching.representatives(members, ious, ["shot"])
    return best.select("shot", "component", "set_idx", "track_id", F.round("mean_iou", 6).alias("mean_iou"))


Q27 = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey % 300 AS shot, l_linenumber % 3 AS s, l_orderkey % 7 AS t, l_partkey % 2000 AS part FROM lineitem),
e AS (SELECT a.shot, a.s AS sa, a.t AS ta, b.s AS sb, b.t AS tb, count(*) AS n FROM l a JOIN l b ON a.shot = b.shot AND a.part = b.part AND a.s < b.s GROUP BY ALL),
b AS (SELECT shot, sa * 100 + ta AS u, sb * 100 + tb AS v, n FROM e UNION ALL SELECT shot, sb * 100 + tb, sa * 100 + ta, n FROM e),
r AS (SELECT DISTINCT shot, u AS node, u AS c FROM b UNION SELECT b.shot, b.v, r.c FROM r JOIN b ON b.shot = r.shot AND b.u = r.node),
k AS (SELECT shot, node, min(c) AS c FROM r GROUP BY 1, 2),
m AS (SELECT k.*, count(DISTINCT node // 100) OVER (PARTITION BY shot, c) AS sets FROM k),
p AS (SELECT x.shot, x.c, x.node, avg(coalesce(b.n, 0) / 10::DOUBLE) AS mean_iou FROM m x JOIN m y ON x.shot = y.shot AND x.c = y.c AND x.node <> y.node AND x.sets >= 2
      LEFT JOIN b ON b.shot = x.shot AND b.u = x.node AND b.v = y.node GROUP BY 1, 2, 3)
SELECT shot, (c // 100) || '_' || (c % 100) AS component, (node // 100)::INT AS set_idx, node % 100 AS track_id, round(mean_iou, 6) AS mean_iou FROM p
QUALIFY row_number() OVER (PARTITION BY shot, c ORDER BY mean_iou DESC, node) = 1"""


def q28_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order's odd lines are assigned to those of its even lines; exact ties, which the SQL leaves open, go as one thread running it has them."""
    b = boxes(spark, sf_dir)
    a = b.where("line % 2 = 1").select("image", F.col("pos").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    c = b.where("line % 2 = 0").select("image", F.col("pos").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    from rollcall.functions.boxes import Box

    pairs = a.join(c, "image").select("image", "a", "b", F.round(Box.of("a_").iou(Box.of("b_")), 6).alias("iou"))
    return matching.assign(pairs, ["image"], "a", "b", least=0.3, last=True)


Q28 = f"""WITH RECURSIVE {BOXES_SQL}, p AS (SELECT a.image, a.pos AS a, b.pos AS b, {{}} AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM boxes a JOIN boxes b ON a.image = b.image AND a.line % 2 = 1 AND b.line % 2 = 0),
u AS (SELECT image, a, b, round(c / (s - c)::DOUBLE, 6) AS iou, dense_rank() OVER (PARTITION BY image ORDER BY a) AS i, dense_rank() OVER (PARTITION BY image ORDER BY b) AS j FROM p),
k AS (SELECT image, max(i) AS n FROM u GROUP BY image),
t AS (SELECT image, 0::BIGINT AS n, []::BIGINT[] AS used, 0::DOUBLE AS total, []::BIGINT[] AS picks FROM k
  UNION ALL SELECT image, n, used, max(total), arg_max(picks, total) FROM
   (SELECT t.image, t.n + 1 AS n, CASE WHEN u.j IS NULL THEN t.used ELSE list_sort(list_append(t.used, u.j)) END AS used, t.total + coalesce(u.iou, 0) AS total, list_append(t.picks, coalesce(u.j, 0)) AS picks
    FROM t JOIN (SELECT image, i, j, iou FROM u WHERE iou > 0 UNION ALL SELECT DISTINCT image, i, NULL::BIGINT, NULL::DOUBLE FROM u) u ON u.image = t.image AND u.i = t.n + 1 WHERE u.j IS NULL OR NOT list_contains(t.used, u.j)) GROUP BY image, n, used),
f AS (SELECT image, arg_max(picks, (n, total)) AS picks FROM t GROUP BY image)
SELECT u.image, a, b, iou FROM u JOIN f ON f.image = u.image AND f.picks[u.i] = u.j WHERE iou >= 0.3""".replace("{}", "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("movie"), F.lit("f").alias("file"), F.col("vec_id").alias("speaker"), F.col("embedding").alias("feature"), (F.col("vec_id") % 7).alias("image"))


def q29_greedy_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.speaker_clusters(_vectors(spark, sf_dir), ["movie"], ["speaker"], threshold=0.25)
    top = A.largest_cluster(c, ["movie"], "cluster").select("movie", F.col("cluster").alias("main"))
    return c.join(top, "movie").select("movie", "speaker", "cluster", (F.col("cluster") == F.col("main")).alias("in_main"))


Q29 = """WITH RECURSIVE e AS (SELECT label AS movie, vec_id AS speaker, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT a.movie, a.k, list(b.k) AS near FROM e a JOIN e b ON a.movie = b.movie AND b.k < a.k AND list_cosine_similarity(a.v, b.v) > 0.25 GROUP BY 1, 2),
s AS (SELECT movie, 1 AS k, [0]::BIGINT[] AS c FROM e WHERE k = 1
  UNION ALL SELECT s.movie, s.k + 1, list_append(s.c, coalesce(list_min(list_transform(n.near, lambda i: s.c[i])), list_max(s.c) + 1))
  FROM s JOIN e ON e.movie = s.movie AND e.k = s.k + 1 LEFT JOIN n ON n.movie = s.movie AND n.k = s.k + 1),
f AS (SELECT movie, arg_max(c, k) AS c FROM s GROUP BY movie), r AS (SELECT e.movie, e.speaker, f.c[e.k]::INT AS cluster FROM e JOIN f USING (movie)),
m AS (SELECT movie, arg_max(cluster, (n, cluster)) AS main FROM (SELECT movie, cluster, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY movie)
SELECT r.movie, speaker, cluster, cluster = main AS in_main FROM r JOIN m USING (movie)"""


def q30_agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = K.dominant_cluster(_vectors(spark, sf_dir), ["movie"], "image", "speaker", cut=0.9, floor=0.0, quota=2)
    return picked.select("movie", "image", "speaker", F.round("sim", 4).alias("sim"))


Q30 = """WITH RECURSIVE e AS (SELECT label AS movie, vec_id AS speaker, vec_id % 7 AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.movie, a.k AS i, b.k AS j, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a JOIN e b ON a.movie = b.movie AND a.k < b.k),
s AS (SELECT movie, 0 AS step, list(k ORDER BY k) AS c FROM e GROUP BY movie
  UNION ALL SELECT movie, step + 1, list_transform(c, lambda x: CASE WHEN x = p.b THEN p.a ELSE x END) FROM
   (SELECT movie, step, any_value(c) AS c, arg_min({'a': a, 'b': b}, (m, a, b)) AS p, min(m) AS m FROM
     (SELECT s.movie, step, any_value(c) AS c, least(c[i], c[j]) AS a, greatest(c[i], c[j]) AS b, avg(d) AS m FROM s JOIN d ON d.movie = s.movie AND s.c[i] <> s.c[j] GROUP BY s.movie, step, least(c[i], c[j]), greatest(c[i], c[j])) GROUP BY movie, step) WHERE m < 0.9),
f AS (SELECT movie, arg_max(c, step) AS c FROM s GROUP BY movie), r AS (SELECT e.*, f.c[e.k] AS cluster FROM e JOIN f USING (movie)),
w AS (SELECT movie, arg_max(cluster, (n, -cluster)) AS cluster FROM (SELECT movie, cluster, count(DISTINCT image) AS n FROM r GROUP BY 1, 2) GROUP BY movie HAVING max(n) >= 2),
m AS (SELECT movie, list(x ORDER BY t) AS v FROM (SELECT r.movie, t, avg(v[t]) AS x FROM r JOIN w ON w.movie = r.movie AND w.cluster = r.cluster, range(1, 65) q(t) GROUP BY 1, 2) GROUP BY movie),
b AS (SELECT e.movie, image, speaker, list_cosine_similarity(e.v, m.v) AS sim FROM e JOIN m USING (movie) QUALIFY row_number() OVER (PARTITION BY e.movie, image ORDER BY sim DESC, speaker) = 1)
SELECT movie, image, speaker, round(sim, 4) AS sim FROM b QUALIFY sim >= 1 - 0.9::DOUBLE OR (sim >= 0 AND row_number() OVER (PARTITION BY movie ORDER BY sim DESC, speaker) <= 2)"""


def q31_near_dup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", K.simhash64(F.col("text")).alias("code"))
    return K.near_dup_greedy(d, ["source"], "code", "doc_id").select("source", "doc_id", "code")


Q31 = r"""WITH RECURSIVE w AS (SELECT source, doc_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '))) AS w FROM documents),
h AS (SELECT source, doc_id, ('0x' || md5(w)[1:16])::UBIGINT AS h FROM w), n AS (SELECT source, doc_id, count(*) AS n FROM h GROUP BY 1, 2),
b AS (SELECT source, doc_id, i, sum(((h >> i) & 1::UBIGINT)::INT) AS ones FROM h, range(64) r(i) GROUP BY ALL),
c AS (SELECT b.source, b.doc_id, string_agg(CASE WHEN 2 * ones > n THEN '1' ELSE '0' END, '' ORDER BY i DESC)::BIT AS code FROM b JOIN n USING (doc_id) GROUP BY 1, 2),
o AS (SELECT source, code, min(doc_id) AS doc_id, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS k FROM c GROUP BY 1, 2),
s AS (SELECT source, 1 AS k, [code] AS kept, true AS keep FROM o WHERE k = 1
  UNION ALL SELECT source, k, CASE WHEN keep THEN list_append(kept, code) ELSE kept END, keep FROM
   (SELECT o.source, o.k, kept, o.code, len(list_filter(kept, lambda x: bit_count(xor(x, o.code)) <= 6)) = 0 AS keep FROM s JOIN o ON o.source = s.source AND o.k = s.k + 1))
SELECT o.source, o.doc_id, o.code::BIGINT AS code FROM o JOIN s ON s.source = o.source AND s.k = o.k AND s.keep"""


def q32_anchored_two_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir).select("movie", "character", F.col("vec_id").alias("pos"), (F.col("vec_id") % 20).alias("image"), "feature")
    first = b.groupBy("character").agg(F.min("pos").alias("pos"))
    anchors, rest = b.join(first, ["character", "pos"], "left_semi"), b.join(first, ["character", "pos"], "left_anti")
    out = K.anchored_selection(rest, anchors, ["movie"], threshold=0.2, floor=0.1, quota=2)
    return out.select("character", "pos", "image", "own_sim", "rescued")


def _sims(name: str, targets: str) -> str:
    return f"""{name} AS (SELECT ch, pos, image, max(sim) FILTER (other = ch) AS own, max(sim) FILTER (other <> ch) AS rival
  FROM (SELECT i.ch, i.pos, i.image, t.ch AS other, round(list_cosine_similarity(i.v, t.v), 6) AS sim FROM i, {targets} t) GROUP BY 1, 2, 3),
best_{name} AS (SELECT * FROM {name} WHERE own IS NOT NULL AND (rival IS NULL OR round(own + 0.1::DOUBLE, 6) >= rival) QUALIFY row_number() OVER (PARTITION BY ch, image ORDER BY own DESC, pos) = 1)"""


Q32 = f"""WITH b AS (SELECT label::VARCHAR AS ch, vec_id AS pos, vec_id % 20 AS image, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT ch, min(pos) AS pos, arg_min(v, pos) AS v FROM b GROUP BY ch), i AS (SELECT * FROM b WHERE pos NOT IN (SELECT pos FROM a)),
{_sims("one", "a")},
m AS (SELECT ch, v FROM a WHERE ch IN (SELECT ch FROM i) UNION ALL SELECT i.ch, i.v FROM best_one JOIN i USING (ch, pos) WHERE own >= 0.2),
p AS (SELECT ch, list(x ORDER BY k) AS v FROM (SELECT ch, k, avg(v[k]) AS x FROM m, range(1, 65) r(k) GROUP BY 1, 2) GROUP BY ch),
{_sims("two", "p")},
k AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY own DESC, pos) AS r FROM best_two QUALIFY own >= 0.2 OR (r <= 2 AND own >= 0.1)),
s AS (SELECT * FROM two WHERE own >= 0.1 AND ch NOT IN (SELECT ch FROM k) QUALIFY row_number() OVER (PARTITION BY ch ORDER BY own DESC, pos) = 1)
SELECT ch AS character, pos, image, own AS own_sim, false AS rescued FROM k UNION ALL SELECT ch, pos, image, own, true FROM s"""


def q33_visual_audio_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    audio = s.select("clip", "seg_pos", "label", F.round(F.col("value") / 490, 4).alias("score"))
    seen = s.select("clip", (F.col("seg_pos") + 1).alias("seg_pos"), F.col("label"), F.lit(0.5).alias("synchronization_score"), F.round(F.col("value") / 300, 4).alias("classification_score"), F.col("seg_pos").alias("pos"))
    every = s.select("clip", "seg_pos").join(seen.drop("clip"), "seg_pos")
    return fusion.fuse(audio, every, ["clip", "seg_pos"], 0.3)


Q33 = f"""WITH {SEGMENTS_SQL}, v AS (SELECT seg_pos + 1 AS seg_pos, label, 0.5::DOUBLE * round(value / 300, 4) AS visual FROM segments),
a AS (SELECT clip, s.seg_pos, s.label, round(value / 490, 4) AS score, v.label AS seen, visual FROM segments s LEFT JOIN v USING (seg_pos))
SELECT clip, seg_pos, label, score, coalesce(score < 0.3 AND visual >= score, false) AS overridden, CASE WHEN score < 0.3 AND visual >= score THEN seen ELSE label END AS fused_label FROM a"""
