"""The driver's queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import toxicity
from rollcall.llm.fingerprint import compare_edited
from rollcall.llm.jaccard import jaccard_components
from rollcall.llm.packing import pack_documents
from rollcall.llm.pieces import encode_documents
from rollcall.llm.search import build_index, search
from rollcall.llm.substring import substring_dedup
from rollcall.llm.suffix import suffix_dedup
from rollcall.llm.token_counts import document_token_counts
from rollcall.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 20, over all documents."""
    docs = _table(spark, sf_dir, "documents")
    return search(build_index(docs), docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), 10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, with the scores of its three best segmentations and whether decoding gives it back."""
    out = encode_documents(_table(spark, sf_dir, "documents"), 3)
    return out.select("doc_id", "n_pieces", "ids_crc32", *(F.get("scores", F.lit(i)).alias(f"score_{i + 1}") for i in range(3)), "decoded")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), 4, 85, links=True)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWERED)} AS w FROM documents),
q AS (SELECT doc_id AS query_id, w FROM d WHERE doc_id % 20 = 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(sum(c * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term), s GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (h) WHERE first.owner < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(w[word.i], ' ' ORDER BY word.i) AS t, count(*) AS n
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.doc_id WHERE r.c < e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.c)) AS component_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
bits AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h,
         list_aggregate([lpad(bin(('0x' || substr(h, 10 * i + 1, 10))::BIGINT), 40, '0') for i in range(4)], 'string_agg', '') AS x FROM p),
r AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
      list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum([(substr(x, 5 * j + k, 1)::INT * (2 ** (5 - k))::INT) for k in range(1, 6)]) + 1)::INT, 1) for j in range(32)], 'string_agg', '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i, lag(win.i) OVER (PARTITION BY win.doc_id ORDER BY win.i) AS before FROM win JOIN twice USING (h)),
num AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 200) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM num GROUP BY doc_id, k),
gap AS (SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM span
        UNION ALL SELECT doc_id, 0, min(s) FROM span GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(x, 2 * gap.s + 1, 2 * (coalesce(gap.e, n) - gap.s)), '' ORDER BY gap.s) AS x FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id),
sums AS (SELECT doc_id, sum(e - s)::BIGINT AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k_search": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_warc": OP7_SQL, "op8_suffix_dedup": OP8_SQL}
