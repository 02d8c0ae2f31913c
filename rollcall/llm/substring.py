"""Substring dedup over words: Rabin-Karp hashes of word windows, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.repeats import BLOCK, REMOVED, Plan, finish, occurrences, variants
from rollcall.storage import materialize

WINDOW = 50
KINDS = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("removed", REMOVED, "array<struct<s: long, e: long>>")]


def digest(keep_text: bool):
    def f(text: str | None, spans: list[list[int]]) -> tuple:
        words = (text or "").encode().split()
        n, kept, at = len(words), [], 0
        for s, e in spans:
            kept += words[at:s]
            at = e
        kept = kept + words[at:] if spans else words
        body = b" ".join(kept)
        out = (n, n - len(kept), hashlib.sha256(body).hexdigest(), [{"s": s, "e": e} for s, e in spans])
        return (*out, body.decode()) if keep_text else out

    return f


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = 8) -> DataFrame:
    """(doc_id, text_key, s, e): stretches of words that windows starting in a document of smaller doc_id cover."""
    plan = Plan("word", window, min(gram, window))
    occ = occurrences(docs, plan, "low < high")
    blocks = occ.groupBy(*BLOCK).agg(F.min("doc_id").alias("owner"))
    # windows of blocks that differ from another block of their anchor, one row each, counted by their hash
    each = variants(docs, plan, blocks).select(*BLOCK, "owner", F.posexplode(F.expr("transform(sequence(0, int(n) - 1), i -> substring(payload, 8 * i + 1, 8))")).alias("j", "h"))
    each = each.withColumn("k", F.col("d") - F.col("j"))  # equal windows hold the same anchor at the same place
    first = each.groupBy("h", "a", "k").agg(F.min("owner").alias("first"))
    earlier = each.join(first, ["h", "a", "k"]).where("first < owner").groupBy(*BLOCK).agg(F.collect_list("j").alias("earlier"))
    # one row per distinct block; written, so that a block with very many occurrences can be split in the join below
    known = materialize(blocks.select(*BLOCK, "owner").join(earlier, BLOCK, "left"), "owners")
    whole = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + window - 1).alias("e")))
    part = F.transform("earlier", lambda j: F.struct((F.col("start") + j).alias("s"), (F.col("start") + j + window).alias("e")))
    seen = occ.join(known, BLOCK).select("doc_id", "text_key", F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).when(F.col("doc_id") == F.col("owner"), part)).alias("x"))
    return seen.select("doc_id", "text_key", "x.s", "x.e")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = 8, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256, removed (maximal
    word intervals) and with keep_text the kept words joined by one space. One row per input row. Null texts have no
    words; a row with null doc_id neither removes nor loses words; rows that share a doc_id count as one document, so
    they never remove from each other. Texts shorter than the window are left alone. An empty table gives no rows.
    Words are compared by 64 bits, windows by 64 bits over these together with the hash and place of their anchor,
    blocks by 128 bits of BLAKE2: none is a polynomial, but windows that differ can be taken as equal with the odds of
    such hashes.
    """
    assert 0 < gram <= window
    kinds = [*KINDS, ("kept", pa.string(), "string")] if keep_text else KINDS
    return finish(docs, repeated_spans(docs, window, gram), digest(keep_text), kinds)
