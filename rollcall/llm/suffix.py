"""Suffix-array dedup over bytes: front-coded sorted suffix runs, exchanged and merged by loser trees that know prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import codes as C
from rollcall.llm.common import i64, rebatched
from rollcall.llm.repeats import BLOCK, BLOCK_SCHEMA, REMOVED, Plan, finish, occurrences, variants
from rollcall.storage import materialize

WINDOW = 200
KINDS = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("removed", REMOVED, "array<struct<s: long, e: long>>")]
RUN_BYTES = 32 << 20
#: What a run says of a block beside its bytes: the columns of a block and its copies.
META = len(BLOCK) + 1
#: Payload bytes of a bucket, which one task merges in memory.
BUCKET_BYTES = 4 << 20
#: Anchors with more blocks than this have their windows grouped by value over many tasks instead of sorted in one.
HOT = 4096


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix of which the first `known` bytes are known to agree."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return known + ((m - known) * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8


def lcp_merge(runs: list[list[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge sorted runs of (common prefix with the string before, string, tag) into one such run.

    A loser tree keeps for every waiting string its common prefix with the winner that beat it. The longer prefix wins
    without a look at the strings; only equal ones are compared, from that place on.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    its = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    lcp, cur, tag = [0] * k, [None] * k, [None] * k

    def advance(r: int) -> None:
        lcp[r], cur[r], tag[r] = next(its[r], (-1, None, None))

    def beats(x: int, y: int) -> bool:
        a, b = cur[x], cur[y]
        if a is None or b is None:
            return b is None
        if lcp[x] != lcp[y]:
            return lcp[x] > lcp[y]
        h = common_prefix(a, b, lcp[x])
        won = h == len(a) or (h < len(b) and a[h] < b[h])
        lcp[y if won else x] = h
        return won

    for r in range(k):
        advance(r)
        lcp[r] = min(lcp[r], 0)
    loser, winner = [0] * k, [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        x, y = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (x, y) if beats(x, y) else (y, x)
    top = winner[1] if k > 1 else 0
    while cur[top] is not None:
        yield lcp[top], cur[top], tag[top]
        advance(top)
        node = (top + k) >> 1
        while node:
            if not beats(top, loser[node]):
                top, loser[node] = loser[node], top
            node >>= 1


def front_code(keys: list[bytes], order: list[int]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(prefix shared with the string before, remaining bytes one after another, their lengths) of keys in the given order."""
    shared, rest, before = [], [], b""
    for i in order:
        h = common_prefix(before, keys[i])
        shared.append(h)
        rest.append(keys[i][h:])
        before = keys[i]
    return np.array(shared, np.int32), b"".join(rest), np.array([len(x) for x in rest], np.int32)


def front_decode(shared: np.ndarray, rest: bytes, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
    before, at = b"", 0
    for h, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:h] + rest[at : at + n]
        at += n
        yield h, before


RUN_SCHEMA = "bucket long, shared binary, rest binary, lengths binary, meta binary, body binary"


def _sorted_runs(buckets: int):
    """Blocks to front-coded runs of their suffixes from the anchor on, a run for each bucket of anchors."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        meta = np.concatenate([m for m, _ in parts])
        bodies = [b for _, p in parts for b in p]
        bucket = (C.mix(meta[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        out = []
        for k in np.unique(bucket):
            mine = np.flatnonzero(bucket == k).tolist()
            keys = {i: int(meta[i, 0]).to_bytes(8, signed=True) + bodies[i][meta[i, 1] :] for i in mine}
            mine.sort(key=keys.__getitem__)
            shared, rest, lengths = front_code(keys, mine)
            left = b"".join(bodies[i][: meta[i, 1]] for i in mine)
            out.append((int(k), shared.tobytes(), rest, lengths.tobytes(), meta[mine].tobytes(), left))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names=["bucket", "shared", "rest", "lengths", "meta", "body"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in rebatched(batches):
            meta = np.stack([np.asarray(batch.column(i)) for i in range(META)], axis=1)
            parts.append((meta, batch.column(META).to_pylist()))
            size += batch.column(META).nbytes
            if size > RUN_BYTES:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    return f


def _repeated_windows(window: int):
    """Merged runs of one bucket to the windows that occur twice: equal left of the anchor and equal from it on."""

    def f(table: pa.Table) -> pa.Table:
        metas, lefts, runs, n = [], [], [], 0
        for row in table.to_pylist():
            meta = np.frombuffer(row["meta"], np.int64).reshape(-1, META)
            at = 0
            for d in meta[:, 1].tolist():
                lefts.append(row["body"][at : at + d])
                at += d
            decoded = front_decode(np.frombuffer(row["shared"], np.int32), row["rest"], np.frombuffer(row["lengths"], np.int32))
            runs.append([(h, key, n + i) for i, (h, key) in enumerate(decoded)])
            metas.append(meta)
            n += len(meta)
        order, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (h, _, tag) in enumerate(lcp_merge(runs)):
            order[i], right[i] = tag, h
        del runs
        meta = np.concatenate(metas)[order]
        keys = [int(meta[i, 0]).to_bytes(8, signed=True) + lefts[tag][::-1] for i, tag in enumerate(order.tolist())]
        by_left = sorted(range(n), key=keys.__getitem__)
        left = np.array([0] + [common_prefix(keys[a], keys[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64)
        right[0] = left[0] = -1
        by_left = np.array(by_left)
        d, size, copies = meta[:, 1], meta[:, 2], meta[:, META - 1]
        found, left_class = [], np.zeros(n, np.int64)
        for t in range(int(d.max()) + 1):  # bytes of the window before the anchor
            member = np.flatnonzero((d >= t) & (d - t < size))
            if not len(member):
                continue
            left_class[by_left] = np.cumsum(left < 8 + t)
            key = left_class[member] * (n + 1) + np.cumsum(right < 8 + window - t)[member]
            by_key = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], np.diff(key[by_key]) != 0]))
            times = np.repeat(np.add.reduceat(copies[member][by_key], new), np.diff(np.append(new, len(key))))
            hit = member[by_key[times > 1]]
            hit = hit[copies[hit] == 1]
            found.append(np.stack([hit, d[hit] - t], axis=1))
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        if not len(found):
            return pa.table([pa.array([], pa.int64())] * (len(BLOCK) + 2), names=[*BLOCK, "j", "m"])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 1)]))
        rows = meta[found[new, 0]]
        return pa.table([i64(rows[:, i]) for i in range(len(BLOCK))] + [i64(found[new, 1]), i64(np.diff(np.append(new, len(found))))], names=[*BLOCK, "j", "m"])

    return f


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = 32, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, s, e): stretches of bytes covered by windows that start somewhere else too."""
    spark = docs.sparkSession
    plan = Plan("byte", window, min(gram, window))
    occ = occurrences(docs, plan, "c > 1")
    blocks = occ.groupBy(*BLOCK).agg(F.count("*").alias("copies"))
    several = materialize(variants(docs, plan, blocks), "bodies")
    few = several.where(F.col("of_anchor") <= hot)
    held = few.agg(F.sum(F.length("payload").cast("long")).alias("n")).first().n or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    runs = few.select(*BLOCK, "copies", "payload").mapInArrow(_sorted_runs(buckets), RUN_SCHEMA)
    found = runs.groupBy("bucket").applyInArrow(_repeated_windows(window), f"{BLOCK_SCHEMA}, j long, m long").drop("bucket")
    # windows of anchors with very many different blocks: grouped by value, with counts combined before the shuffle
    each = several.where(F.col("of_anchor") > hot).select(*BLOCK, "copies", F.posexplode(F.expr(f"transform(sequence(0, int(n) - 1), i -> md5(substring(payload, i + 1, {window})))")).alias("j", "h"))
    twice = each.groupBy("h").agg(F.sum("copies").alias("times")).where("times > 1").select("h")
    found = found.unionByName(each.where("copies = 1").join(twice, "h").select(*BLOCK, F.col("j").cast("long").alias("j"), F.lit(1).cast("long").alias("m")))
    whole = blocks.where("copies > 1").select(*BLOCK, F.lit(0).cast("long").alias("j"), F.col("n").alias("m"))
    # one row per distinct block; written, so that a block with very many occurrences can be split in the join below
    parts = materialize(whole.unionByName(found).groupBy(*BLOCK).agg(F.collect_list(F.struct("j", "m")).alias("parts")), "parts")
    return occ.join(parts, BLOCK).select("doc_id", "text_key", "start", F.explode("parts").alias("p")).select("doc_id", "text_key", (F.col("start") + F.col("p.j")).alias("s"), (F.col("start") + F.col("p.j") + F.col("p.m") + window - 1).alias("e"))


def digest(keep_text: bool):
    def f(text: str | None, spans: list[list[int]]) -> tuple:
        raw = (text or "").encode()
        kept, at = [], 0
        for s, e in spans:
            kept.append(raw[at:s])
            at = e
        body = b"".join([*kept, raw[at:]])
        out = (len(raw), len(raw) - len(body), len(spans), hashlib.sha256(body).hexdigest(), [{"s": s, "e": e} for s, e in spans])
        return (*out, body.decode(errors="ignore") if spans else text) if keep_text else out

    return f


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = 32, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts anywhere else, the same document included.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed
    (maximal byte intervals) and with keep_text the kept bytes as text, less characters that a removal cut in two. One
    row per input row, null and repeated ids included: every row is a place of its own, so two equal rows of at least
    `window` bytes lose everything. Null texts are empty. An empty table gives no rows. Bytes are compared, save that
    copies of a whole block are told by 128 bits of BLAKE2 and windows of hot anchors by MD5.
    """
    assert 0 < gram <= window
    kinds = [*KINDS, ("kept", pa.string(), "string")] if keep_text else KINDS
    return finish(docs, repeated_spans(docs, window, gram, hot), digest(keep_text), kinds)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = 32, hot: int = HOT) -> DataFrame:
    """docs with the same columns: text without its repeated bytes, and n_chars, if there is one, counted anew.

    Rows that lose everything stay with empty text; null texts stay null.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = finish(docs, repeated_spans(docs, window, gram, hot), lambda text, spans: digest(True)(text, spans)[-1:], [("text", pa.string(), "string")], carry=carry)
    if "n_chars" in carry:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
