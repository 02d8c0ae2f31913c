"""Toxic passages: maximal scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

A token's log-odds of being in a toxic document shrink towards those of its first six bytes, these towards those of its
first four, and these towards the share of toxic documents: each level is the prior of the next. Less a constant that
makes ordinary text score negatively, they are summed over stretches of tokens; a linear scan finds every maximal
scoring stretch. How high the best stretch of a clean document of n tokens reaches follows an extreme-value law, fitted
on held-back labelled documents; so is the logistic curve that turns a document's evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm import codes as C
from rollcall.llm.common import documents, fetched, i64, rebatched
from rollcall.storage import ship

#: At most so many labelled rows are fitted on, chosen by a hash of their ids.
MAX_LABELLED = 24_000
PRIOR, DRIFT, LEVELS = 10.0, 2.5, (4, 6, None)
#: Documents of the sample, of either class, that a feature must be in to have log-odds of its own; a rarer one says little
#: beyond its prior and is read as that: as the next shorter prefix.
LEAST = 2
SIGNIFICANT = 0.05
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def token_features(part: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each level the hash of each token (a lower-cased word without outer punctuation), and each text's first token."""
    starts, ends, woffs = C.word_spans(part, offs)
    for _ in range(4):
        ends = ends - (_PUNCT[part[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
        starts = starts + (_PUNCT[part[starts]] & (ends - starts > 1)) if len(ends) else starts
    out = []
    for level, size in enumerate(LEVELS):
        stop = ends if size is None else np.minimum(starts + size, ends)
        out.append(C.word_codes(part, starts, stop, lower=True) ^ np.uint64((level + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    return out, woffs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have each feature: level, key, parent, n0, n1."""
    for batch in rebatched(batches):
        raw, offsets = C.utf8(batch.column(0))
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        for i, j in C.blocks(offsets):
            features, woffs = token_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(j - i), np.diff(woffs))
            for level, key in enumerate(features):
                if not len(key):
                    continue
                order = np.lexsort((doc, key))
                k, d = key[order], doc[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
                k, d, parent = k[new], d[new], (features[level - 1][order][new] if level else np.zeros(int(new.sum()), np.uint64))
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                one = np.add.reduceat(toxic[i:j][d], first)
                n = np.diff(np.append(first, len(k)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level, np.int32)), i64(k[first]), i64(parent[first]), i64(n - one), i64(one)], names=["level", "key", "parent", "n0", "n1"])


@dataclass
class Model:
    """Sorted feature hashes and log-odds by level, the extreme-value law (K, lam) and the logistic curve's weights."""

    keys: list[np.ndarray]
    odds: list[np.ndarray]
    K: float = 1e-6
    lam: float = 1.0
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def tokens(self, features: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each token: that of its most specific known feature, else 0."""
        out = np.zeros(len(features[0]))
        for key, known, odds in zip(features, self.keys, self.odds, strict=True):
            if not len(known) or not len(key):
                continue
            table = np.zeros(1 << 16, dtype=bool)
            table[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(key & np.uint64(0xFFFF)).astype(np.int64)]) if len(known) < 1 << 15 else np.arange(len(key))
            at = np.minimum(np.searchsorted(known, key[maybe]), len(known) - 1)
            hit = known[at] == key[maybe]
            out[maybe[hit]] = odds[at[hit]]
        return out

    def evidence(self, n: int, best: float, total: float) -> tuple[float, float]:
        p = -np.expm1(-self.K * max(n, 1) * np.exp(-self.lam * best))
        return float(-np.log(max(p, 1e-300))) if best > 0 else 0.0, float(np.log1p(total))

    def probability(self, n: int, best: float, total: float) -> float:
        a, b, c = self.curve
        x, y = self.evidence(n, best, total)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -35, 35))))


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Only positive values are visited; what lies between them is a difference of prefix sums. Each segment keeps the sum
    before it and the sum up to its end; a new one is merged leftwards while some segment with a smaller left sum ends lower.
    """
    sums = np.concatenate([[0.0], np.cumsum(values)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest earlier with smaller left sum
    for i in np.flatnonzero(values > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, end, left, right, j))
    return [(s, e, r - l) for s, e, l, r, _ in stack]


def _scan(column: pa.Array, model: Model, drift: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(tokens, maximal segments) of each text."""
    raw, offsets = C.utf8(column)
    for i, j in C.blocks(offsets):
        features, woffs = token_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        value = model.tokens(features) - drift
        for a, b in zip(woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
            yield b - a, maximal_segments(value[a:b]) if (value[a:b] > 0).any() else []


def _measure(model: Model, drift: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            rows = [(n, max((s[2] for s in segments), default=0.0), sum(s[2] for s in segments)) for n, segments in _scan(batch.column(0), model, drift)]
            n, best, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], names=["toxic", "n", "best", "total"])

    return f


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton's method. x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, prior: float = PRIOR, drift: float = DRIFT) -> Model:
    """Fit on at most `max_labelled` labelled documents outside fold 0: folds 1 to 3 give the log-odds, fold 4 the calibration.

    Repeated labels of a document count once, a toxic one before a clean one. Without any toxic and clean document in
    fold 4 the curve is a plain one around the share of toxic documents.
    The sample's size is bounded, so it is broadcast; each distinct text counts once. Labels other than 0 and 1 are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), fold(F.col("doc_id")).alias("fold"))
    known = known.orderBy(F.xxhash64("doc_id"), "toxic").limit(max_labelled)
    few = documents(docs).join(F.broadcast(known), "doc_id").groupBy("text_key").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.max("fold").alias("fold"))
    few = few.persist()  # bounded by the sample
    try:
        train = few.where("fold < 4").select("text", "toxic")
        sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        base = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 2.0)
        counted = train.mapInArrow(_count, "level int, key long, parent long, n0 long, n1 long").groupBy("level", "key").agg(F.first("parent").alias("parent"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        level_of, key_of, parent_of, n0, n1 = fetched(counted.where(F.col("n0") + F.col("n1") >= LEAST).select(F.col("level").cast("long"), "key", "parent", "n0", "n1"))
        model = Model([], [])
        known, known_share = np.zeros(0, np.int64), np.zeros(0)
        for level in range(len(LEVELS)):
            mine = np.flatnonzero(level_of == level)
            mine = mine[np.argsort(key_of[mine].view(np.uint64))]
            up = np.full(len(mine), base)
            if len(known):
                at = np.minimum(np.searchsorted(known.view(np.uint64), parent_of[mine].view(np.uint64)), len(known) - 1)
                up = np.where(known[at] == parent_of[mine], known_share[at], base)
            known, known_share = key_of[mine], (n1[mine] + prior * up) / (n0[mine] + n1[mine] + prior)
            model.keys.append(known.view(np.uint64))
            model.odds.append(np.log(known_share / (1 - known_share)) - np.log(base / (1 - base)))
        seen = few.where("fold = 4").select("text", "toxic").mapInArrow(_measure(model, drift), "toxic int, n long, best double, total double").toPandas()
    finally:
        few.unpersist()
    clean = seen[seen["toxic"] == 0]
    over = clean["best"][clean["best"] > 0]
    model.K = (len(over) + 0.5) / (clean["n"].sum() + 1.0)
    model.lam = float((len(over) + 1) / (over.sum() + 1.0))
    x = np.array([[1.0, *model.evidence(n, b, t)] for n, b, t in zip(seen["n"], seen["best"], seen["total"], strict=True)]).reshape(-1, 3)
    y = seen["toxic"].to_numpy(np.float64)
    if len(set(y)) == 2:
        model.curve = tuple(_logistic(x, y).tolist())
    else:  # too few labels for a curve: the share of toxic documents, and a plain odds scale
        model.curve = (float(np.log(base / (1 - base))), 0.5, 0.0)
    return model


SCHEMA = "doc_id long, score double, predicted int, passages array<struct<start: int, end: int, score: double>>"


def _score(model, drift: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in rebatched(batches):
            score, passages = [], []
            for n, segments in _scan(batch.column(1), m, drift):
                score.append(m.probability(n, max((s[2] for s in segments), default=0.0), sum(s[2] for s in segments)))
                passages.append([{"start": s, "end": e, "score": x} for s, e, x in segments if m.K * n * np.exp(-m.lam * x) < SIGNIFICANT])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(passages, kind)], names=["doc_id", "score", "predicted", "passages"])

    return f


def score_toxicity(docs: DataFrame, model: Model, drift: float = DRIFT) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) and the significant toxic passages as ranges of tokens.

    Only the text is used. Null and empty texts have no passages and the score of no evidence. One row per input row,
    null and repeated ids included; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    return documents(docs).select("doc_id", "text").mapInArrow(_score(shared, drift), SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, drift: float = DRIFT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below a half; null and empty texts stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    ship(docs.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in rebatched(batches):
            score = [m.probability(n, max((s[2] for s in segments), default=0.0), sum(s[2] for s in segments)) for n, segments in _scan(batch.column(at), m, drift)]
            text = batch.column(at)
            keep = np.array(score) < 0.5
            keep |= np.asarray(text.is_null()) | (np.asarray([len(t or "") == 0 for t in text.to_pylist()]) if not keep.all() else False)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(f, docs.schema)
