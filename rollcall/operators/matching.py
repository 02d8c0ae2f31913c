"""Operators on the boxes or tracks of one image or shot: suppression, greedy and optimal matching, track linking.

Each works group by group on Arrow batches; a group is an image or a shot, small by nature, and a bound on its size is
checked, since grouped functions cannot spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.aggregates import track_mean_iou
from rollcall.storage import ship

LARGEST_GROUP = 100_000
#: Columns up to which an assignment is found over their subsets; a row's place for none.
FEW, FREE = 8, 1 << 30


def iou_matrix(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """IoU of every box of a with every box of b; eps is added to the denominator."""
    side = lambda i, j: np.minimum(a[:, None, j], b[None, :, j]) - np.maximum(a[:, None, i], b[None, :, i])
    inter = np.maximum(side(0, 2), 0) * np.maximum(side(1, 3), 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter + eps
    return np.divide(inter, union, out=np.zeros_like(inter), where=union != 0)


def suppress(boxes: np.ndarray, scores: np.ndarray, pos: np.ndarray, threshold: float, eps: float) -> np.ndarray:
    """Places of the boxes that stay: by score, ties by position; a kept box removes those with IoU >= threshold."""
    order, kept = np.lexsort((pos, -scores)), []
    while len(order):
        kept.append(order[0])
        rest = order[1:]
        order = rest[iou_matrix(boxes[order[:1]], boxes[rest], eps)[0] < threshold]
    return np.array(kept, dtype=int)


BOX = ["x0", "y0", "x1", "y1"]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by keys, in frames that hold whole groups only, with each group's first and last + 1 row.

    One call of a function handles very many small groups; only a batch and one group are held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and held[-1][k].iloc[-1] != v[0]
        at = np.flatnonzero(new)
        if not len(at):
            held.append(batch)
            continue
        head = batch.iloc[: at[-1]]
        ready = pd.concat([*held, head], ignore_index=True) if held else head.reset_index(drop=True)
        before = len(ready) - len(head)
        edges = [0, *(before + at).tolist()] if before or at[0] else (before + at).tolist()
        yield ready, list(zip(edges[:-1], edges[1:], strict=True))
        held = [batch.iloc[at[-1] :]]
    if held:
        ready = pd.concat(held, ignore_index=True)
        yield ready, [(0, len(ready))]


def by_group(df: DataFrame, keys: list[str], order: list[Column | str], schema: str, f: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame]) -> DataFrame:
    """f over frames of whole groups; a group larger than the bound is an error, as it could not spill."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, groups in whole_groups(batches, keys):
            if max(b - a for a, b in groups) > LARGEST_GROUP:
                raise ValueError(f"a group has more than {LARGEST_GROUP} rows, which may not fit a task")
            yield f(frame, groups)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _iou(p: list[float], q: list[float], eps: float) -> float:
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    inter = w * h if w > 0 and h > 0 else 0.0
    union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter + eps
    return inter / union if union else 0.0


def nms(boxes: DataFrame, keys: list[str], threshold: float = 0.5, eps: float = 0.0, score: str = "score", pos: str = "pos") -> DataFrame:
    """ITR1: non-maximum suppression per image, whatever the class. eps 1e-6 is the metric's variant of IoU."""

    def f(frame: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        box, keep = frame[BOX].to_numpy(float).tolist(), np.zeros(len(frame), dtype=bool)
        for a, b in groups:
            if b - a > 64:
                keep[a + suppress(np.array(box[a:b]), np.zeros(b - a), np.arange(b - a), threshold, eps)] = True
                continue
            kept: list[list[float]] = []
            for i in range(a, b):
                if all(_iou(k, box[i], eps) < threshold for k in kept):
                    kept.append(box[i])
                    keep[i] = True
        return frame[keep]

    return by_group(boxes, keys, [F.col(score).desc(), F.col(pos)], _schema(boxes), f)


def greedy_match(boxes: list[list[float]], labels: list, gt: list[list[float]], true: list, thresholds: list[float]) -> list[list[int]]:
    """For each threshold which predictions, best score first, are correct: each takes the best free true box, first on ties.

    A wrong label or a low IoU leaves the box free, and the next best one is not tried.
    """
    ious = [[_iou(p, q, 1e-6) for q in gt] for p in boxes]
    out = []
    for t in thresholds:
        free, row = [True] * len(gt), []
        for i in range(len(boxes)):
            best, at = 0.0, -1
            for j, x in enumerate(ious[i]):
                if free[j] and x > best:
                    best, at = x, j
            tp = at >= 0 and best >= t and labels[i] == true[at]
            if tp:
                free[at] = False
            row.append(int(tp))
        out.append(row)
    return out


THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def detection_matches(pred: DataFrame, gt: DataFrame, keys: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """JN14: (keys, threshold, score, pos, tp) for all thresholds in one pass over each image."""
    thresholds = thresholds or THRESHOLDS
    rows = pred.select(*keys, *BOX, "label", "score", "pos", F.lit(0).alias("side")).unionByName(gt.select(*keys, *BOX, "label", F.lit(None).cast("double").alias("score"), "pos", F.lit(1).alias("side")))

    def f(frame: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        box, label, side = frame[BOX].to_numpy(float).tolist(), frame["label"].tolist(), frame["side"].to_numpy()
        at, t, tp = [], [], []
        for a, b in groups:
            m = a + int((side[a:b] == 0).sum())
            if m == a:
                continue
            for threshold, row in zip(thresholds, greedy_match(box[a:m], label[a:m], box[m:b], label[m:b], thresholds), strict=True):
                at += range(a, m)
                t += [threshold] * len(row)
                tp += row
        out = frame.iloc[at]
        return pd.DataFrame({**{k: out[k].to_numpy() for k in keys}, "threshold": t, "score": out["score"].to_numpy(), "pos": out["pos"].to_numpy(), "tp": tp})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", threshold double, score double, pos {kinds['pos']}, tp int"
    return by_group(rows, keys, ["side", F.col("score").desc(), "pos"], schema, f)


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns by shortest augmenting paths with potentials, cubic time."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in hungarian(cost.T))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def best_subset(rows: list[list[tuple[int, float]]], last: bool = False) -> list[tuple[int, int]]:
    """The assignment whose values have the largest sum in double, added row by row; on equal sums the earliest rows take the
    first columns, or, with last, none or else the last.

    rows: (column, value) of each row, values above 0. Exponential in the columns, for few of them.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in rows:
        after = {used: (total, (*picks, FREE)) for used, (total, picks) in best.items()}
        for used, (total, picks) in best.items():
            for j, v in row:
                if not used >> j & 1:
                    to, sum_, chosen = used | 1 << j, total + v, (*picks, j)
                    if to not in after or sum_ > after[to][0] or (sum_ == after[to][0] and (chosen > after[to][1] if last else chosen < after[to][1])):
                        after[to] = (sum_, chosen)
        best = after
    _, picks = max(best.values()) if last else min(best.values(), key=lambda x: (-x[0], x[1]))
    return [(i, j) for i, j in enumerate(picks) if j != FREE]


def assign(pairs: DataFrame, keys: list[str], a: str, b: str, iou: str = "iou", least: float = 0.5, last: bool = False) -> DataFrame:
    """JN13: optimal 1:1 assignment per group on 1 - IoU; pairs of at least `least` are accepted. Missing pairs have IoU 0.

    In groups of up to FEW columns, equal totals are told apart as best_subset does (last is its); in larger ones an optimal assignment
    is found by augmenting paths, in double.
    """

    def f(frame: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        x, y, v, at = frame[a].tolist(), frame[b].tolist(), frame[iou].tolist(), []
        for i, j in groups:
            rows, cols = {k: n for n, k in enumerate(sorted(set(x[i:j])))}, {k: n for n, k in enumerate(sorted(set(y[i:j])))}
            if len(rows) == len(cols) == 1:
                at += [i] if v[i] >= least else []
                continue
            where = {(rows[x[k]], cols[y[k]]): k for k in range(i, j)}
            if len(cols) <= FEW and least > 0:
                few: list[list[tuple[int, float]]] = [[] for _ in rows]
                for (r, c), k in where.items():
                    if v[k] > 0:
                        few[r].append((c, v[k]))
                found = best_subset(few, last)
            else:
                m = np.zeros((len(rows), len(cols)))
                for p, k in where.items():
                    m[p] = v[k]
                found = hungarian(1.0 - m)
            at += [where[p] for p in found if p in where and v[where[p]] >= least]
        return frame.iloc[at]

    few = pairs.select(*keys, a, b, iou)
    return by_group(few, keys, [a, b], _schema(few), f)


def link_tracks(boxes: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """JN12: accepted links (keys, set_a, track_a, set_b, track_b, iou) between every two track sets of a shot.

    boxes: keys, set_idx, track_id, frame, x0, y0, x1, y1.
    """
    a = boxes.withColumnRenamed("track_id", "track_a").withColumn("set_a", F.col("set_idx")).drop("set_idx")
    b = boxes.withColumnRenamed("track_id", "track_b").withColumn("set_b", F.col("set_idx")).drop("set_idx")
    sets = boxes.select(*keys, "set_idx").distinct()
    pairs = sets.withColumnRenamed("set_idx", "set_a").join(sets.withColumnRenamed("set_idx", "set_b"), keys).where("set_a < set_b")
    left = pairs.join(a, [*keys, "set_a"])
    ious = _pair_ious(left, b, keys)
    return assign(ious, [*keys, "set_a", "set_b"], "track_a", "track_b", "iou", least)


def _pair_ious(left: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = left.withColumn("_ta", F.struct("set_a", "track_a"))
    right = b.withColumn("_tb", F.col("track_b"))
    out = track_mean_iou(left, right, [*keys, "set_b"], ("_ta", "_tb"))
    return out.select(*keys, F.col("_ta.set_a").alias("set_a"), "set_b", F.col("_ta.track_a").alias("track_a"), F.col("_tb").alias("track_b"), "iou")


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """ITR2, ITR3: (keys, set_idx, track_id, component) of linked tracks whose component spans two sets or more.

    Within a shot the smallest (set, track) spreads along links; a shot's links are few, so this happens in its group.
    Components are named by their smallest (set, track).
    """
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}

    def spread(frame: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        ends = list(zip(*(frame[c].tolist() for c in ("set_a", "track_a", "set_b", "track_b")), strict=True))
        at, nodes = [], []
        for a, b in groups:
            root: dict[tuple, tuple] = {}

            def find(x: tuple, root: dict = root) -> tuple:
                root.setdefault(x, x)
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for e in ends[a:b]:
                x, y = find(e[:2]), find(e[2:])
                root[max(x, y)] = min(x, y)
            for x in list(root):
                at.append(a)
                nodes.append((*x, "_".join(map(str, find(x)))))
        out = pd.DataFrame({k: frame[k].iloc[at].to_numpy() for k in keys})
        out[["set_idx", "track_id", "component"]] = pd.DataFrame(nodes, columns=["set_idx", "track_id", "component"])
        return out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", set_idx {kinds['set_a']}, track_id {kinds['track_a']}, component string"
    out = by_group(links, keys, [], schema, spread)
    many = out.groupBy(*keys, "component").agg(F.count_distinct("set_idx").alias("n")).where("n >= 2").select(*keys, "component")
    return out.join(many, [*keys, "component"]).select(*keys, "set_idx", "track_id", "component")


def representatives(members: DataFrame, ious: DataFrame, keys: list[str]) -> DataFrame:
    """ITR4: of each component the track with the highest mean IoU with the others; ties by (set, track).

    members: as components() returns; ious: keys, set_a, track_a, set_b, track_b, iou, missing pairs 0.
    """
    m = members.select(*keys, "component", "set_idx", "track_id")
    a = m.select(*keys, "component", F.col("set_idx").alias("set_a"), F.col("track_id").alias("track_a"))
    b = m.select(*keys, "component", F.col("set_idx").alias("set_b"), F.col("track_id").alias("track_b"))
    pairs = a.join(b, [*keys, "component"]).where("set_a <> set_b or track_a <> track_b")
    both = ious.select(*keys, "set_a", "track_a", "set_b", "track_b", "iou").unionByName(ious.select(*keys, F.col("set_b").alias("set_a"), F.col("track_b").alias("track_a"), F.col("set_a").alias("set_b"), F.col("track_a").alias("track_b"), "iou"))
    scored = pairs.join(both, [*keys, "set_a", "track_a", "set_b", "track_b"], "left").groupBy(*keys, "component", "set_a", "track_a").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"))
    w = Window.partitionBy(*keys, "component").orderBy(F.col("mean_iou").desc(), "set_a", "track_a")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "component", F.col("set_a").alias("set_idx"), F.col("track_a").alias("track_id"), "mean_iou")


def merge_tracks(boxes: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """ITR5: the boxes of the tracks that represent the linked tracks of each shot."""
    links = link_tracks(boxes, keys, least)
    chosen = representatives(components(links, keys), links, keys)
    return boxes.join(chosen.select(*keys, "set_idx", "track_id"), [*keys, "set_idx", "track_id"])
