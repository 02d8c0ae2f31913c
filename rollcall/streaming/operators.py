"""Streaming forms of the append-only log, of order-dependent clustering and of the seen-set filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_log(units: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STM1: finished units appended as JSON lines, each once, across restarts; ends when the source is read up."""
    return units.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_units(units: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, failed: str, checkpoint: str) -> StreamingQuery:
    """STM2: results of each micro-batch under its number, so a retried one replaces itself; rows with an `error` go to `failed`."""

    def batch(df: DataFrame, number: int) -> None:
        out = work(df).persist()
        out.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/batch={number}")
        out.where("error is not null").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        out.unpersist()

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_speakers(segments: DataFrame, key: str = "movie", order: str = "pos", feature: str = "feature", threshold: float = 0.25) -> DataFrame:
    """STM3: greedy any-link clusters that grow with the stream; state is the members seen, per movie.

    Within a micro-batch segments are taken in order; across micro-batches in order of arrival. Returns key, order, cluster.
    """
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def f(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vectors, ids = ([np.array(v) for v in state.get[0]], list(state.get[1])) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in rows[feature]:
            v = np.asarray(v, dtype=float)
            n = np.linalg.norm(v)
            v = v / n if n else v
            near = [c for w, c in zip(vectors, ids, strict=True) if float(w @ v) > threshold]
            ids.append(min(near) if near else max(ids, default=-1) + 1)
            vectors.append(v)
            out.append(ids[-1])
        state.update(([v.tolist() for v in vectors], ids))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "cluster": out})

    return segments.groupBy(key).applyInPandasWithState(f, f"{key} {kinds[key]}, {order} {kinds[order]}, cluster int", "vectors array<array<double>>, ids array<int>", "append", GroupStateTimeout.NoTimeout)


def grow_bank(hits: DataFrame, key: str = "movie", least: float = 0.5, most: int = 30) -> DataFrame:
    """STM4: confident hits join their character's bank until it holds `most`; returns those that joined.

    hits: movie, character, exemplar_id, score. State is a count per character.
    """

    def f(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches))
        taken = rows[rows["score"] >= least].sort_values(["score", "exemplar_id"], ascending=[False, True]).head(most - n)
        state.update((n + len(taken),))
        yield taken[["exemplar_id", "score"]].assign(**{key: k[0], "character": k[1]})[[key, "character", "exemplar_id", "score"]]

    return hits.groupBy(key, "character").applyInPandasWithState(f, f"{key} string, character string, exemplar_id string, score double", "n int", "append", GroupStateTimeout.NoTimeout)


def drop_seen(items: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """STM5, exact form: the first of equal items within the watermark. time is a timestamp with zone; cast other kinds first."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drop_near_seen(items: DataFrame, key: str, code: str = "code", pos: str = "pos", most: int = 6) -> DataFrame:
    """STM5: items whose 64-bit code differs in more than `most` bits from every one kept before, per key; state is the kept codes."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def f(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = np.array(state.get[0] if state.exists else [], dtype=np.int64).view(np.uint64)
        rows = pd.concat(list(batches)).sort_values(pos)
        keep = []
        for c in rows[code].to_numpy(np.int64).view(np.uint64):
            ok = not len(kept) or int(np.bitwise_count(kept ^ c).min()) > most
            keep.append(ok)
            if ok:
                kept = np.append(kept, c)
        state.update((kept.view(np.int64).tolist(),))
        yield rows[keep][[key, pos, code]]

    return items.groupBy(key).applyInPandasWithState(f, f"{key} {kinds[key]}, {pos} {kinds[pos]}, {code} long", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def frame_windows(frames: DataFrame, keys: list[str], time: str, size: str, step: str, late: str = "1 minute") -> DataFrame:
    """STM6: rows per tumbling (step = size) or sliding window of event time, late rows dropped. time is a timestamp with zone."""
    from pyspark.sql import functions as F

    return frames.withWatermark(time, late).groupBy(F.window(time, size, step), *keys).agg(F.count("*").alias("n"))
