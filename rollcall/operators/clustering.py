"""Clustering, near-duplicate removal and exemplar selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.vectors import cosine
from rollcall.operators.aggregates import centroid, largest_cluster, prototype, widest_cluster
from rollcall.operators.windows import threshold_or_quota
from rollcall.storage import materialize, ship

#: Vectors of a group at most: of greedy clusters, and of average linkage.
LARGEST_GROUP, LARGEST_LINKED = 20_000, 100_000
#: Codes of a group that one task settles; of larger groups, codes that meet in a task are two blocks of so many on average.
ALONE, MEET = 4096, 1024


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def greedy_speakers(vectors: np.ndarray, threshold: float = 0.25) -> list[int]:
    """Cluster of each vector in order: the first cluster with a member more similar than the threshold, else a new one."""
    unit = _unit(np.asarray(vectors, dtype=float))
    ids: list[int] = []
    for i, v in enumerate(unit):
        near = np.flatnonzero(unit[:i] @ v > threshold)
        ids.append(min((ids[j] for j in near), default=max(ids, default=-1) + 1))
    return ids


def _nearest(mean: np.ndarray, of: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster of `of` the most similar other one of `live` (ascending), the first on ties, and that similarity."""
    others = mean[live]
    where, best = np.empty(len(of), dtype=np.int64), np.empty(len(of))
    step = max(1, (1 << 21) // len(live))
    for i in range(0, len(of), step):
        part = of[i : i + step]
        sim = mean[part] @ others.T
        sim[np.arange(len(part)), np.searchsorted(live, part)] = -np.inf
        at = np.argmax(sim, axis=1)
        where[i : i + step], best[i : i + step] = live[at], sim[np.arange(len(part)), at]
    return where, best


def average_link(vectors: np.ndarray, cut: float = 0.3) -> list[int]:
    """Average-linkage clusters by cosine distance, merged while the nearest two are closer than the cut; numbered by first member.

    The mean cosine of two clusters is the product of the means of their unit vectors, so no distances are held. A merge
    brings no cluster nearer to others than its parts were, so clusters that are each other's nearest may be merged in
    any order: all such pairs in a round, then, where a round has few, along a chain of nearest neighbours, which takes
    three steps a cluster at most. Equal vectors are one cluster from the start, if they may be merged at all.
    """
    raw = np.asarray(vectors, dtype=float)
    n = len(raw)
    unit = _unit(raw)
    unit[np.isnan(unit).any(axis=1)] = 0.0
    root = np.arange(n)
    if cut > 0:
        _, at, same = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        root = np.where(unit.any(axis=1), at[same.ravel()], root)
    live, slack = np.unique(root), 1e-12
    size = np.bincount(root, minlength=n).astype(float)
    mean, into = unit.copy(), np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        """Put clusters b into clusters a."""
        mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        into[b] = a

    near, best = np.full(n, -1), np.full(n, -np.inf)
    ask = live
    while len(live) > 1:
        near[ask], best[ask] = _nearest(mean, ask, live)
        live_near = near[live]
        pair = live[(live < live_near) & (near[live_near] == live) & (1.0 - best[live] < cut)]
        if not len(pair):
            if not (1.0 - best[live] < cut).any():
                live = live[:0]
            break
        gone = near[pair]
        merge(pair, gone)
        live = np.setdiff1d(live, gone, assume_unique=True)
        changed = np.zeros(n, dtype=bool)
        changed[pair] = changed[gone] = True
        ask = live[changed[live] | changed[near[live]]]
        if len(ask) > 64 * len(pair):
            break
    # what is too far from all others stays so: merged clusters are no nearer to it than their parts
    means, places, left = mean[live], live, len(live)
    dead = np.zeros(left, dtype=bool)
    for first in range(len(live)):
        chain = [] if dead[first] else [first]
        while chain and left > 1:
            top = chain[-1]
            sim = means @ means[top]
            sim[dead], sim[top] = -np.inf, -np.inf
            k = int(np.argmax(sim))
            if len(chain) > 1 and sim[chain[-2]] >= sim[k] - slack:
                k = chain[-2]
            if 1.0 - sim[k] >= cut:
                break
            if len(chain) > 1 and k == chain[-2]:
                a, b = sorted((top, k))
                merge(places[[a]], places[[b]])
                means[a] = mean[places[a]]
                dead[b], left = True, left - 1
                del chain[-2:]
                chain = chain or [a]
            else:
                chain.append(k)
    for i in range(n):  # parts go into clusters of smaller places, which come first
        into[i] = into[into[i]]
    number: dict[int, int] = {}
    return [number.setdefault(int(into[r]), len(number)) for r in root]


def _clusters(df: DataFrame, keys: list[str], order: list[str], feature: str, rule, out: str, most: int) -> DataFrame:
    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} int"

    def f(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"a group has {len(g)} vectors; at most {most} fit a task")
        g = g.sort_values(order, kind="stable")
        return g.assign(**{out: rule(np.array(g[feature].tolist(), dtype=float))})

    return df.groupBy(*keys).applyInPandas(f, schema)


def speaker_clusters(df: DataFrame, keys: list[str], order: list[str], feature: str = "feature", threshold: float = 0.25) -> DataFrame:
    """ITR6: greedy any-link clusters of each group, in order; clusters are never merged, so the order matters."""
    return _clusters(df, keys, order, feature, lambda v: greedy_speakers(v, threshold), "cluster", LARGEST_GROUP)


def agglomerative(df: DataFrame, keys: list[str], order: list[str], feature: str = "feature", cut: float = 0.3) -> DataFrame:
    """ITR7."""
    return _clusters(df, keys, order, feature, lambda v: average_link(v, cut), "cluster", LARGEST_LINKED)


def dominant_cluster(instances: DataFrame, keys: list[str], image: str, order: str, feature: str = "feature", cut: float = 0.3, floor: float = 0.0, quota: int = 0) -> DataFrame:
    """ITR8: the cluster that covers most images; by similarity to its centroid the best instance of each image, then threshold 1 - cut or quota."""
    clustered = materialize(agglomerative(instances, keys, [order], feature, cut), "clusters")  # read twice
    wide = widest_cluster(clustered, keys, "cluster", image).select(*keys, "cluster")
    centre = centroid(clustered.join(wide, [*keys, "cluster"]), keys, feature, "raw_mean")
    scored = instances.join(centre, keys).withColumn("sim", cosine(F.col(feature), F.col("centroid"))).drop("centroid")
    w = Window.partitionBy(*keys, image).orderBy(F.col("sim").desc(), order)
    best = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return threshold_or_quota(best, keys, "sim", order, 1 - cut, floor, quota)


def match_speakers(segments: DataFrame, keys: list[str], file: str, speaker: str, feature: str = "feature", threshold: float = 0.25) -> DataFrame:
    """ITR12: centroid of each (file, local speaker), greedy clusters in that order, and the segments of the largest cluster."""
    local = centroid(segments, [*keys, file, speaker], feature, "mean_of_units")
    clustered = speaker_clusters(local, keys, [file, speaker], "centroid", threshold)
    main = largest_cluster(clustered, keys, "cluster").select(*keys, "cluster")
    chosen = clustered.join(main, [*keys, "cluster"]).select(*keys, file, speaker)
    return segments.join(chosen, [*keys, file, speaker], "left_semi")


def segment_speakers(segments: DataFrame, keys: list[str], order: list[str], bank_scores, feature: str = "feature", threshold: float = 0.25) -> DataFrame:
    """The clustered way to identify speech (D-2's intent): segments are clustered, each cluster's centroid is identified by
    bank_scores(centroids) -> keys, cluster, label, score, and a segment's score is multiplied by its cosine to the centroid."""
    clustered = speaker_clusters(segments, keys, order, feature, threshold)
    centre = centroid(clustered, [*keys, "cluster"], feature, "sum_of_units")
    named = bank_scores(centre).join(centre, [*keys, "cluster"])
    out = clustered.join(named, [*keys, "cluster"])
    return out.withColumn("score", F.col("score") * cosine(F.col(feature), F.col("centroid"))).drop("centroid")


def near_dup_keep(codes: np.ndarray, most: int = 6) -> np.ndarray:
    """Which 64-bit codes stay when each is dropped if it differs in at most `most` bits from one kept before."""
    kept: list[int] = []
    keep = np.zeros(len(codes), dtype=bool)
    seen = np.zeros(len(codes), dtype=np.uint64)
    for i, c in enumerate(codes.astype(np.uint64)):
        if not kept or np.bitwise_count(seen[: len(kept)] ^ c).min() > most:
            seen[len(kept)] = c
            kept.append(i)
            keep[i] = True
    return keep


def _near(rows: DataFrame, keys: list[str], code: str, pos: str, most: int, earlier: bool) -> DataFrame:
    """Rows within `most` bits of an earlier row of their group or, if not earlier, rows not kept within that of a kept one.

    Codes that near have one of most + 1 segments of bits in common. Rows meet by segment; those that share one are split
    into blocks, every two of which meet in a task, and no pairs leave it.
    """
    edge = [64 * i // (most + 1) for i in range(most + 2)]
    parts = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
    placed = rows.withColumn("_s", F.explode(F.array(*parts)))
    on = [*keys, "_s"]
    sizes = materialize(placed.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on, F.ceil(F.col("n") / MEET).cast("int").alias("_n")), "segments")
    met = placed.join(sizes, on).withColumn("_block", F.pmod(F.xxhash64(code), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = met.withColumns({"_b1": F.least("_block", "_other"), "_b2": F.greatest("_block", "_other")}).drop("_other", "_n")

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([pos, code])
        c, block, kept = g[code].to_numpy(np.int64).view(np.uint64), g["_block"].to_numpy(), g["_kept"].to_numpy(bool)
        across = bool(g["_b1"].iloc[0] != g["_b2"].iloc[0])
        at, hit = np.arange(len(g)), np.zeros(len(g), dtype=bool)
        for x in np.split(at, range(256, len(g), 256)):
            ok = np.bitwise_count(c[x, None] ^ c) <= most
            ok &= x[:, None] < at if earlier else kept[x, None] & ~kept
            if across:
                ok &= block[x, None] != block
            hit |= ok.any(axis=0)
        return g.loc[hit, columns]

    columns = rows.columns
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return met.groupBy(*on, "_b1", "_b2").applyInPandas(f, schema).distinct()


def near_dup_greedy(df: DataFrame, keys: list[str], code: str, pos: str, most: int = 6) -> DataFrame:
    """ITR11: rows that stay, per group, when near duplicates of kept rows go, in the order of pos.

    Equal codes are dropped first, with combining before the shuffle, so copies do not count towards the group's size.
    Groups of any size work: in rounds, codes without an earlier near one stay and those near to these go, until what is
    left of each group fits one task. A round needs no more memory for larger groups; there are as many rounds as chains
    of near codes in the order of pos are long, at most.
    """
    spark = df.sparkSession
    ship(spark)
    first = df.groupBy(*keys, code).agg(F.min(pos).alias(pos))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields)
    first = materialize(first, "codes")
    names, ids = first.columns, [*keys, code]
    large = first.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > ALONE).drop("n")
    large = materialize(large, "large")
    small, left, done = first.join(large, keys, "left_anti"), first.join(large, keys, "left_semi"), []
    while (left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > ALONE:
        late = materialize(_near(left.withColumn("_kept", F.lit(False)), keys, code, pos, most, True).select(*names), "late")
        stays = materialize(left.join(late, ids, "left_anti"), "stays")
        done.append(stays)
        both = stays.withColumn("_kept", F.lit(True)).unionByName(late.withColumn("_kept", F.lit(False)))
        left = materialize(late.join(_near(both, keys, code, pos, most, False).select(*ids), ids, "left_anti"), "left")

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([pos, code])
        return g[near_dup_keep(g[code].to_numpy(np.int64).view(np.uint64), most)]

    kept = small.unionByName(left).groupBy(*keys).applyInPandas(f, schema)
    for stays in done:
        kept = kept.unionByName(stays)
    return df.join(kept, [*keys, code, pos], "left_semi")


def sign_bits(hashes: pd.Series) -> pd.Series:
    """A 64-bit code for each array of hashes: a bit is 1 where more of the hashes have it than not."""
    out = []
    for h in hashes:
        bits = np.unpackbits(np.asarray(h, dtype=np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), signed=True))
    return pd.Series(out, dtype="int64")


def simhash64(text: Column) -> Column:
    """VEC5's stand-in for text: the signs of the sums of its distinct words' hash bits (the first 64 of MD5). Words are
    hashed in the JVM; summing 64 bits of each word is the one step that built-in functions do far more slowly."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " "))
    return F.pandas_udf(sign_bits, "long")(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 16), 16, -10).cast("long")))


# Anchored selection in two rounds


def _rivals(instances: DataFrame, targets: DataFrame, keys: list[str], who: str, target: str, feature: str) -> DataFrame:
    """own_sim and the best similarity to another character's target, for each instance."""
    t = targets.select(*keys, F.col(who).alias("_who"), F.col(target).alias("_t"))
    pairs = instances.join(t, keys).withColumn("_s", F.round(cosine(F.col(feature), F.col("_t")), 6))
    own = F.col("_who") == F.col(who)
    ids = [c for c in instances.columns if c != feature]
    return pairs.groupBy(*ids).agg(F.max(F.when(own, F.col("_s"))).alias("own_sim"), F.max(F.when(~own, F.col("_s"))).alias("rival_sim"))


def veto_and_best(scored: DataFrame, keys: list[str], who: str, image: str, pos: str, margin: float = 0.1) -> DataFrame:
    """WIN15, WIN16: instances that a rival does not beat by more than the margin; of each image the best, first on ties."""
    ok = scored.where(F.col("own_sim").isNotNull() & (F.col("rival_sim").isNull() | (F.round(F.col("own_sim") + margin, 6) >= F.col("rival_sim"))))
    w = Window.partitionBy(*keys, who, image).orderBy(F.col("own_sim").desc(), pos)
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def anchored_selection(
    instances: DataFrame, anchors: DataFrame, keys: list[str], who: str = "character", image: str = "image", pos: str = "pos", feature: str = "feature",
    threshold: float = 0.5, floor: float = 0.35, quota: int = 2, margin: float = 0.1,
) -> DataFrame:
    """ITR9: exemplars of each character from its retrieved images, in two rounds.

    Round 1 compares instances with the anchors of all characters; its confident picks and the anchor make a prototype
    (AGG17). Round 2 compares with the prototypes of characters that have retrieved images, takes the best instance of
    each image and keeps by threshold or quota (WIN4). A character left without any takes its best instance at or above
    the floor, veto or not (WIN17).
    """
    one = veto_and_best(_rivals(instances, anchors, keys, who, feature, feature), keys, who, image, pos, margin)
    picks = one.select(*keys, who, pos, "own_sim").join(instances.select(*keys, who, pos, feature), [*keys, who, pos])
    with_images = instances.select(*keys, who).distinct()
    protos = prototype(picks, anchors.join(with_images, [*keys, who], "left_semi"), [*keys, who], feature, "own_sim", threshold)
    scored = _rivals(instances, protos, keys, who, "centroid", feature)
    two = threshold_or_quota(veto_and_best(scored, keys, who, image, pos, margin), [*keys, who], "own_sim", pos, threshold, floor, quota)
    w = Window.partitionBy(*keys, who).orderBy(F.col("own_sim").desc(), pos)
    empty = scored.where(F.col("own_sim") >= floor).join(two.select(*keys, who).distinct(), [*keys, who], "left_anti")
    rescued = empty.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return two.withColumn("rescued", F.lit(False)).unionByName(rescued.withColumn("rescued", F.lit(True)))
