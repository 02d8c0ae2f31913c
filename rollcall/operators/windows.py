"""Window-shaped operators, sorts, limits, sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """WIN3, LIM1, LIM3: the first k rows of each group in a total order; ranks beyond k are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_or_quota(df: DataFrame, keys: list[str], score: str, pos: str, threshold: float, floor: float | None, quota: int, strict: bool = False) -> DataFrame:
    """WIN4, FLT12: rows at or above the threshold, and of the others enough of the best, at or above the floor, for a quota.

    With strict the threshold itself does not suffice, as for voice exemplars (0.6, quota 10, no floor).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(pos))
    over = F.col(score) > threshold if strict else F.col(score) >= threshold
    enough = F.col("rank") <= quota
    if floor is not None:
        enough = enough & (F.col(score) >= floor)
    return df.withColumn("rank", F.row_number().over(w)).where(over | enough)


def relative_to_best(df: DataFrame, keys: list[str], score: str, ratio: float = 0.5) -> DataFrame:
    """FLT16: rows with at least a ratio of their group's highest score."""
    return df.withColumn("_m", F.max(score).over(Window.partitionBy(*keys))).where(F.col(score) >= ratio * F.col("_m")).drop("_m")


def first_occurrence(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """WIN5, SRC1's first-wins tables: one row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], total: str = "total_") -> DataFrame:
    """df with running sums in a total order of each group, the row itself included, and with each sum's total of the group.

    A group may be of any size, all rows among them: rows are dealt by ranges of keys and order and written, each range's
    sums are added up (a row for each range and group that it holds), and windows see one range's rows of a group.
    """
    from rollcall.storage import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    dealt = materialize(named.repartitionByRange(parts, *map(F.col, keys), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*keys, "_part").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    w = Window.partitionBy(*keys)
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_k_part"),
        *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_s_{n}").over(w).alias(f"{total}{n}") for n in sums),
    )
    on = dealt["_part"] == ranges["_k_part"]
    for k in keys:
        on = on & dealt[k].eqNullSafe(ranges[f"_k_{k}"])
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(ranges, on).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(own) for n in sums})
    return out.select(*df.columns, *sums, *(f"{total}{n}" for n in sums))


def renumber(df: DataFrame, keys: list[str], pos: str, out: str = "index") -> DataFrame:
    """WIN6: 0, 1, 2 ... in each group in the order of pos. Groups may be of any size, see running()."""
    counted = running(df, keys, [F.col(pos)], {"_i": F.lit(1)})
    return counted.withColumn(out, (F.col("_i") - 1).cast("int")).select(*df.columns, out)


def exact_dedup_renumber(df: DataFrame, keys: list[str], content_key: str, pos: str, out: str = "index") -> DataFrame:
    """ITR10: the lowest position of each content stays, and the survivors are renumbered."""
    return renumber(first_occurrence(df, [*keys, content_key], pos), keys, pos, out)


def ids_by_first_appearance(df: DataFrame, keys: list[str], item: str, pos: str, out: str = "id") -> DataFrame:
    """WIN7: (keys, item, id) with ids from 0 in the order in which items first appear."""
    first = df.groupBy(*keys, item).agg(F.min(pos).alias("first_pos"))
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos", item)) - 1)


def colour_of(index: Column, colours: list[str]) -> Column:
    """WIN7: the colour of an id; more ids than colours is an error."""
    return F.when(index >= len(colours), F.raise_error(F.lit("more characters than colours")).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, colours)), (index + 1).cast("int")))


def balanced_split(df: DataFrame, order: list[Column], k: int, keys: list[str] | None = None, out: str = "chunk") -> DataFrame:
    """WIN8: k contiguous chunks, the first of which are one longer. Without keys it numbers all rows by range, see row_index()."""
    if keys:
        return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    numbered = row_index(df, order)
    n = df.count()
    small, longer = n // k, n % k
    i = F.col("row_index")
    chunk = F.when(i < longer * (small + 1), F.floor(i / (small + 1))).otherwise(longer + F.floor((i - longer * (small + 1)) / max(small, 1)))
    return numbered.withColumn(out, chunk.cast("int")).drop("row_index")


def round_robin_split(df: DataFrame, order: list[Column], k: int, out: str = "worker") -> DataFrame:
    """WIN9: index modulo workers."""
    return row_index(df, order).withColumn(out, F.pmod("row_index", F.lit(k)).cast("int")).drop("row_index")


def row_index(df: DataFrame, order: list[Column], out: str = "row_index") -> DataFrame:
    """0-based place of each row in a total order, without a window over all rows in one task.

    Rows are dealt by range and written; each range's size (one number per partition) is summed up on the driver.
    """
    from rollcall.storage import materialize

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, base))
        base += sizes[p]
    if not offsets:
        return df.withColumn(out, F.lit(0).cast("long")).limit(0)
    table = spark.createDataFrame(offsets, "_part int, _base long")
    w = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_r", F.row_number().over(w)).join(F.broadcast(table), "_part").withColumn(out, F.col("_base") + F.col("_r") - 1).select(*df.columns, out)


def bucket_by_floor(column: Column, size: int) -> Column:
    """WIN10, WIN12."""
    return F.floor(column / size).cast("long")


def sliding_windows(df: DataFrame, keys: list[str], pos: str, value: str, n: int, step: int = 1) -> DataFrame:
    """WIN11: arrays of n consecutive values, from each step-th place; shorter ends are left out."""
    w = Window.partitionBy(*keys).orderBy(pos)
    out = df.withColumn("window", F.collect_list(value).over(w.rowsBetween(0, n - 1))).withColumn("_i", F.row_number().over(w) - 1)
    return out.where((F.size("window") == n) & (F.col("_i") % step == 0)).select(*keys, pos, "window")


def shift_align(a: DataFrame, b: DataFrame, keys: list[str], t: str, offset: int) -> DataFrame:
    """WIN13: b moved by offset against a; items without a partner at opposite ends are dropped."""
    return a.join(b.withColumn(t, F.col(t) - offset), [*keys, t])


def centred_average(df: DataFrame, keys: list[str], pos: str, value: str, half: int = 2, out: str = "average") -> DataFrame:
    """WIN14: mean of 2 * half + 1 values around each place; places near an end take the nearest full window's mean."""
    w = Window.partitionBy(*keys).orderBy(pos)
    frame = w.rowsBetween(-half, half)
    full = F.count(value).over(frame) == 2 * half + 1
    raw = df.withColumn("_m", F.when(full, F.avg(value).over(frame)))
    before = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn(out, F.coalesce("_m", before, after)).drop("_m")


def steps(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """WIN2: rows at which the value differs from the next one's."""
    nxt = F.lead(value).over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("_n", nxt).where(F.col("_n").isNotNull() & (F.col("_n") != F.col(value))).drop("_n")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """WIN1."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def desc_stable(value: str, pos: str) -> list[Column]:
    """SRT2, SRT3: descending, null as 0, ties by position."""
    return [F.coalesce(F.col(value), F.lit(0)).desc(), F.col(pos)]


def int_order(key: str) -> Column:
    """SRT4: keys that are numbers in text, in the order of numbers."""
    return F.col(key).cast("long")


def capped_pool(members: DataFrame, groups: DataFrame, keys: list[str], pos: str, least: int = 8, first: int = 10) -> DataFrame:
    """LIM2: where a group has fewer than `least` members, those of its first subgroups are added. groups: keys, subgroup, sub_pos, pos, member."""
    n = members.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = groups.join(n, keys, "left").where(F.coalesce("_n", F.lit(0)) < least)
    return members.unionByName(few.where(F.col("sub_pos") < first).select(*members.columns))


def hash_sample(df: DataFrame, keys: list[str], salt: list[str], k: int) -> DataFrame:
    """SMP1, SMP3: k rows of each group in the order of a hash of the salt columns: the same rows whatever the partitioning."""
    return top_k(df, keys, [F.xxhash64(*keys, *salt), *map(F.col, salt)], k).drop("rank")


def stratified_thirds(df: DataFrame, keys: list[str], pos: str, strata: int = 3) -> DataFrame:
    """SMP2: a hash-chosen row of each third; all rows of groups with fewer than three; up to two rows at the end are never chosen."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(pos)) - 1)
    out = out.withColumn("stratum", F.when(F.col("_n") < strata, F.col("_i")).otherwise(F.floor(F.col("_i") / F.floor(F.col("_n") / strata)).cast("int")))
    return top_k(out.where(F.col("stratum") < strata), [*keys, "stratum"], [F.xxhash64(*keys, "_i"), F.col("_i")], 1).drop("_n", "_i", "rank")


def hold_out(df: DataFrame, keys: list[str], pos: str, ratio: float) -> DataFrame:
    """SMP7: the first max(1, int(n * ratio)) rows in order are `val`, the others `train`."""
    w = Window.partitionBy(*keys)
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * ratio))
    return df.withColumn("_n", n).withColumn("split", F.when(F.row_number().over(w.orderBy(pos)) <= F.col("_n"), F.lit("val")).otherwise(F.lit("train"))).drop("_n")


def hash_split(df: DataFrame, key: list[str], percent: int = 95) -> DataFrame:
    """SMP8: train and val by a hash of the key, so the split stays as rows are added."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(*key), F.lit(100)) < percent, F.lit("train")).otherwise(F.lit("val")))


def ratio_mix(synthetic: DataFrame, real: DataFrame, key: list[str], n: int, ratio: float) -> DataFrame:
    """SMP9: int(n * ratio) synthetic rows and the rest real, each in the order of a hash."""
    k = int(n * ratio)
    pick = lambda df, m: df.orderBy(F.xxhash64(*key), *key).limit(m)
    return pick(synthetic, k).unionByName(pick(real, n - k))


def contrastive_pairs(df: DataFrame, keys: list[str], label: str, item: str) -> DataFrame:
    """SMP10: (anchor, positive, negatives) per item: the next item of its label and the hash-first item of every other label.

    Negatives are found per key among one chosen item a label, so no pair of items is formed.
    """
    w = Window.partitionBy(*keys, label).orderBy(item)
    first = F.first(item).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = df.withColumn("positive", F.coalesce(F.lead(item).over(w), first)).where(F.col("positive") != F.col(item))
    chosen = df.groupBy(*keys, label).agg(F.min_by(item, F.xxhash64(item)).alias("_x"))
    each = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("_x").alias("x")))).alias("_all"))
    out = pairs.join(each, keys) if keys else pairs.crossJoin(each)  # one row
    return out.withColumn("negatives", F.expr(f"transform(filter(_all, s -> s.l <> {label}), s -> s.x)")).drop("_all")


def keyed_union(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """SET1: one row per key; of several tables the leftmost that has the key wins."""
    rows = reduce(lambda a, b: a.unionByName(b), (t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)))
    return first_occurrence(rows, keys, "_p").drop("_p")


def fill_missing(rows: DataFrame, fallback: DataFrame, keys: list[str], value: str, source: str, name: str) -> DataFrame:
    """SET6: null values taken from a fallback table, with where they come from."""
    f = fallback.select(*keys, F.col(value).alias("_f"))
    out = rows.join(f, keys, "left")
    return out.withColumn(source, F.when(F.col(value).isNotNull(), F.col(source)).when(F.col("_f").isNotNull(), F.lit(name))).withColumn(value, F.coalesce(value, "_f")).drop("_f")


def disjoint(a: Column, b: Column) -> Column:
    """SET7."""
    return ~F.arrays_overlap(a, b)


def bag_union(*tables: DataFrame) -> DataFrame:
    """SET5: all rows of all tables, by column name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shot_order(movie: str = "movie", clip: str = "clip", shot: str = "shot_idx") -> list[Column]:
    """SRT1: by movie, clip and the number of the shot; for presentation, as no operator relies on order."""
    return [F.col(movie), F.col(clip), int_order(shot)]
