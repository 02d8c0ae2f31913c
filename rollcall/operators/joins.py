"""Join-shaped operators. Every one of them has an equi key, so it shuffles by that key or broadcasts a side by its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import normalise_name


class IntegrityError(ValueError):
    """A key that must be unique or known is not."""


def _some(df: DataFrame, *cols: str) -> list[str]:
    return [", ".join(map(str, r)) for r in df.select(*cols).distinct().limit(10).collect()]


def strict_lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """JN1: inner join in which every row must find its key; an error names up to ten that do not."""
    missing = _some(rows.join(table, keys, "left_anti"), *keys)
    if missing:
        raise IntegrityError(f"unknown keys: {missing}")
    return rows.join(table, keys)


def require_unique(table: DataFrame, keys: list[str], what: str = "duplicate keys") -> DataFrame:
    """table itself; an error names up to ten keys that occur twice (JN3's right side, SRC11's stems)."""
    twice = _some(table.groupBy(*keys).count().where("count > 1"), *keys)
    if twice:
        raise IntegrityError(f"{what}: {twice}")
    return table


def invert_map(movies: DataFrame, movie: str = "movie", clips: str = "clips") -> DataFrame:
    """JN2: (clip, movie) of a table with an array of clips per movie; a clip of two movies is an error."""
    flat = movies.select(F.explode(clips).alias("clip"), movie)
    twice = _some(flat.groupBy("clip").agg(F.count_distinct(movie).alias("n")).where("n > 1"), "clip")
    if twice:
        raise IntegrityError(f"clips of several movies: {twice}")
    return flat.distinct()


def left_with_default(rows: DataFrame, table: DataFrame, keys: list[str], **defaults: Column) -> DataFrame:
    """JN3: left join; columns of rows without a partner take their default. A repeated right key is an error."""
    out = rows.join(require_unique(table, keys), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def positional_join(left: DataFrame, right: DataFrame, key: str, items_left: str, items_right: str) -> DataFrame:
    """JN4: i-th element of one array with the i-th of the other per key; ends with the shorter one."""
    a = left.select(key, F.posexplode(items_left).alias("pos", items_left))
    b = right.select(key, F.posexplode(items_right).alias("pos", items_right))
    return a.join(b, [key, "pos"])


def known_only(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """JN5, FLT29."""
    return rows.join(table.select(*keys), keys, "left_semi")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """JN6, SET4: rows whose unit has not been written yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def _buckets(start: str, end: str, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor(F.col(end) / size).cast("long")))


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str, b_start: str, b_end: str, bucket: float | None = None) -> DataFrame:
    """JN7: pairs of closed intervals of the same keys that touch or overlap.

    With `bucket`, a length of the order of the intervals', only those that meet in a stretch of that length are compared:
    each goes to every stretch it covers, and a pair comes from the first one that both do. Worth it where a key has many.
    """
    touch = (F.col(a_start) <= F.col(b_end)) & (F.col(a_end) >= F.col(b_start))
    if bucket is None:
        return a.join(b, keys).where(touch)
    left = a.where(F.col(a_start) <= F.col(a_end)).withColumn("_b", _buckets(a_start, a_end, bucket))
    right = b.where(F.col(b_start) <= F.col(b_end)).withColumn("_b", _buckets(b_start, b_end, bucket))
    first = F.floor(F.greatest(a_start, b_start) / bucket)
    return left.join(right, [*keys, "_b"]).where(touch & (F.col("_b") == first)).drop("_b")


def trim_to(frames: DataFrame, frame: str, start: str, end: str) -> DataFrame:
    """JN8: frames inside a closed interval of their row."""
    return frames.where(F.col(frame).between(F.col(start), F.col(end)))


def trim_map(frames: Column, start: Column, end: Column) -> Column:
    """JN8 on a map from frame number."""
    return F.map_filter(frames, lambda k, _: k.between(start, end))


def label_at(points: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, end: str, label: str, order: str, bucket: float | None = None) -> DataFrame:
    """JN9: the label of the last listed segment whose [start, end) holds a point; null where none does.

    points must be unique by keys and `at`. With `bucket` a point meets only segments that cover its stretch of that length.
    """
    p, s, on = points.select(*keys, at), segments, list(keys)
    if bucket is not None:
        p = p.withColumn("_b", F.floor(F.col(at) / bucket).cast("long"))
        s = s.where(F.col(start) < F.col(end)).withColumn("_b", _buckets(start, end, bucket))
        on.append("_b")
    inside = p.join(s, on).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    best = inside.groupBy(*keys, at).agg(F.max_by(label, order).alias(label))
    return points.join(best, [*keys, at], "left")


def token_prefix_match(names: DataFrame, titles: DataFrame, name: str = "name", title: str = "title", pos: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """JN16: for each name the shortest title, first on ties, whose tokens prefix-pair with it.

    Every token of the one with fewer tokens must begin, or be the beginning of, some token of the other. Pairs are
    formed on the first letters of tokens, as paired tokens share theirs; names without tokens match nothing. With keys
    only names and titles of the same keys (a movie) meet.
    """
    keys = keys or []
    a = names.select(*keys, name).distinct().withColumn("ta", F.split(normalise_name(F.col(name)), " ")).where(normalise_name(F.col(name)) != "")
    b = titles.select(*keys, title, pos).withColumn("tb", F.split(normalise_name(F.col(title)), " ")).where(normalise_name(F.col(title)) != "")
    initials = lambda c: F.array_distinct(F.transform(c, lambda t: F.substring(t, 1, 1)))
    pairs = a.withColumn("i", F.explode(initials(F.col("ta")))).join(b.withColumn("i", F.explode(initials(F.col("tb")))), [*keys, "i"]).drop("i").distinct()
    less = F.size("ta") <= F.size("tb")
    short, long = F.when(less, F.col("ta")).otherwise(F.col("tb")), F.when(less, F.col("tb")).otherwise(F.col("ta"))
    hit = pairs.withColumns({"short": short, "long": long}).where(F.forall("short", lambda s: F.exists("long", lambda x: F.startswith(x, s) | F.startswith(s, x))))
    return hit.groupBy(*keys, name).agg(F.min_by(title, F.struct(F.length(title), pos)).alias(title))


def normalised_match(names: DataFrame, titles: DataFrame, name: str = "name", title: str = "title", pos: str = "pos") -> DataFrame:
    """JN15: names with the first title of the same normalised form."""
    first = titles.groupBy(normalise_name(F.col(title)).alias("key")).agg(F.min_by(title, pos).alias(title))
    return names.withColumn("key", normalise_name(F.col(name))).join(first, "key").drop("key")


def resolve_redirects(names: DataFrame, normalised: DataFrame, redirects: DataFrame, pages: DataFrame, name: str = "name") -> DataFrame:
    """JN19: name to normalised title to redirect target to page; names without a page are dropped."""
    n = normalised.select(F.col("source").alias(name), F.col("target").alias("_n"))
    r = redirects.select(F.col("source").alias("_t"), F.col("target").alias("_r"))
    out = names.join(n, name, "left").withColumn("_t", F.coalesce("_n", name)).join(r, "_t", "left")
    out = out.withColumn("page", F.coalesce("_r", "_t")).withColumn("match", F.when(F.col("_r").isNotNull(), F.lit("redirect")).otherwise(F.lit("exact")))
    return out.drop("_n", "_t", "_r").join(pages.select("page"), "page", "left_semi")


def cascade(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """JN20: each row takes its match from the first tier that has one. tiers: (name, table of key and match)."""
    found = reduce(lambda a, b: a.unionByName(b), (t.withColumns({"tier": F.lit(i), "tier_name": F.lit(n)}) for i, (n, t) in enumerate(tiers)))
    value = [c for c in found.columns if c not in (key, "tier", "tier_name")]
    best = found.groupBy(key).agg(F.min_by(F.struct(*value, "tier_name"), "tier").alias("m"))
    return rows.join(best, key).select(*rows.columns, "m.*")


def alias_match(cast: DataFrame, people: DataFrame, key: str = "name") -> DataFrame:
    """JN18: people whose alias set meets a cast entry's; the first entry (smallest pos) wins. Joined on single aliases."""
    a = people.select("person", F.explode("aliases").alias("alias"))
    b = cast.select(key, "pos", F.explode("aliases").alias("alias"))
    return a.join(b, "alias").groupBy("person").agg(F.min_by(key, "pos").alias(key))


def edit_ratio_match(names: DataFrame, choices: list[str], cutoff: float = 0.6) -> DataFrame:
    """JN17: for each name the closest choice by matching-blocks ratio, null below the cutoff.

    The ratio is that of Python's difflib, which no built-in equals. choices is one movie's cast list, short by nature.
    """
    from rollcall.storage import ship

    ship(names.sparkSession)

    @F.pandas_udf("string")
    def closest(batch):  # noqa: ANN001, ANN202
        import difflib

        return batch.map(lambda n: (difflib.get_close_matches(n, choices, n=1, cutoff=cutoff) or [None])[0] if n is not None else None)

    return names.withColumn("choice", closest(F.col("name")))


def dense_frames(predictions: DataFrame, clips: DataFrame, frame: str = "frame", boxes: str = "boxes") -> DataFrame:
    """JN21: a row for every frame 0..n-1 of each clip, gaps with an empty array; a frame outside that is an error.

    clips: movie, clip, n_frames. The check and the join share one pass.
    """
    bad = _some(predictions.join(clips, ["movie", "clip"]).where((F.col(frame) < 0) | (F.col(frame) >= F.col("n_frames"))), "movie", "clip", frame)
    if bad:
        raise IntegrityError(f"frames out of range: {bad}")
    grid = clips.where("n_frames > 0").select("movie", "clip", F.explode(F.expr("sequence(0, cast(n_frames as int) - 1)")).alias(frame))
    out = grid.join(predictions, ["movie", "clip", frame], "left")
    empty = F.array().cast(predictions.schema[boxes].dataType)
    return out.withColumn(boxes, F.coalesce(boxes, empty))


def path_contains(clips: DataFrame, paths: DataFrame, clip: str = "clip", path: str = "path") -> DataFrame:
    """JN22: the first path whose stem or a folder of which is the clip id, joined on the path's parts."""
    parts = paths.select(path, F.explode(F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")).alias(clip))
    return clips.join(parts.groupBy(clip).agg(F.min(path).alias(path)), clip)


def top_up_bank(bank: DataFrame, extra: DataFrame, k: int, keys: tuple[str, ...] = ("movie", "character")) -> DataFrame:
    """JN23: exemplars of `extra` added, in the order of a hash, to characters of the bank that have fewer than k.

    Only characters of both take part; where extra has too few, all of them are taken (D-12).
    """
    from pyspark.sql import Window

    thin = bank.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < k)
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*keys, "exemplar_id"), "exemplar_id")
    ranked = extra.join(thin, list(keys)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k - F.col("n"))
    return bank.unionByName(ranked.select(*bank.columns))


def cast_to_bank(cast: DataFrame) -> DataFrame:
    """JN24: (movie, actor, character); where an actor has several roles the later credit wins."""
    return cast.groupBy("movie", "actor").agg(F.max_by("character", "billing_pos").alias("character"))


def roles_of(ids: Column, roles: Column) -> Column:
    """JN25: names of an array of ids by a map."""
    return F.transform(ids, lambda i: F.try_element_at(roles, i))


def similarity_join(queries: DataFrame, bank: DataFrame, keys: list[str], top: int = 3, block: int = 20_000, part: int = 20_000) -> DataFrame:
    """JN10 with AGG2: mean of the `top` highest cosines per (query, character), inside the keys, by matrix products.

    queries: keys, query_id, feature; bank: keys, character, pos, feature. About `block` queries of a key meet about `part`
    exemplars of the key in a task; a bank is split by character, whose exemplars stay together, as its mean needs them
    all. Pairs never leave the function. A character's pos is its smallest.
    """
    import numpy as np
    import pandas as pd

    from rollcall.storage import ship

    ship(queries.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "query_id"]) + ", character string, pos long, score double"

    def score(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "query_id", "character", "pos", "score"]
        if q.empty or b.empty:
            kind = {"pos": "int64", "score": "float64"}
            return pd.DataFrame({n: pd.Series(dtype=kind.get(n, object)) for n in names})

        def unit(x: pd.Series) -> np.ndarray:
            m = np.array(x.tolist(), dtype=np.float64)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        out, qm = [], unit(q["feature"])
        whole = unit(b["feature"])
        for character, places in b.reset_index(drop=True).groupby("character", sort=False)["pos"]:
            bm = whole[places.index]
            for i in range(0, len(q), 4096):
                sims = qm[i : i + 4096] @ bm.T
                if sims.shape[1] > top:
                    sims = np.partition(sims, sims.shape[1] - top, axis=1)[:, -top:]
                part_q = q.iloc[i : i + 4096]
                out.append(part_q[[*keys, "query_id"]].assign(character=character, pos=int(places.min()), score=sims.mean(axis=1)))
        return pd.concat(out)[names]

    # a key with very many queries or exemplars is split into blocks of both, every two of which meet
    columns = [F.col(k).alias(k) for k in keys]
    q, b = queries.select(*columns, "query_id", "feature"), bank.select(*columns, "character", "pos", "feature")
    count = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = count(q, block, "_blocks").join(count(b, part, "_parts"), keys)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int")).withColumn("_part", each("_parts")).select(*columns, "_block", "_part", "query_id", "feature")
    b = b.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("character"), F.col("_parts")).cast("int")).withColumn("_block", each("_blocks"))
    b = b.select(*columns, *(F.col(c).alias(c) for c in ("_block", "_part", "character", "pos", "feature")))  # new names, as both may come from one table
    return q.groupBy(*keys, "_block", "_part").cogroup(b.groupBy(*keys, "_block", "_part")).applyInPandas(score, schema)


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.0, eps: bool = False) -> DataFrame:
    """JN11: pairs of boxes of one image with their IoU, of at least `least`. b's columns get the prefix b_."""
    from rollcall.functions.boxes import Box

    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    one, two = Box.of(), Box.of("b_")
    out = a.join(right, keys).withColumn("iou", one.iou_eps(two) if eps else F.coalesce(one.iou(two), F.lit(0.0)))
    return out.where(F.col("iou") >= least)
