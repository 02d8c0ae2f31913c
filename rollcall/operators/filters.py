"""Label rules, score rules and other row predicates. Which side of a threshold counts is part of each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.boxes import Box

# Fixed values.
LABEL_ALIASES = {
    "Agnes": "Agnes Gru",
    "Edith": "Edith Gru",
    "Margo": "Margo Gru",
    "Gru": "Felonius Gru",
    "Kyle": "Kyle Gru",
    "Minion": "Minions",
    "Bob the Minion": "Minions",
    "Tim the Minion": "Minions",
    "Manfred": "Manny",
    "Other Mother": "The Beldam (Other Mother)",
    "Uncle Aaron": "Aaron Davis",
    "Jefferson Davis": "Jefferson Morales",
    "Hero Boy": "Hero Boy (Chris)",
}
FRAME_ALIASES = {"Agnes": "Agnes Gru", "Edith": "Edith Gru", "Margo": "Margo Gru", "Gru": "Felonius Gru", "Kyle": "Kyle Gru", "Minion": "Minions"}
FRAME_ALIAS_MOVIE = "Despicable Me"
SPEECH_TRUTH = {"Felonious Gru": "Felonius Gru", "Nancy": "Other", "Nana Noodleman": "Other"}


def alias(label: Column, aliases: dict[str, str] = LABEL_ALIASES) -> Column:
    """FLT1: the label's alias, itself if it has none. A literal map, so no join."""
    pairs = [F.lit(x) for p in aliases.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def movie_alias(movie: Column, label: Column) -> Column:
    """FLT2: true labels of one movie only."""
    return F.when(movie == FRAME_ALIAS_MOVIE, alias(label, FRAME_ALIASES)).otherwise(label)


def clean_truth(label: Column) -> Column:
    """FLT3: true speech labels: one renamed, two to Other."""
    return alias(label, SPEECH_TRUTH)


def label_prefix(label: Column) -> Column:
    """FLT4: text before the first slash."""
    return F.split_part(label, F.lit("/"), F.lit(1))


def large_enough(box: Box, least: int = 36 * 36) -> Column:
    """FLT5: boxes smaller than this are dropped; predictions only after NMS."""
    return box.area() >= least


def has_area(box: Box) -> Column:
    """FLT6."""
    return box.raw_area() > 0


def speech_rate(duration: Column, words: Column, most: float = 1.5) -> Column:
    """FLT8: seconds per word below the limit; no words are no speech."""
    return F.coalesce(F.try_divide(duration, words) < most, F.lit(False))


def recognised(score: Column, threshold: float = 0.45) -> Column:
    """FLT9."""
    return score >= threshold


def confident_track(score: Column, frames: Column) -> Column:
    """FLT10, FLT11: above a half, and more than 15 frames left after trimming."""
    return (score > 0.5) & (frames > 15)


def open_set(label: Column, score: Column, threshold: float = 0.15, alpha: float = 0.15) -> tuple[Column, Column]:
    """FLT13: a low score becomes Other with score (1 - score) * alpha."""
    low = score <= threshold
    return F.when(low, F.lit("Other")).otherwise(label), F.when(low, (1 - score) * alpha).otherwise(score)


def open_set_label(label: Column, score: Column, threshold: float = 0.15) -> Column:
    """FLT14: the label only."""
    return F.when(score <= threshold, F.lit("Other")).otherwise(label)


def confidence_class(image: Column, source: Column, match: Column) -> Column:
    """FLT15."""
    sure = (source == "infobox") & match.isin("exact", "redirect")
    return F.when(image.isNull(), F.lit("missing")).when(F.coalesce(sure, F.lit(False)), F.lit("confident")).otherwise(F.lit("low"))


def min_side(box: Box, least: int = 48) -> Column:
    """FLT17."""
    return F.least(box.width, box.height) >= least


def without_group_boxes(boxes: DataFrame, keys: list[str], box_id: str, share: float = 0.8, most: int = 2) -> DataFrame:
    """FLT18: boxes that contain `most` or more other boxes of their image go. Pairs are formed per image only."""
    cols = ("x0", "y0", "x1", "y1")
    inner = boxes.select(*keys, F.col(box_id).alias("_i"), *(F.col(c).alias(f"i_{c}") for c in cols))
    pairs = boxes.join(inner, keys).where((F.col(box_id) != F.col("_i")) & (Box.of().containment(Box.of("i_")) > share))
    group = pairs.groupBy(*keys, box_id).agg(F.count("*").alias("_n")).where(F.col("_n") >= most)
    return boxes.join(group.select(*keys, box_id), [*keys, box_id], "left_anti")


def candidates(boxes: DataFrame, keys: list[str], box_id: str, score: str, most: int = 5) -> DataFrame:
    """FLT16, FLT17, FLT18 and LIM3 in this order: boxes worth a crop of each image."""
    from rollcall.operators.windows import relative_to_best, top_k

    kept = relative_to_best(boxes, keys, score).where(min_side(Box.of()))
    return top_k(without_group_boxes(kept, keys, box_id), keys, [F.col(score).desc(), F.col(box_id)], most).drop("rank")


def sharp(variance: Column, least: float = 15.0) -> Column:
    """FLT19: the Laplacian variance is a column; computing it is the image model's part."""
    return variance >= least


def of_class(label: Column, wanted: int = 0) -> Column:
    """FLT20."""
    return label == wanted


def image_size_ok(width: Column, height: Column, kind: str = "portrait") -> Column:
    """FLT21: at least 120 a side for portraits, 200 for galleries; for searches 128 and an aspect of at most 3."""
    least = {"portrait": 120, "gallery": 200, "search": 128}[kind]
    ok = F.least(width, height) >= least
    return ok & (F.try_divide(F.greatest(width, height), F.least(width, height)) <= 3.0) if kind == "search" else ok


def category_members(pages: DataFrame, keys: list[str], categories: str) -> DataFrame:
    """FLT25: in groups of more than 20 pages only those with a character category; smaller groups stay whole."""
    from rollcall.functions.text import CATEGORY_FREE, character_category

    n = F.count("*").over(Window.partitionBy(*keys))
    return pages.withColumn("_n", n).where((F.col("_n") <= CATEGORY_FREE) | character_category(F.col(categories))).drop("_n")


def by_language(rows: DataFrame, lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """FLT26: rows to transcribe in English, and the others, to be handled language by language."""
    return rows.where(F.col(lang) == "en"), rows.where(F.col(lang) != "en").repartition(lang)


def short_media(duration: Column, most: float = 2700) -> Column:
    """FLT28: unknown lengths pass."""
    return F.coalesce(duration, F.lit(0)) <= most


def local_to_global(start: Column, frame: Column) -> Column:
    """PRJ1."""
    return start + frame.cast("int")


def global_to_local(start: Column, frame: Column) -> Column:
    """PRJ1, the other way."""
    return frame - start


def clip_range(rows: DataFrame, start: str, end: str, n_frames: str) -> DataFrame:
    """PRJ3: half-open ranges clamped to the frames there are; empty ones go."""
    out = rows.withColumn(start, F.greatest(F.col(start), F.lit(0))).withColumn(end, F.least(F.col(end), F.col(n_frames)))
    return out.where(F.col(start) < F.col(end))


def zip_rows(rows: DataFrame, **arrays: str) -> DataFrame:
    """PRJ4: one row per place of parallel arrays; name=column."""
    others = [c for c in rows.columns if c not in arrays.values()]
    zipped = F.arrays_zip(*(F.col(c).alias(n) for n, c in arrays.items()))
    return rows.select(*others, F.posexplode(zipped).alias("pos", "_z")).select(*others, "pos", *(F.col("_z")[n].alias(n) for n in arrays))


def speaker(column: Column) -> Column:
    """PRJ5."""
    return F.coalesce(column, F.lit("Unknown"))


def wav_path(video: Column) -> Column:
    """PRJ6: mp4 becomes wav wherever it stands, folders included."""
    return F.replace(video, F.lit("mp4"), F.lit("wav"))


def audio_path(video: Column) -> Column:
    """PRJ6: a clip's audio file in the sibling folder."""
    return F.replace(F.replace(video, F.lit("/vid/"), F.lit("/aud/")), F.lit(".mp4"), F.lit(".wav"))


def clean_audio_path(video: Column) -> Column:
    """PRJ6: a clip's cleaned audio file."""
    return F.replace(F.replace(video, F.lit("/vid/"), F.lit("/wav/clean/")), F.lit(".mp4"), F.lit(".wav"))


def in_subset(movie: Column) -> Column:
    """FLT27: one of the movies that have speech annotations."""
    from rollcall.functions.text import MOVIE_SUBSET

    return movie.isin(MOVIE_SUBSET)


def nested_get(column: Column, path: str, default: Column) -> Column:
    """JSON2: a value deep in a JSON text, or a default where any step is missing."""
    return F.coalesce(F.get_json_object(column, f"$.{path}"), default)


def encode_row(*columns: str) -> Column:
    """JSON1: the row as a JSON object, without its nulls."""
    return F.to_json(F.struct(*columns))
