"""Text functions as column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
JUNK_TITLE = r"(?i)(^(list of|category:|file:|template:)|(gallery|galleries|images|soundtrack|transcript|credits|commentary|filmography|merchandise|episodes?|\(species\))\b)"
GENERIC_ROLES = [
    "additional voice", "additional voices", "various", "ensemble", "chorus",
    "narrator", "narration", "announcer", "voice", "voices", "singer", "dancer",
    "man", "woman", "boy", "girl", "kid", "child", "baby", "guest", "clerk",
    "extra", "crowd", "villager", "soldier", "guard", "reporter", "waiter",
    "bystander", "passenger", "customer", "patron", "self", "himself", "herself",
]
BIT_PART = r"(?i)#\s*\d|\b(additional|uncredited)\b"
CHROME_FILE = r"(?i)(site-?logo|wiki-?wordmark|wordmark|favicon|placeholder|nav-?bar|badge|award|icon|button|spoiler|stub|edit|quote|watermark)"
INFOBOX_IMAGE = r"(?i)\|\s*(?:image|img|portrait|photo|picture)\s*\d*\s*="
IMAGE_FILE = r"(?i)([^\|\[\]\n<>=]+?\.(?:png|jpe?g|gif|webp|svg))"
CATEGORY_WORDS = ["character", "protagonist", "villain"]
CATEGORY_FREE = 20
MOVIE_SUBSET = ["Coraline", "Despicable Me", "Ice Age", "Kung Fu Panda", "Spider Man: Into the Spider-Verse", "Sing", "The Secret Life of Pets", "The Polar Express"]
COLOURS = ["red", "green", "blue", "yellow", "pink", "cyan", "white", "black", "black", "black", "black", "black"]

_SPACE = r"[ \t\n\x0B\f\r]+"


def normalise_name(name: Column) -> Column:
    """STR1: without parentheticals, lower case, letters digits and blanks only, no leading article, blanks squeezed."""
    x = F.lower(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]", ""), "^(the|a) ", "")
    return F.trim(F.regexp_replace(x, " +", " "))


def clean_name(title: Column) -> Column:
    """STR2: one trailing parenthetical goes unless nothing would be left; / to -, _ to blank, blanks squeezed."""
    x = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    x = F.coalesce(F.nullif(x, F.lit("")), F.trim(title))
    return F.trim(F.regexp_replace(F.translate(x, "/_", "- "), r"\s+", " "))


def drop_voice_suffix(role: Column, leading_space: bool = False) -> Column:
    """STR3: the credit without `(voice)`; with leading_space only ` (voice)` goes."""
    return F.replace(role, F.lit(" (voice)"), F.lit("")) if leading_space else F.trim(F.replace(role, F.lit("(voice)"), F.lit("")))


def voiced_role(credit: Column) -> Column:
    """STR3, cast form: the first of several roles, without `(voice)`; null if nothing is left or it is additional voices."""
    role = F.trim(F.split_part(F.replace(credit, F.lit("(voice)"), F.lit("")), F.lit("/"), F.lit(1)))
    return F.when((role != "") & ~F.contains(role, F.lit("Additional voices")), role)


def title_id(link: Column) -> Column:
    """STR4: the first tt number of a link, null if none."""
    return F.nullif(F.regexp_extract(link, r"(tt\d+)", 1), F.lit(""))


def wiki_api(url: Column) -> Column:
    """STR5: the API address of a wiki URL's host."""
    return F.concat(F.lit("https://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("/api.php"))


def wiki_title(url: Column) -> Column:
    """STR5: what follows /wiki/ in a URL's path, percent-decoded, underscores as blanks; + stays a plus."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.when(F.instr(path, "/wiki/") > 0, F.expr("1")).otherwise(F.expr("0"))
    after = F.when(tail == 1, F.regexp_replace(path, r"^.*?/wiki/", "")).otherwise(path)
    return F.translate(F.try_url_decode(F.replace(after, F.lit("+"), F.lit("%2B"))), "_", " ")


def infobox_file(wikitext: Column) -> Column:
    """STR6: the file named within 400 characters after an infobox image parameter, as `File:name`; else null."""
    at = F.regexp_instr(wikitext, F.lit(INFOBOX_IMAGE))
    tail = F.regexp_replace(F.substr(wikitext, at), r"^" + INFOBOX_IMAGE.replace("(?i)", "(?i:") + ")", "")
    name = F.regexp_extract(F.substring(tail, 1, 400), IMAGE_FILE, 1)
    name = F.trim(F.regexp_replace(name, r"(?i)^\s*(?:File|Image)\s*:", ""))
    return F.when((at > 0) & (name != ""), F.concat(F.lit("File:"), name))


def rasterise_url(url: Column, width: int = 800) -> Column:
    """STR7: a vector image's URL with a width segment before the query; other URLs unchanged."""
    base = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    base = F.when(F.contains(base, F.lit("scale-to-width-down")), base).otherwise(F.concat(base, F.lit(f"/scale-to-width-down/{width}")))
    return F.when(~F.contains(F.lower(url), F.lit(".svg")), url).otherwise(F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def strip_tags(html: Column) -> Column:
    """STR8."""
    return F.regexp_replace(html, "<[^>]+>", "")


def character_list(names: Column, colours: Column) -> Column:
    """STR9: `name (colour)` of parallel arrays, joined by comma and blank; empty text if there are none."""
    return F.coalesce(F.array_join(F.transform(F.arrays_zip(names.alias("n"), colours.alias("c")), lambda x: F.concat(x.getField("n"), F.lit(" ("), x.getField("c"), F.lit(")"))), ", "), F.lit(""))


def fill_template(template: str, **values: Column) -> Column:
    """STR9: {name} placeholders of a prompt replaced by columns; a null value is empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def word_budget(duration: Column, seconds_per_word: float = 0.275) -> Column:
    """STR10: words that fit a duration; null for null (D-10)."""
    return F.floor(duration / seconds_per_word + 1).cast("int")


def search_query(name: Column, title: Column) -> Column:
    """STR11: the quoted name and the title."""
    return F.concat(F.lit('"'), name, F.lit('" '), title)


def basename(path: Column) -> Column:
    """STR12."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """STR12: the folder's own name; null at the top."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(path: Column) -> Column:
    """STR12: basename without its last extension (dots inside the name stay)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def content_key(content: Column) -> Column:
    """STR13: SHA-256, the key of exact duplicates."""
    return F.sha2(content, 256)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for empty text and null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def fits_length(text: Column) -> Column:
    """FLT7: more than 1 and fewer than 64 words, fewer than 250 characters."""
    n = word_count(text)
    return (n > 1) & (n < 64) & (F.length(text) < 250)


def junk_title(title: Column) -> Column:
    """FLT22."""
    return F.contains(title, F.lit("/")) | title.rlike(JUNK_TITLE)


def generic_role(role: Column) -> Column:
    """FLT23: the whole normalised credit is a bit part, or it is numbered or marked as one."""
    return normalise_name(role).isin(GENERIC_ROLES) | role.rlike(BIT_PART)


def chrome_file(name: Column) -> Column:
    """FLT24."""
    return name.rlike(CHROME_FILE)


def character_category(categories: Column) -> Column:
    """FLT25: whether any category names a character, a protagonist or a villain."""
    return F.exists(categories, lambda c: F.lower(c).rlike("|".join(CATEGORY_WORDS)))


def repair_output(text: Column) -> Column:
    """FLT31: without the wrapper of a one-entry dictionary and without braces; empty where the model fell into its list form."""
    bare = F.replace(F.replace(text, F.lit("{'summarised_AD': '"), F.lit("")), F.lit("'}"), F.lit(""))
    return F.when(F.contains(bare, F.lit("1. Main characters:")), F.lit("")).otherwise(F.translate(bare, "{}", ""))


def unstable_output(text: Column, longest: int = 1500) -> Column:
    """FLT32: whether a model's output is so long that it should be asked again."""
    return F.length(text) > longest
