"""String functions over columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop lists of the three entity filters.
STOP_SPEECH = ("um", "uh", "ah", "eh", "oh", "mm", "hmm", ".", "..", "...", ",", "!", "?", "the", "a", "an", "and", "or", "but", "to", "of", "for", "yous", "youse", "youre", "youll", "ai", "pro", "the pro", "ok", "okay")
STOP_VISION = (*STOP_SPEECH, "man", "woman", "person", "people")
STOP_DOCS = (".", "..", "...", ",", "!", "?", "the", "a", "an", "and", "or", "but", "to", "of", "for", "is", "are", "was", "were", "be", "been", "being", "this", "that", "it", "its", "they", "them", "their")
STOP_CAPTIONS = (*STOP_DOCS, "image", "diagram", "figure", "chart", "table")

# Errors after which a download is tried again.
RETRYABLE = ("http error 403", "http error 429", "internal server error", "failed to resolve", "no address associated with hostname", "timed out", "connection reset")

# File types by extension.
FILE_TYPES = {
    "audio": ("mp3", "wav", "flac", "ogg", "m4a"),
    "video": ("mp4", "mkv", "avi", "mov", "webm"),
    "model": ("glb", "gltf", "fbx", "obj", "stl"),
    "document": ("pdf", "docx", "pptx", "xlsx", "txt", "md", "html", "htm", "csv", "tex", "png", "jpg", "jpeg", "tiff", "bmp", "webp"),
}

# What a generated title may begin with.
TITLE_PREFIXES = ("Title:", "Chapter:", "Chapter Title:", "Here's", "Here is", "The title is", "A good title would be", "**", "##", "Sure,")

# Fixed value: what a caption may begin with.
CAPTION_INTRO = (
    r"(?i)^(?:"
    r"This is a detailed[,.]?\s*(?:high-resolution )?(?:image|description|photograph|picture|diagram|screenshot)?\s*(?:of |showing |depicting |that shows |which shows )?|"
    r"(?:This|The) image (?:is |displays |shows |depicts |presents |contains |features )?(?:a |an |the )?(?:detailed )?(?:image |picture |photograph |screenshot |diagram )?(?:of |showing |depicting )?|"
    r"(?:This|The) (?:is |shows |displays |depicts |presents )?(?:a |an |the )?(?:detailed )?(?:image |picture |photograph |screenshot |diagram )?(?:of |showing |depicting )?"
    r")"
)

TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, fn) -> Column:
    """fn(value), with value computed and written out once, so that chains of steps stay linear in size."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def sentences(text: Column) -> Column:
    """Pieces that end after . ! ? and white space; empty ones are dropped."""
    marked = F.regexp_replace(text, r"([.!?]+)\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def first_filled(*cols: Column) -> Column:
    """The first that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def speech_word(word: Column) -> Column:
    """Letters a-z and apostrophes of a spoken word; null if none are left."""
    w = F.translate(F.lower(F.translate(word, "’‘", "''")), "-", " ")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(w, "[^a-z' ]", ""), " +", " ")), F.lit(""))


def key_value(text: Column) -> Column:
    """struct(key, value): split at the first of ':', '=', ' - ' (in this order) with a key before it, else (text, '')."""
    out = F.struct(F.trim(text).alias("key"), F.lit("").alias("value"))
    for sep in (" - ", "=", ":"):
        at = F.locate(sep, text)
        key = F.trim(F.substring(text, F.lit(1), at - 1))
        value = F.trim(F.substring(text, at + len(sep), F.length(text)))
        out = F.when((at > 0) & (key != ""), F.struct(key.alias("key"), value.alias("value"))).otherwise(out)
    return out


def strip_intro(caption: Column) -> Column:
    """Without a generic introduction and with a capital first letter; the caption itself if nothing is left."""
    rest = F.trim(F.regexp_replace(caption, CAPTION_INTRO, ""))
    return F.when(rest == "", caption).otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))


def drop_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def clean_title(title: Column, most: int = 50) -> Column:
    """A generated title without prefixes, quotes and trailing marks, cut at a word; 'Discussion' if under 3 characters."""
    def drop(prefix: str):
        return lambda t: F.when(F.startswith(F.lower(t), F.lit(prefix.lower())), F.trim(F.substring(t, F.lit(len(prefix) + 1), F.length(t)))).otherwise(t)

    def colon(t: Column) -> Column:
        at = F.locate(":", t)
        before, after = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at + 1, F.length(t)))
        return F.when((at > 0) & (F.length(after) > 10), after).when((at > 0) & (F.length(before) > F.length(after)), before).otherwise(t)

    def fit(t: Column) -> Column:
        cut = F.substring(t, 1, most)
        return F.when(F.length(t) <= most, t).when(F.locate(" ", cut) > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)

    t = F.trim(title)
    for prefix in TITLE_PREFIXES:
        t = let(t, drop(prefix))
    t = F.regexp_replace(t, "^[\"'`*#]+|[\"'`*#]+$", "")
    t = let(F.trim(F.split_part(t, F.lit("\n"), F.lit(1))), colon)
    t = let(F.regexp_replace(t, "[.,;:!]+$", ""), fit)
    return let(t, lambda x: F.when(F.length(x) < 3, "Discussion").otherwise(x))


def safe_name(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", ""), " ", "_"), 1, most)


def file_type(path: Column) -> Column:
    """audio, video, model, document or other, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("other")
    for kind, endings in FILE_TYPES.items():
        out = F.when(ext.isin(*endings), kind).otherwise(out)
    return out


def retryable(error: Column) -> Column:
    return F.lower(error).rlike("|".join(RETRYABLE))


def overlap_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """Share of the query's different tokens that the document has, 3 decimals; 0 for an empty query."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, doc_tokens)) / F.size(q), 3))


def sentence_cut(text: Column, most: int) -> Column:
    """Whole sentences up to ``most`` characters; the first ``most`` characters if the first sentence is longer."""
    fits = F.aggregate(
        sentences(text),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
        lambda a, s: F.when(
            ~a["full"] & (F.length(a["out"]) + F.length(s) + F.when(a["out"] == "", 0).otherwise(1) <= most),
            F.struct(F.when(a["out"] == "", s).otherwise(F.concat(a["out"], F.lit(" "), s)).alias("out"), F.lit(False).alias("full")),
        ).otherwise(F.struct(a["out"].alias("out"), F.lit(True).alias("full"))),
        lambda a: a["out"],
    )
    return F.when(F.length(text) <= most, text).when(fits != "", fits).otherwise(F.substring(text, 1, most))


def page_title(html: Column, url: Column) -> Column:
    """First h1 or Markdown heading, else the last part of the address in title case."""
    h1 = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), F.lit(""))
    md = F.nullif(F.trim(F.regexp_extract(html, r"(?m)^\s*#+\s*(.+)$", 1)), F.lit(""))
    stem = F.initcap(F.translate(F.regexp_extract(url, r"([^/]+?)(?:\.\w+)?/?$", 1), "-_", "  "))
    return F.coalesce(h1, md, stem)


def comment_metadata(markdown: Column) -> Column:
    """map of '<!-- key: value -->' comments; the last of equal keys counts."""
    pattern = F.lit(r"<!--\s*([^:]+?):\s*(.*?)\s*-->")
    keys, values = F.regexp_extract_all(markdown, pattern, F.lit(1)), F.regexp_extract_all(markdown, pattern, F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.aggregate(pairs, F.expr("cast(array() as array<struct<k:string,v:string>>)"), lambda a, p: F.concat(F.filter(a, lambda x: x["k"] != p["k"]), F.array(F.struct(p["k"].alias("k"), p["v"].alias("v")))))
    return F.map_from_entries(last)


def shell_quote(argument: Column) -> Column:
    """Arguments of letters, digits and . / : - _ = as they are; others in single quotes, with quotes inside escaped."""
    quoted = F.concat(F.lit("'"), F.replace(argument, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(argument.rlike(r"^[\p{L}\p{Nd}./:_=-]*\z"), argument).otherwise(quoted)
