"""Tokenizers and scalar text functions. Each operator names the tokenizer that it uses."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stopwords of the selector (T-1), of search (T-2) and memories (T-4), of retrieval augmentation (T-7), and of relevance (T-5).
SELECTOR_STOPWORDS = [
    "a", "al", "an", "and", "as", "at", "be", "by", "con", "de", "del", "el", "en", "for", "from", "how", "in", "is", "la", "las", "los", "of", "on",
    "or", "para", "por", "que", "the", "to", "un", "una", "with", "y",
]
SEARCH_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "the", "to", "was",
    "were", "will", "with", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "que", "se", "un", "una", "y",
]
RAG_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "con", "de", "del", "el", "en", "es", "for", "from", "in", "is", "la", "las", "los", "of", "on",
    "or", "para", "por", "que", "the", "to", "un", "una", "with", "y",
]
MEMORY_STOPWORDS = SEARCH_STOPWORDS
RELEVANCE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "de", "del", "el", "en", "for", "from", "in", "is", "it", "la", "las", "los", "of", "on", "or",
    "que", "se", "the", "to", "un", "una", "with", "y",
]


#: Word edges of ASCII words; Java's own also count accented letters.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace("\\b", EDGE)


def _tokens(text: Column, drop: str, least: int, stopwords: list[str], plain: bool = False) -> Column:
    """Lower-cased pieces between runs of what ``drop`` (a character class, white space included) matches, of ``least`` characters, without stopwords. Null text: none.

    Texts are lower-cased before they are split, so that classes may name capitals; Java's named classes are several times faster than ranges of letters and digits. With ``plain``, Latin letters are ``decomposed`` first; their marks are put off until the text is split, so that only words which have some are translated.
    """
    text = F.coalesce(text, F.lit(""))
    if plain:
        have, letters = latin_marks()
        pieces = F.transform(F.split(_after_marks(text), drop), lambda w: F.lower(F.when(F.octet_length(w) > F.length(w), F.translate(w, have, letters)).otherwise(w)))
    else:
        pieces = F.split(F.lower(text), drop)
    return F.filter(pieces, lambda w: (F.length(w) >= least) & ~w.isin(stopwords) if stopwords else F.length(w) >= least)


@cache
def latin_marks() -> tuple[str, str]:
    """Latin letters that decompose into a plain letter and marks, and the plain letters."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


@cache
def _mark_class() -> str:
    """A character class of the letters of ``latin_marks``: ranges, tried only on characters that can be one of them."""
    ranges: list[list[str]] = []
    for c in latin_marks()[0]:
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[\u00c0-\u024f&&[" + "".join(f"{x}-{y}" for x, y in ranges) + "]]"


def _after_marks(text: Column) -> Column:
    """A space after each letter of ``latin_marks``."""
    return F.regexp_replace(text, f"({_mark_class()})", "$1 ")


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD) of Latin letters, as tokenizers see it: the letter, and a space for its marks, which are no letters and so end
    a word. Other scripts and ligatures stay as they are."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) > F.length(text), F.translate(_after_marks(text), *latin_marks())).otherwise(text)


def selector_tokens(text: Column) -> Column:
    """T-1."""
    return _tokens(text, "[^\\p{L}\\p{N}./_-]+", 1, SELECTOR_STOPWORDS, plain=True)


def search_tokens(text: Column) -> Column:
    """T-2."""
    return _tokens(text, "[^\\p{Alnum}à-ɏ]+", 2, SEARCH_STOPWORDS)


def raw_tokens(text: Column) -> Column:
    """T-3."""
    return _tokens(text, "[^\\p{L}\\p{N}]+", 1, [], plain=True)


def memory_tokens(text: Column) -> Column:
    """T-4: pieces between spaces, slashes, dots, underscores and dashes."""
    return _tokens(text, "[^\\p{L}\\p{N}]+", 3, MEMORY_STOPWORDS, plain=True)


def sync_tokens(text: Column) -> Column:
    """T-6."""
    return _tokens(text, "\\W+", 3, [])


def rag_tokens(text: Column) -> Column:
    """T-7."""
    return _tokens(text, "[^\\p{L}\\p{N}]+", 2, RAG_STOPWORDS)


def tagger_words(text: Column) -> Column:
    """T-8, as the tagger splits words."""
    return _tokens(text, "[^\\p{Alnum}áéíóúñü]+", 2, [])


def compact(text: Column, most: int | None = None) -> Column:
    """F-1: single spaces; longer texts end in ``...`` at ``most`` characters."""
    # single spaces stay as they are: a text that has no others is searched only, and not put together anew
    c = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\n\\x0B\\f\\r]\\s*| \\s+", " "))
    return c if most is None else F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, max(most - 3, 0))), F.lit("..."))).otherwise(c)


def slug(text: Column) -> Column:
    """F-2."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fingerprint(text: Column, digits: int = 12) -> Column:
    """F-4."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def estimated_tokens(text: Column) -> Column:
    """F-5."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F-6: null and NaN become ``low``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(F.coalesce(x, F.lit(low)), F.lit(low))))


def half_life(age_days: Column, days: float) -> Column:
    """F-7: exponential decay."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / days)


def linear_decay(age_days: Column, days: float, least: float) -> Column:
    """F-7: linear decay that stops at ``least``."""
    return F.greatest(F.lit(least), F.least(F.lit(1.0), 1 - age_days / days))


def overlap(tokens: Column, focus: Column) -> Column:
    """F-8: share of the distinct focus tokens found; 0 without focus."""
    f = F.array_distinct(focus)
    return F.when(F.size(f) > 0, F.size(F.array_intersect(f, tokens)) / F.size(f)).otherwise(0.0)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """U-4: intersection over union of two token lists; ``empty`` if both are."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(empty)


def cosine(a: Column, b: Column) -> Column:
    """R-7: over the common length; 0 if either is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


@cache
def _accents() -> tuple[str, str]:
    """Letters of the basic plane that are another character with combining marks, and that character."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        base = "".join(x for x in d if not 0x300 <= ord(x) <= 0x36F)
        if len(d) > 1 and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """Letters without their marks (part of F-12)."""
    have, plain = _accents()
    return F.regexp_replace(F.translate(text, have, plain), "[\\u0300-\\u036f]", "")


def plain_statement(text: Column) -> Column:
    """F-12: without accents and punctuation, single spaces, lower case."""
    t = F.regexp_replace(without_accents(F.coalesce(text, F.lit(""))), "[()`,.:;!?¿¡\"'*_-]", " ")
    return F.lower(F.trim(F.regexp_replace(t, "\\s+", " ")))


def timestamp_id(at: Column, text: Column) -> Column:
    """F-3: time to the millisecond, and 20 characters of the slug."""
    return F.concat(F.date_format(at, "yyyyMMddHHmmssSSS"), F.lit("-"), F.substring(slug(text), 1, 20))


def relevance_tokens(text: Column) -> Column:
    """T-5: pieces between spaces, slashes, dots, underscores and dashes, of three characters or more."""
    return _tokens(text, "[^\\p{L}\\p{N}]+", 3, RELEVANCE_STOPWORDS, plain=True)


def nearest_second(at: Column) -> Column:
    """Seconds since 1970, to the nearest (halves to the even one), as SQL's ``epoch(at)::BIGINT``; a cast to long cuts the fraction off instead."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / F.lit(1e6)).cast("long")


def age_days(at: Column, now: Column) -> Column:
    """F-9: whole days, never negative; unknown times are new."""
    return F.greatest(F.lit(0), F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86_400), F.lit(0))).cast("long")


def freshness_note(days: Column, threshold: int = 1) -> Column:
    """F-9: a caveat on memories older than ``threshold`` days."""
    note = F.concat(F.lit("Note: This memory is "), days, F.when(days == 1, " day").otherwise(" days"), F.lit(" old. It is a point-in-time observation. Verify against current state before acting on it."))
    return F.when(days <= threshold, "").otherwise(note)


def truncated(text: Column, lines: int = 200, size: int = 25_600) -> Column:
    """F-9: the first ``lines`` lines, and of these as many as fit into ``size`` bytes."""
    kept = F.slice(F.split(text, "\n"), 1, lines)
    step = lambda acc, x: F.struct(
        F.when(acc["on"] & (acc["n"] + F.octet_length(x) + 1 <= size + 1), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        (acc["n"] + F.octet_length(x) + 1).alias("n"), (acc["on"] & (acc["n"] + F.octet_length(x) + 1 <= size + 1)).alias("on"),
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.array_join(F.aggregate(kept, start, step)["out"], "\n")


def stem(path: Column) -> Column:
    """F-10: a path without its ending, ``.test`` or ``.spec``, and ``/index``."""
    p = F.regexp_replace(F.regexp_replace(F.lower(path), "\\.[a-z0-9]+$", ""), "(\\.test|\\.spec)$", "")
    return F.regexp_replace(p, "/index$", "")


def folder(path: Column) -> Column:
    """F-10: what comes before the last slash; empty without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(F.lower(path), "/[^/]*$", "")).otherwise("")


def path_terms(path: Column) -> Column:
    """F-10: pieces between slashes, dots, spaces, underscores and dashes, without stopwords."""
    return F.filter(F.split(F.lower(path), "[/. _-]+"), lambda w: (w != "") & ~w.isin(SELECTOR_STOPWORDS))


_UNITS = {"ms": "ms|milliseconds?", "s": "s|secs?|seconds?|segundos?", "m": "m|min(?:ute)?s?|minutos?", "h": "h|hrs?|hours?|horas?", "d": "d|days?|d[ií]as?"}


def numeric_signal(text: Column) -> Column:
    """F-15: the first number of at most four digits with a unit of time, as (value, unit ms, s, m, h or d)."""
    low = F.lower(compact(text))
    every = "|".join(_UNITS.values())
    pattern = f"(?:^|[^a-z0-9_])(\\d{{1,4}})\\s*({every})(?![a-z0-9_])"
    unit = F.regexp_extract(low, pattern, 2)
    short = F.lit("")
    for name, p in _UNITS.items():
        short = F.when(F.rlike(unit, F.lit(f"^(?:{p})$")), name).otherwise(short)
    return F.struct(F.regexp_extract(low, pattern, 1).try_cast("int").alias("value"), short.alias("unit"))


def inside(path: Column) -> Column:
    """F-16: whether a relative path stays within its root, step by step; absolute ones don't."""
    parts = F.filter(F.split(F.regexp_replace(path, "\\\\", "/"), "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.struct((acc["depth"] + F.when(x == "..", -1).otherwise(1)).alias("depth"), F.least(acc["low"], acc["depth"] + F.when(x == "..", -1).otherwise(1)).alias("low"))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)["low"]
    return ~F.rlike(path, F.lit("^(?:[/\\\\]|[A-Za-z]:)")) & (low >= 0)
