"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, capitalised names inside sentences and units become typed placeholders; case and punctuation
go. A window of ``WINDOW`` (8) such words holds five words that begin at a multiple of four. Only
texts that have such a part of a benchmark window go on; all their windows are hashed and joined with
those of the benchmark. For windows that meet, the words behind the placeholders (slots) are compared:
a copy has equal ones, a re-parameterised question replaces each by one other word throughout, and
anything else is chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables

WINDOW = 8
#: A window counts only with so many words that aren't placeholders.
LITERALS = 4
#: Different windows of an item that a document must hold (all of them, if the item has fewer).
LEAST = 3
#: Benchmark windows (24 bytes each) that are broadcast at most; beyond that, both sides are shuffled.
BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Stands for the space within a name of several words.
JOINT = "\ue003"
#: Units that follow a number.
UNITS = "km|cm|mm|nm|kg|mg|lb|lbs|oz|ml|mph|kmh|km/h|m/s|hz|khz|mhz|ghz|kb|mb|gb|tb|kw|kwh|mw|volts?|watts?|amps?|meters?|metres?|kilometers?|kilometres?|centimeters?|miles?|feet|foot|inch|inches|yards?|acres?|liters?|litres?|gallons?|grams?|kilograms?|pounds?|ounces?|tons?|tonnes?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|celsius|fahrenheit|percent|dollars?|cents?|euros?|usd|eur|gbp"
_MARKS = ".,;:!?\"'()[]{}<>*#&%$|_~`^=+/\\-–—…«»“”‘’„¿¡"

_AROUND = ".,;:!?\"'()\\[\\]{}…«»“”‘’„¿¡"


def named(text: Column) -> Column:
    """The text with names of several words as one word each, so that a name of another length keeps all places."""
    return F.regexp_replace(text, " (?=\\p{Lu}\\p{Ll})(?<=[\\p{Ll}\\p{N},;] \\p{Lu}\\p{Ll}{1,20} )", JOINT)


def template(text: Column) -> Column:
    """The text with placeholders, lower-cased and without punctuation; words keep their number and order.

    A punctuation mark alone between spaces stays a word, as the placeholder-free mark ``-``.
    Each pattern begins with the character it needs, as looking back from every place of a text costs most of the time.
    Repeated groups are possessive: others take a stack frame for each repeat, and names and numbers may be of any length.
    """
    t = F.regexp_replace(text, f" (?=\\p{{Lu}}\\p{{Ll}})(?<=[\\p{{Ll}}\\p{{N}},;] )\\p{{Lu}}\\p{{Ll}}+(?:{JOINT}\\p{{Lu}}\\p{{Ll}}+)*+", f" {NAME}")
    t = F.regexp_replace(t, "[+\\-0-9](?:(?<=\\d)|(?=\\d))\\d*(?:[.,:/]\\d+)*+", NUMBER)
    t = F.regexp_replace(t, f"{NUMBER}( ?)(?i:{UNITS})(?![\\p{{L}}\\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return F.lower(F.regexp_replace(F.translate(t, _MARKS, "-" * len(_MARKS)), "-(?:(?<=[^\\x20\\x09-\\x0D-]-)-*|-*(?=[^\\x20\\x09-\\x0D-]))", ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _is_slot(w: Column) -> Column:
    return F.translate(w, NUMBER + NAME + UNIT, "") != w


def _part(width: int) -> tuple[int, int]:
    """(stride, length): each window of ``width`` words holds a part of so many words that begins at a multiple of the stride."""
    stride = max(1, width // 2)
    return stride, width - stride + 1


def _hash(words: str, at: Column | int, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + F.lit(k)) for k in range(n)])


def _candidates(rows: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """(id, v) of the texts that hold one of ``parts`` (p) at a multiple of the stride: all that have a window of the benchmark, and a few more."""
    stride, n = _part(width)
    rows = rows.withColumn("tw", _words(template(F.col("text"))))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("tw") - n, F.lit(0)), F.lit(stride)), lambda i: _hash("tw", i, n))
    rows = rows.select("id", "v", F.when(F.size("tw") >= n, hashes).alias("hashes"))
    found = rows.select("id", "v", F.explode_outer("hashes").alias("p")).filter("p IS NOT NULL")
    return found.join(parts, "p", "left_semi").select("id", "v").distinct()


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """rows (id, v, text) -> one row per window of template words: its hash and place."""
    rows = rows.withColumn("tw", _words(template(F.col("text"))))
    hashes = F.transform(F.sequence(F.lit(0), F.size("tw") - width), lambda i: _hash("tw", i, width))
    rows = rows.select("id", "v", F.when(F.size("tw") >= width, hashes).alias("hashes"))
    # outer: Spark infers a filter from posexplode, which would evaluate the words anew for each window
    return rows.select("id", "v", F.posexplode_outer("hashes").alias("pos", "h")).filter("h IS NOT NULL")


def _literal_windows(rows: DataFrame, width: int, literals: int) -> DataFrame:
    """rows (id, v, text) -> one row per window with enough words that aren't placeholders: its hash, place, and the hashes of its parts."""
    stride, n = _part(width)
    rows = rows.withColumn("tw", _words(template(F.col("text"))))
    slots = F.transform("tw", lambda w: _is_slot(w).cast("int"))
    first = F.get(_words(template(_after_word(F.col("text")))), F.lit(1))
    rows = rows.select("id", "v", "tw", slots.alias("s"), first.alias("first"))
    enough = lambda i: width - F.aggregate(F.slice("s", i + 1, width), F.lit(0), lambda a, x: a + x) >= literals
    hashed = lambda words, i: F.struct(_hash(words, i, width).alias("h"), F.array(*[_hash(words, i + F.lit(k), n) for k in range(stride)]).alias("parts"))
    own = F.transform(F.sequence(F.lit(0), F.size("tw") - width), lambda i: F.when(enough(i), hashed("tw", i)))
    rows = rows.filter(F.size("tw") >= width)
    out = rows.select("id", "v", F.posexplode_outer(own).alias("pos", "w"), F.lit(False).alias("other"))
    rows = rows.filter((F.col("first") != F.get("tw", F.lit(0))) & enough(F.lit(0)))
    rows = rows.withColumn("tw", F.concat(F.array("first"), F.slice("tw", 2, width)))
    out = out.union(rows.select("id", "v", F.lit(0), hashed("tw", F.lit(0)), F.lit(True))).filter("w IS NOT NULL")
    return out.select("id", "v", "pos", "w.h", "w.parts", "other")


def _after_word(text: Column) -> Column:
    """The text as it reads after a lower-case word, where its capitalised first word is a name."""
    return F.concat(F.lit("a "), F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", ""))


def _plain(text: Column) -> Column:
    """Words with their own numbers and names, in lower case and without punctuation around them; signs stay."""
    strip = lambda w: F.lower(F.regexp_replace(w, f"^[{_AROUND}]+|[{_AROUND}]+$", ""))
    return F.filter(F.transform(_words(F.translate(text, JOINT, " ")), strip), lambda w: w != "")


def _whole_copies(d: DataFrame, items: DataFrame, width: int, broadcast_windows: int) -> DataFrame | None:
    """(doc_id, item_id) of texts that hold all words of an item; None if there are no items with words.

    Found by the first words (``width`` at most) and compared in full.
    """
    e = items.select(F.col("id").alias("item_id"), _plain(F.col("text")).alias("w")).filter(F.size("w") > 0)
    e = e.select("item_id", F.size("w").alias("len"), F.array_join("w", " ").alias("phrase"), F.least(F.size("w"), F.lit(width)).alias("m"), "w")
    e = e.select("item_id", "len", "phrase", "m", F.coalesce(*[F.when(F.col("m") == m, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(m)])) for m in range(1, width + 1)]).alias("h"))
    e = tables.table(e.distinct())
    lengths = sorted(r.m for r in e.select("m").distinct().collect())  # width rows at most
    if not lengths:
        return None
    dw = d.withColumn("w", _plain(F.col("text")))
    at = lambda m: F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("w", i + k) for k in range(m)]).alias("h"))))
    none = F.array().cast("array<struct<pos:int,h:bigint>>")
    starts = dw.select("id", "v", F.concat(*[F.coalesce(at(m), none) for m in lengths]).alias("s")).select("id", "v", F.explode_outer("s").alias("s"))
    starts = starts.select("id", "v", "s.pos", "s.h").filter("h IS NOT NULL")
    side = F.broadcast(e) if e.count() <= broadcast_windows else e
    near = starts.join(side, "h").groupBy("id", "v").agg(F.collect_set(F.struct("pos", "len", "phrase", "item_id")).alias("near"))
    near = d.join(tables.table(near), ["id", "v"]).withColumn("w", _plain(F.col("text")))
    same = F.filter("near", lambda c: F.array_join(F.slice("w", c["pos"] + 1, c["len"]), " ") == c["phrase"])
    return near.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.transform(same, lambda c: c["item_id"]))).alias("item_id")).distinct()


def _slots(rows: DataFrame) -> DataFrame:
    """(id, v, place, filler): the words behind placeholders, without case and outer punctuation."""
    filler = lambda w: F.lower(F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    rows = rows.select("id", "v", F.posexplode_outer(F.arrays_zip(_words(template(F.col("text"))).alias("t"), _words(F.col("text")).alias("o"))).alias("place", "w"))
    return rows.filter(_is_slot(F.col("w.t"))).select("id", "v", "place", filler(F.col("w.o")).alias("filler"))


def _texts(rows: DataFrame, name: str) -> DataFrame:
    """(id, v, text): ``v`` tells apart the texts that share an id."""
    return rows.filter(F.col(name).isNotNull() & F.col("text").isNotNull()).select(F.col(name).alias("id"), F.xxhash64("text").alias("v"), "text")


def _named_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", named(F.col("text")))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, literals: int = LITERALS, least: int = LEAST, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text) -> doc_id, item_id, n_windows, n_item_windows, n_slots, n_changed long, kind.

    One row per contaminated document and item, about their best run: ``kind`` is copy (all fillers equal) or re-parameterised.
    A window counts if its own fillers map consistently; one with none or only equal ones always does. Items without
    a window that counts (fewer than ``width`` words, or too few literal ones) are found as copies of all their words, with
    0 in the counts. Null and empty texts are clean. Rows that share a doc_id
    (or item_id) are compared text by text, and the best run of any counts; a null id matches nothing. Repeats don't count
    twice. Texts of any length are searched whole. Empty tables give no rows.
    """
    whole, b = _texts(docs, "doc_id"), _named_texts(_texts(benchmark, "item_id"))
    d = _named_texts(whole)
    bw = tables.table(_literal_windows(b, width, literals).select(F.col("id").alias("item_id"), F.col("v").alias("iv"), F.col("pos").alias("item_pos"), "h", "parts", "other").distinct())
    totals = bw.filter("NOT other").groupBy("item_id", "iv").agg(F.countDistinct("h").alias("n_item_windows"))
    side = F.broadcast(bw) if bw.count() <= broadcast_windows else bw
    parts = tables.table(bw.select(F.explode("parts").alias("p")).distinct())
    parts = F.broadcast(parts) if parts.count() <= broadcast_windows else parts
    # only texts that hold a part of a window are kept, and searched at every place
    held = tables.bounded(_candidates(d, parts, width))
    near = _named_texts(tables.table(whole.join(held, ["id", "v"], "left_semi")))
    hits = _windows(near, width).withColumnsRenamed({"id": "doc_id", "v": "dv"}).join(side.drop("parts"), "h").select("doc_id", "dv", "item_id", "iv", "pos", "item_pos", "h")
    hits = tables.table(hits.distinct())

    doc_ids = tables.bounded(hits.select(F.col("doc_id").alias("id"), F.col("dv").alias("v")).distinct())
    ds = tables.table(_slots(near.join(doc_ids, ["id", "v"], "left_semi")).distinct().select(F.col("id").alias("doc_id"), F.col("v").alias("dv"), F.col("place").alias("dp"), F.col("filler").alias("df")))
    bs = tables.table(_slots(b.withColumn("text", _after_word(F.col("text"))).join(hits.select(F.col("item_id").alias("id"), F.col("iv").alias("v")).distinct(), ["id", "v"], "left_semi")).distinct())
    bs = bs.select(F.col("id").alias("item_id"), F.col("v").alias("iv"), (F.col("place") - 1).alias("ip"), F.col("filler").alias("bf"))
    # a run is a text, an item and the distance of their places; it has each place of its windows once
    run = ["doc_id", "dv", "item_id", "iv", "shift"]
    runs = hits.select("doc_id", "dv", "item_id", "iv", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "h")
    places = runs.select(*run, F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("item_pos") + k)).alias("ip")).distinct()
    pairs = places.join(bs, ["item_id", "iv", "ip"]).withColumn("dp", F.col("ip") + F.col("shift")).join(ds, ["doc_id", "dv", "dp"])
    slots = pairs.groupBy(*run).agg(F.collect_list(F.struct("ip", "bf", "df")).alias("slots"))
    windows = runs.groupBy(*run).agg(F.collect_set(F.struct("item_pos", "h")).alias("windows"))
    found = windows.join(slots, run, "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<struct<ip:int,bf:string,df:string>>")))

    def inside(s: Column, w: Column) -> Column:
        return (s["ip"] >= w["item_pos"]) & (s["ip"] < w["item_pos"] + width)

    def consistent(w: Column) -> Column:
        here = F.transform(F.filter("slots", lambda s: inside(s, w)), lambda s: F.struct(s["bf"].alias("bf"), s["df"].alias("df")))
        return F.size(F.array_distinct(here)) == F.size(F.array_distinct(F.transform(here, lambda s: s["bf"])))

    found = found.withColumn("windows", F.filter("windows", consistent)).filter(F.size("windows") > 0)
    found = found.withColumn("slots", F.filter("slots", lambda s: F.exists("windows", lambda w: inside(s, w))))
    long = lambda c: F.size(c).cast("long")
    found = found.select(*run, long(F.array_distinct(F.transform("windows", lambda w: w["h"]))).alias("n_windows"), long("slots").alias("n_slots"), long(F.filter("slots", lambda s: s["bf"] != s["df"])).alias("n_changed"))
    found = found.join(totals, ["item_id", "iv"]).filter(F.col("n_windows") >= F.least(F.lit(least), F.col("n_item_windows")))
    found = found.withColumn("n_windows", F.least("n_windows", "n_item_windows"))
    r = F.struct("n_windows", "n_item_windows", "n_slots", "n_changed")
    out = found.groupBy("doc_id", "item_id").agg(F.max_by(r, F.struct("n_windows", -F.col("n_changed"), -F.col("shift"), "dv", "iv")).alias("r"))
    kind = F.when(F.col("r.n_changed") > 0, "re-parameterised").otherwise("copy")
    out = out.select("doc_id", "item_id", "r.n_windows", "r.n_item_windows", "r.n_slots", "r.n_changed", kind.alias("kind"))
    bare = b.join(totals.select(F.col("item_id").alias("id"), F.col("iv").alias("v")), ["id", "v"], "left_anti")
    copies = _whole_copies(d, bare, width, broadcast_windows)
    if copies is None:
        return out
    zero = F.lit(0).cast("long")
    copies = copies.join(out.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    return out.union(copies.select("doc_id", "item_id", zero, zero, zero, zero, F.lit("copy")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; rows with a null doc_id stay."""
    return docs.join(tables.bounded(matches(docs, benchmark).select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
