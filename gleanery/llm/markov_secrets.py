"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two Markov models of the next character, one of random strings and one of ordinary identifiers, give each
step of a run of key characters its log-likelihood ratio. Unseen pairs of letters fall back on classes of
characters (vowels, consonants, digits, ...), so that words of languages that no sample holds still look pronounceable.
The stretches of a run with the greatest sums are secrets, if a sum is large enough: so a short random
string needs a clear ratio, and one behind an ordinary name isn't averaged away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.memory import released, small_batches

#: The three base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Only these, in either case, can begin what ASSIGN finds; the test is much cheaper than the pattern.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")

#: A candidate is a run of these characters of at least LEAST, or what base spans leave of one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: A stretch is a secret if the sum of its log-likelihood ratios, each less BIAS, is above TOTAL nats.
BIAS, TOTAL = 0.35, 11.0
#: Samples that the models are trained on at most: documents drawn by hash, different words of these, and random strings.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_RANDOM = 400, 20_000, 4000
#: Share of the class model in each model.
CLASS_SHARE = 0.3

_CLASS = np.full(128, 0, np.int64)
_ALPHABET = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1)])) + "+/_=-"
for _i, _c in enumerate(_ALPHABET):
    _CLASS[ord(_c)] = _i + 1
SIZE = len(_ALPHABET) + 1


def codes(s: str) -> np.ndarray:
    """States of the model: one per character of the alphabet, 0 for any other."""
    raw = np.frombuffer(s.encode("utf-32-le"), "<u4")
    return np.where(raw < 128, _CLASS[np.minimum(raw, 127)], 0)


#: Class of each state: other, vowels and consonants of both cases, digits, and each sign on its own.
_KIND = np.array([0, *(1 if c in "aeiouy" else 2 if c.islower() else 3 if c in "AEIOUY" else 4 if c.isupper() else 5 if c.isdigit() else 6 + "+/_=-".index(c) for c in _ALPHABET)])


def markov(samples: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities of each character after each other one, mixed with those of classes of characters."""
    c = codes("".join(samples))
    ends = np.cumsum([len(s) for s in samples], dtype=np.int64)
    within = np.ones(max(len(c), 1), bool)
    within[ends[ends > 0] - 1] = False  # the next character is another sample's
    pairs = (c[:-1] * SIZE + c[1:])[within[:-1]] if len(c) > 1 else c[:0]
    seen = np.bincount(pairs, minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    kinds = int(_KIND.max()) + 1
    by_kind = np.zeros((kinds, kinds))
    np.add.at(by_kind, (_KIND[:, None], _KIND[None, :]), seen)
    by_kind = (by_kind + smoothing) / (by_kind + smoothing).sum(axis=1, keepdims=True) / np.bincount(_KIND, minlength=kinds)
    own = (seen + smoothing) / (seen + smoothing).sum(axis=1, keepdims=True)
    return np.log((1 - CLASS_SHARE) * own + CLASS_SHARE * by_kind[_KIND[:, None], _KIND[None, :]])


def random_strings(n: int = TRAIN_RANDOM, seed: int = 11) -> list[str]:
    """Labelled samples of secrets: keys in the usual alphabets, drawn uniformly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    upper, lower, digits = _ALPHABET[26:52], _ALPHABET[:26], _ALPHABET[52:62]
    alphabets = (upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", lower + digits, upper + digits, digits + "abcdef")
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), size=int(rng.integers(LEAST, 65)))) for i in range(n)]


def identifiers(words: list[str], seed: int = 12) -> list[str]:
    """Labelled samples of ordinary names: words as they are, and joined as in code, paths and addresses."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = [w for w in words if len(w) > 1]
    if not out:
        return out
    plain = list(out)
    for _ in range(min(len(plain), 20_000)):
        some = [plain[int(i)] for i in rng.integers(0, len(plain), int(rng.integers(2, 5)))]
        style = int(rng.integers(0, 6))
        out.append(("_".join(some), "-".join(some), "/".join(some), some[0] + "".join(w.capitalize() for w in some[1:]), "_".join(some).upper(), "_".join(some) + str(int(rng.integers(0, 3000))))[style])
    out += [str(int(x)) for x in rng.integers(0, 10**9, len(plain) // 50 + 1)]
    out += ["=" * 40, "-" * 40, "_" * 40, "/" * 20]
    return out


#: Ordinary words for corpora from which no sample can be drawn.
BASIC_WORDS = "the and for that with this from have not are was but all can use value name index count user file path data list item node type key test time line text page page_size width height start end first last left right read write open close get set add remove update delete create default config module import export return function class object string number boolean array buffer stream haus wasser und der nicht schule strasse maison avec pour dans une casa para como ciudad client server request response header content message error warning".split()


class Scanner:
    def __init__(self, ratio: np.ndarray, bias: float = BIAS, total: float = TOTAL):
        self.gain, self.total = ratio - bias, total

    def stretches(self, c: np.ndarray) -> list[tuple[int, int]]:
        """Places [start, end) of the stretches with the greatest sums above ``total``: the greatest of all first, then those beside it."""
        gain = self.gain[c[:-1], c[1:]]
        out, parts = [], [(0, len(gain))]
        while parts:
            low, high = parts.pop()
            if high - low < LEAST - 1:
                continue
            sums = np.concatenate([[0.0], np.cumsum(gain[low:high])])
            lowest = np.minimum.accumulate(sums)
            end = int(np.argmax(sums - lowest))
            if sums[end] - lowest[end] > self.total:
                start = int(np.argmin(sums[: end + 1]))
                out.append((low + start, low + end + 1))
                parts += [(low, low + start), (low + end, high)]
        return out

    def random(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Random stretches of text[start:end] with a letter, each widened to whole runs of letters and digits there; ones that meet are joined."""
        found = []
        for a, b in sorted(self.stretches(codes(text[start:end]))):
            a, b = start + a, start + b
            if text[a].isalnum() and not text[a + 1].isalnum():
                a += 1  # the sign after an ordinary word
            while a < b and text[a] in "=_-/":
                a += 1
            while b > a and text[b - 1] in "_-/":
                b -= 1
            while start < a < b and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            while a < b < end and text[b - 1].isalnum() and text[b].isalnum():
                b += 1
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
        return [(a, b) for a, b in found if b - a >= LEAST and any(map(str.isalpha, text[a:b]))]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and added spans (kind, start, end), each ordered by start and kind."""
        base = []
        low = text.lower()
        if any(h in low for h in _HINTS):
            base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        if "AKIA" in text:
            base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        base += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
        added = []
        order = lambda s: (s[1], KINDS.index(s[0]), s[2])
        base.sort(key=order)
        k = 0
        for m in CANDIDATE.finditer(text):
            at, end = m.span()
            while k and base[k - 1][2] > at:
                k -= 1
            while at < end:  # the parts that no base span covers
                while k < len(base) and base[k][2] <= at:
                    k += 1
                stop = min(end, base[k][1]) if k < len(base) else end
                if stop - at >= LEAST:
                    added += [("random", *s) for s in self.random(text, at, stop)]
                at = max(at, base[k][2]) if k < len(base) and stop < end else end
        return base, sorted(added, key=order)


#: What training leaves out of ordinary texts, in the dialect of the JVM.
_NOT_ORDINARY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS, bias: float = BIAS, total: float = TOTAL) -> Scanner:
    """Ratio of both models' log-probabilities.

    The ordinary sample holds at most ``train_words`` different words of at most ``train_docs`` different texts, both drawn by
    hash, without what the base patterns match; only these words and their counts come to the driver. The random sample is drawn
    from alphabets.
    """
    texts = docs.select("text", F.xxhash64("text").alias("h")).filter("text is not null")
    drawn = texts.select("h").distinct().orderBy("h").limit(train_docs)
    words = F.regexp_extract_all(F.regexp_replace("text", _NOT_ORDINARY, " "), F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0))
    one = texts.join(F.broadcast(drawn), "h").groupBy("h").agg(F.first("text").alias("text")).select(F.explode(words).alias("w"))
    one = one.filter(~F.rlike("w", F.lit(f"AKIA[A-Z0-9]+|[0-9a-f]{{16,}}")) & ~((F.length("w") >= LEAST) & F.rlike("w", F.lit("\\d"))))
    counted = one.groupBy("w").count().orderBy(F.xxhash64("w"), "w").limit(train_words).collect()
    found = sorted(w for r in counted for w in [r.w] * min(r["count"], 30))
    ordinary = markov(identifiers(found + BASIC_WORDS * (60 + len(found) // 2000)))
    return Scanner(markov(random_strings()) - ordinary, bias, total)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            names = names or [*batch.schema.names, "spans"]
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                out = []
                for t in part.column(at):
                    base, added = scanner.value.spans(t.as_py() or "")
                    every = [(*s, True) for s in base] + [(*s, False) for s in added]
                    every.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in every])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(span))], names=names)

    return released(run)


def scan(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS, bias: float = BIAS, total: float = TOTAL) -> DataFrame:
    """``docs`` with a column ``spans``: array of (kind, start, end, base), ordered by start and kind.

    Places are code points, the end is exclusive. Null and empty texts have no spans; repeated rows get equal
    ones; an empty table gives no rows. A column named spans in ``docs`` is replaced.
    """
    docs = small_batches(docs).drop("spans")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs, train_words, bias, total))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scan(model), f"{fields}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, checksum and joined spans of a scanned table."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redacted(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Texts with every span (overlapping ones together) replaced by ``mask``; other columns stay."""
    ends = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["end"] <= acc["at"], acc["text"])
            .when(s["start"] < acc["at"], acc["text"])
            .otherwise(F.concat(acc["text"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
            .alias("text"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    clean = F.when(F.size("spans") > 0, F.concat(ends["text"], F.substr(F.col("text"), (ends["at"] + 1).cast("int")))).otherwise(F.col("text"))
    return scanned.withColumn("text", clean).drop("spans")


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
