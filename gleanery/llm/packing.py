"""Lexical retrieval packing with a sharded BM25 inverted index.

Document frequencies of token ids and the mean length are those of all documents. Documents are ordered by their
rarest terms that other documents share, and consecutive ones make a shard of bounded size: a shard
holds a stretch of the inverted index's posting lists, rarest terms first, so that neighbours which share rare
terms share a shard, however many shards there are. Within its shard, a seed document asks with all of its terms; its
unused neighbours, in the order of their BM25 score, fill its window. The one that passes the
window's end is cut there, and seeds the next window with its rest. Only the last window of a shard may
remain partly filled; it is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables
from gleanery.llm.memory import released, small_batches
from gleanery.llm.tokens import RANKS, VOCABULARY, encoder

WINDOW = 1024
SEPARATOR = 0
#: Token ids of a shard; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Token ids of a task, which packs its shards one after another.
TASK_TOKENS = 1 << 22
#: So many of its rarest shared terms place a document in the order from which shards are cut.
ROUTE_TERMS = 4
#: Token ids whose terms are sorted at once, a single longer document aside.
ROUTE_TOKENS = 1 << 17
#: Terms of a shard that more than one in so many documents have are scored as rows of a matrix, others from postings.
DENSE = 8
K1, B = 1.2, 0.75


def _tokenise(vocabulary: str, ranks: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, ranks)
        end = np.array([separator], e.width).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [e.encode(t.as_py()) + end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return released(run, keep="encoder")


@dataclass
class Corpus:
    """Statistics of all documents: how many hold each term, how many there are, and their mean length."""

    df: np.ndarray
    n: int
    mean: float

    @staticmethod
    def of(docs: list[np.ndarray]) -> Corpus:
        df = np.zeros(max((int(d.max()) + 1 for d in docs if len(d)), default=1), np.int64)
        for d in docs:
            df[np.unique(d)] += 1
        return Corpus(df, len(docs), sum(map(len, docs)) / max(len(docs), 1))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - self.df[terms] + 0.5) / (self.df[terms] + 0.5))

    def routes(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each document's rarest terms that another document has, as ranks from rare to frequent; missing ones are -1."""
        stretch = np.cumsum([len(d) for d in docs], dtype=np.int64) // ROUTE_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(docs)]
        return np.concatenate([np.zeros((0, ROUTE_TERMS), np.int64), *[self._routes(docs[a:b]) for a, b in pairwise(cuts) if b > a]])

    def _routes(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(docs), ROUTE_TERMS), -1, np.int64)
        rank = np.where(self.df > 1, self.rank, -1)[np.concatenate(docs)]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        key = np.sort((owner << 32 | rank)[rank >= 0])
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        owner, rank = key >> 32, key & 0xFFFFFFFF
        place = np.arange(len(key)) - np.searchsorted(owner, np.arange(len(docs)))[owner]
        few = place < ROUTE_TERMS
        out[owner[few], place[few]] = rank[few]
        return out

    def route(self, ids: np.ndarray) -> np.ndarray:
        return self.routes([ids])[0]

    @property
    def rank(self) -> np.ndarray:
        if not hasattr(self, "_rank"):
            self._rank = np.empty(len(self.df), np.int64)
            self._rank[np.lexsort((np.arange(len(self.df)), self.df))] = np.arange(len(self.df))
        return self._rank


def _views(column: pa.Array, width: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), width) for x in column]


def _frequencies(width: str):
    """(term, n): documents that hold each term; -1 for all documents, -2 for all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for ids in _views(batch.column(0), width):
                if int(ids.max()) >= len(df):
                    df = np.concatenate([df, np.zeros(int(ids.max()) + 1, np.int64)])
                df[np.unique(ids)] += 1
                n, size = n + 1, size + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, size]))], names=["term", "n"])

    return released(run)


def corpus_of(ids: DataFrame, width: str) -> Corpus:
    """Counted over all rows of ``ids`` (ids binary); what is collected has a row per id of the vocabulary at most."""
    got = ids.select("ids").mapInArrow(_frequencies(width), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    total = {int(t): int(c) for t, c in zip(term[term < 0], n[term < 0], strict=True)}
    df = np.zeros(int(term.max(initial=0)) + 1, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Corpus(df, total.get(-1, 0), total.get(-2, 0) / max(total.get(-1, 0), 1))


ROUTES = ", ".join(f"r{k} int" for k in range(ROUTE_TERMS))


def _routed(width: str, corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = corpus.value.routes(_views(batch.column(2), width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[pa.array(routes[:, k]) for k in range(ROUTE_TERMS)], *batch.columns], names=[*[f"r{k}" for k in range(ROUTE_TERMS)], "row", "doc_id", "ids"])

    return released(run)


class Index:
    """BM25 impacts of the terms of one shard, with the whole corpus' frequencies and mean length."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(docs)
        n = len(docs)
        length = np.array([len(d) for d in docs], np.float64)
        owner = np.repeat(np.arange(n, dtype=np.int64), length.astype(np.int64))
        terms = np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64)
        pair, tf = np.unique(terms * n + owner, return_counts=True)
        term, doc = pair // max(n, 1), pair % max(n, 1)
        self.terms, start, df = np.unique(term, return_index=True, return_counts=True)
        norm = K1 * (1 - B + B * length / max(corpus.mean, 1))
        impact = np.repeat(corpus.idf(self.terms), df) * tf * (K1 + 1) / (tf + norm[doc])
        self.n, self.df, self.doc, self.impact, self.start = n, df, doc, impact, start
        order = np.argsort(doc, kind="stable")
        self.of_doc = np.repeat(np.arange(len(self.terms)), df)[order]
        self.at_doc = np.searchsorted(doc[order], np.arange(n + 1))
        often = df * DENSE > n  # at most DENSE times as many cells as postings
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), n))
        rows = np.repeat(self.row, df)
        self.dense[rows[rows >= 0], doc[rows >= 0]] = impact[rows >= 0]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents of the shard for the terms of ``doc``."""
        own = self.of_doc[self.at_doc[doc] : self.at_doc[doc + 1]]
        rows = self.row[own]
        rare = own[(rows < 0) & (self.df[own] > 1)]
        size = self.df[rare]
        at = np.repeat(self.start[rare] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.dense[rows[rows >= 0]].sum(axis=0) + np.bincount(self.doc[at], self.impact[at], minlength=self.n)

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a term of ``doc``, best first (ties by position)."""
        score = self.scores(doc)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every id of ``docs`` once."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = filled = 0
    seed, ranked, following = -1, iter(()), 0
    for _ in range(len(docs)):
        doc = next((int(d) for d in ranked if unused[d]), -1)
        if doc < 0 and seed >= 0 and filled:
            ranked = iter(index.neighbours(seed, unused).tolist())
            doc = next(ranked, -1)
        if doc < 0:
            while not unused[following]:
                following += 1
            doc = following
        unused[doc] = False
        start, n = 0, len(docs[doc])
        while start < n:
            take = min(window - filled, n - start)
            if not filled:
                seed, ranked = doc, iter(())
            pieces.append((doc, start, take, sequence, filled))
            start, filled = start + take, filled + take
            if filled == window:
                sequence, filled, ranked = sequence + 1, 0, iter(())
    return _powers_of_two(pieces, sequence, filled, window)


def _powers_of_two(pieces: list, sequence: int, filled: int, window: int) -> list:
    """Cut the last sequence, if it isn't full, into sequences whose lengths are powers of two."""
    last = len(pieces)
    while last and pieces[last - 1][3] == sequence:
        last -= 1
    out, tail = pieces[:last], pieces[last:]
    size, room = 0, 0
    sequence -= 1
    for doc, start, length, _, _ in tail:
        while length:
            if not room:
                size = room = 1 << (filled.bit_length() - 1)
                filled -= size
                sequence += 1
            take = min(room, length)
            out.append((doc, start, take, sequence, size - room))
            start, length, room = start + take, length - take, room - take
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long"


def _pack(width: str, window: int, shard_tokens: int, corpus):
    """Cut a sorted partition into shards, and pack one after another; only one is held at a time."""

    def shard(docs: list[np.ndarray], names: list[int | None], first_sequence: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack_shard(docs, window, corpus.value)
        first = {}
        for d, _, _, s, _ in pieces:
            first.setdefault(s, names[d])
        cols = [
            pa.array([names[d] for d, *_ in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces], pa.int64()),
            pa.array([len(docs[d]) for d, *_ in pieces], pa.int64()),
            pa.array([first_sequence + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array([first[p[3]] for p in pieces], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PIECES.split(", ")]), first_sequence + pieces[-1][3] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        docs, names, size = [], [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), _views(batch.column(1), width), strict=True):
                if docs and size + len(ids) > shard_tokens:
                    out, sequence = shard(docs, names, sequence)
                    yield out
                    docs, names, size = [], [], 0
                docs.append(ids.copy())
                names.append(name)
                size += len(ids)
        if docs:
            yield shard(docs, names, sequence)[0]

    return released(run)


def pack(docs: DataFrame, window: int = WINDOW, separator: int = SEPARATOR, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """``docs`` (doc_id, text, and others that are not read) -> one row per piece of ``PIECES``.

    A null or empty text is its separator alone. Rows are packed one by one, whatever they share: a
    repeated row or doc_id is packed as often as it comes, a null doc_id stays null; repeats of a row are told apart by their place in the
    input, so that a group of them is split between tasks. A text of any length is cut into as many windows as it needs. An
    empty table gives no rows. Ids are written once to the shared folder, as counting, ordering and packing read them.
    """
    ids = small_batches(docs).select("doc_id", "text").mapInArrow(_tokenise(vocabulary, ranks, separator), "doc_id long, ids binary")
    width = encoder(vocabulary, ranks).width.str
    ids = tables.table(ids)
    counted = corpus_of(ids, width)
    corpus = docs.sparkSession.sparkContext.broadcast(counted)
    routes = [f"r{k}" for k in range(ROUTE_TERMS)]
    keyed = ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids").mapInArrow(_routed(width, corpus), f"{ROUTES}, row long, doc_id long, ids binary")
    order = [*routes, F.xxhash64("ids"), "row"]
    tasks = max(1, -(-int(counted.n * counted.mean) // task_tokens))
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(_pack(width, window, shard_tokens, corpus), PIECES)
