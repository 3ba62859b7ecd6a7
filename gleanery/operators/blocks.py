"""A stated set of queries against all rows, in blocks.

The queries' terms are known to all tasks. Each Arrow batch of tokenised rows becomes a matrix of term counts, which one
product turns into the scores of all its rows for all queries. Only the best rows of a batch for each query leave
it, so that nothing the size of rows times queries is ever shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.batches import small

#: Queries that are asked at most; their terms are broadcast. Ask more in several goes.
MOST_QUERIES = 20_000
#: Queries that are scored together, and cells of a matrix at most.
GROUP, CELLS = 256, 1 << 21


@dataclass
class Group:
    """Some queries: their ids, distinct terms, and how often each query (column) has each term (row)."""

    qids: np.ndarray
    terms: pa.Array
    counts: np.ndarray
    sizes: np.ndarray  # tokens of each query, repeats counted
    rows: list  # the collected rows of the queries
    df: np.ndarray = field(default_factory=lambda: np.zeros(0))


def asked(queries: DataFrame, tokens: Column, *extra: str) -> list[Group]:
    """The stated queries (qid, ...) with their ``tokens``, in groups. A query without tokens stays, and finds nothing."""
    rows = queries.select("qid", tokens.alias("t"), *extra).orderBy("qid").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    out = []
    for at in range(0, len(rows), GROUP):
        part = rows[at : at + GROUP]
        terms = sorted({w for r in part for w in r.t})
        place = {w: k for k, w in enumerate(terms)}
        counts = np.zeros((len(terms), len(part)))
        for j, r in enumerate(part):
            for w in r.t:
                counts[place[w], j] += 1
        out.append(Group(np.array([r.qid for r in part], np.int64), pa.array(terms, pa.string()), counts, counts.sum(axis=0), part))
    return out


def _places(column: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each row's token list; and row and term of each token that is one of ``terms``."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    return size, row[at >= 0], at[at >= 0].astype(np.int64)


def _matrices(column: pa.ListArray, g: Group) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, lengths, term counts) of stretches of a batch; at most CELLS counts at a time."""
    size, row, term = _places(column, g.terms)
    step, m = max(1, CELLS // max(len(g.terms), 1)), len(g.terms)
    for at in range(0, len(column), step):
        n = min(step, len(column) - at)
        low, high = np.searchsorted(row, [at, at + n])
        yield slice(at, at + n), size[at : at + n], np.bincount((row[low:high] - at) * m + term[low:high], minlength=n * m).reshape(n, m).astype(np.float64)


@dataclass
class Corpus:
    n: int
    tokens: int

    @property
    def mean(self) -> float:
        return self.tokens / max(self.n, 1)


def frequencies(rows: DataFrame, groups: list[Group]) -> Corpus:
    """How many of all ``rows`` (t: tokens) hold each term, put into the groups; and the number and length of rows. Collected: a row per term."""
    terms = pa.array(sorted({w for g in groups for w in g.terms.to_pylist()}), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            size, row, term = _places(batch.column(0), terms)
            df += np.bincount(np.unique(row * len(terms) + term) % max(len(terms), 1), minlength=len(terms))
            n, tokens = n + len(size), tokens + int(size.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, tokens]))], names=["term", "n"])

    got = {r.term: r.n for r in small(rows.select("t")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    whole = np.array([got.get(k, 0) for k in range(len(terms))])
    for g in groups:
        g.df = whole[pc.index_in(g.terms, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)] if len(g.terms) else np.zeros(0)
    return Corpus(got.get(-1, 0), got.get(-2, 0))


#: A scorer: (term counts, lengths, the group, the other columns of the rows) -> scores, a row each and a column per query.
Scorer = Callable[[np.ndarray, np.ndarray, Group, dict[str, np.ndarray]], np.ndarray]


def _best(scores: np.ndarray, ties: list[np.ndarray], first: np.ndarray, limit: int, above: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the best rows for each query: ``first`` ascending, then score descending, then ``ties`` ascending."""
    rows, queries = [], []
    for j in range(scores.shape[1]):
        s = scores[:, j]
        some = np.flatnonzero(s > above)
        if len(some) > limit:
            k = s[some] - first[some] * 1e6
            some = some[k >= np.partition(k, len(k) - limit)[len(k) - limit]]
        some = some[np.lexsort((*[t[some] for t in reversed(ties)], -s[some], first[some]))[:limit]]
        rows.append(some)
        queries.append(np.full(len(some), j))
    return np.concatenate(rows), np.concatenate(queries)


def top(rows: DataFrame, groups: list[Group], score: Scorer, limit: int, digits: int = 6, above: float = 0.0, ties: tuple[str, ...] = (), first: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (id long, t tokens, and numbers named in ``ties``, ``first`` and ``extra``) -> qid, id, score, rank (and ``first``).

    Scores are rounded, then ranked: by ``first`` ascending, score descending, ``ties`` and id ascending. Those not above ``above`` are no hits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(groups)
    names = list(dict.fromkeys([*ties, *([first] if first else []), *extra]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            more = {n: batch.column(2 + k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
            lead = more[first].astype(np.int64) if first else np.zeros(len(ids), np.int64)
            for g in shared.value:
                scores = np.zeros((len(ids), len(g.qids)))
                for part, size, tf in _matrices(batch.column(1), g):
                    scores[part] = score(tf, size, g, {n: x[part] for n, x in more.items()})
                scores = np.round(scores, digits)
                row, q = _best(scores, [*[more[t] for t in ties], ids], lead, limit, above)
                yield pa.RecordBatch.from_arrays([pa.array(g.qids[q]), pa.array(ids[row]), pa.array(scores[row, q]), pa.array(lead[row]), *[pa.array(more[t][row].astype(np.int64)) for t in ties]], names=out)

    out = ["qid", "id", "score", "first", *[f"tie_{t}" for t in ties]]
    schema = "qid long, id long, score double, first long" + "".join(f", tie_{t} long" for t in ties)
    found = small(rows.select("id", "t", *names)).mapInArrow(run, schema)
    w = W.partitionBy("qid").orderBy("first", F.desc("score"), *out[4:], "id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return found.select("qid", "id", "score", "rank", *([F.col("first").alias(first)] if first else []))
