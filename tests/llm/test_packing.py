import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import packing as P
from gleanery.llm.tokens import VOCABULARY, Encoder

HF = Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def enc():
    return Encoder()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'1,.!é<|endoftext|>ßЖ中"), st.characters(codec="utf-8")), max_size=40))
def test_ids_equal_tokenizers(text):
    enc = test_ids_equal_tokenizers.enc = getattr(test_ids_equal_tokenizers, "enc", None) or Encoder()
    for t in (text, "it's <|endoftext|> a  b \n c " + text):
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == HF.encode(t, add_special_tokens=False).ids


def ids_of(text):
    return HF.encode(text or "", add_special_tokens=False).ids + [0]


def check_pieces(rows, texts, window=1024):
    """The contract: each id in one piece, checksums, gapless sequences, padding only at powers of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = ids_of(texts[d]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    check_pieces(P.pack(df).collect(), texts)
    check_pieces(P.pack(df, shard_tokens=5_000, task_tokens=20_000, window=256).collect(), texts, 256)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "a b", "x"), (5, "word " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    check_pieces(P.pack(df).collect(), {r[0]: r[1] for r in rows})
    assert P.pack(df.limit(0)).collect() == []
    twice = P.pack(spark.createDataFrame([(None, "a b"), (None, "c"), (7, "x"), (7, "x")], "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == sum(len(ids_of(t)) for t in ("a b", "c", "x", "x"))


def test_windows_hold_neighbours():
    rng = random.Random(4)
    topics = [np.array([rng.randrange(50_000) for _ in range(40)], "<u2") for _ in range(8)]
    docs = [np.array([rng.choice(topics[k % 8]) for _ in range(100)], "<u2") for k in range(160)]
    same = total = 0
    seqs = defaultdict(list)
    for d, _, _, s, _ in P.pack_shard(docs, 512):
        seqs[s].append(d % 8)
    for topics_in in seqs.values():
        same += sum(a == b for a, b in zip(topics_in, topics_in[1:], strict=False))
        total += len(topics_in) - 1
    assert same > 0.85 * total


def test_scores_are_bm25():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3, 3], [3, 4], [1, 1, 5], [9], [2, 3, 7, 8, 8])]
    index = P.Index(docs)
    mean = sum(map(len, docs)) / 5

    def score(q, d):
        total = 0
        for t in {int(x) for x in docs[q]}:
            df = sum(t in x for x in docs)
            tf = int((docs[d] == t).sum())
            if df > 1 and tf:
                total += np.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return total

    unused = np.array([False, True, True, True, True])
    want = sorted((d for d in range(1, 5) if score(0, d) > 0), key=lambda d: (-score(0, d), d))
    assert index.neighbours(0, unused).tolist() == want


def topical(rng, topics, n):
    """Documents about ``topics`` subjects: common words, and a few rare ones of the subject."""
    common = [f"word{i}" for i in range(300)]
    rare = [[f"t{t}x{rng.randrange(10**6)}" for _ in range(12)] for t in range(topics)]
    return [(d, " ".join(rng.choice(rare[d % topics] if rng.random() < 0.15 else common) for _ in range(60))) for d in range(n)]


@pytest.mark.parametrize("topics", [10, 80])
def test_shards_keep_neighbours(spark, topics):
    """The best unsharded neighbours of a document share its shard, whatever the number of shards."""
    rows = topical(random.Random(topics), topics, topics * 20)
    docs = [np.array(ids_of(t), "<u2") for _, t in rows]
    corpus = P.Corpus.of(docs)
    order = sorted(range(len(docs)), key=lambda i: tuple(corpus.route(docs[i])))
    shard, size, of = 0, 0, {}
    for i in order:
        if size + len(docs[i]) > 3_000:
            shard, size = shard + 1, 0
        of[i], size = shard, size + len(docs[i])
    index, near, total = P.Index(docs, corpus), 0, 0
    for d in range(0, len(docs), 7):
        best = index.neighbours(d, np.arange(len(docs)) != d)[:5]
        near += sum(of[int(b)] == of[d] for b in best)
        total += len(best)
    print(topics, shard + 1, near / total)
    assert shard > 8 and near / total > 3 / (shard + 1)


def test_frequencies_are_those_of_all_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [np.array(ids_of(r.text), "<u2") for r in df.collect()]
    ids = spark.createDataFrame([(bytes(d.tobytes()),) for d in docs], "ids binary")
    got, want = P.corpus_of(ids, "<u2"), P.Corpus.of(docs)
    assert (got.n, round(got.mean, 9)) == (want.n, round(want.mean, 9)) and got.df.tolist() == want.df.tolist()


def plain_pack(docs, window, corpus):
    """The greedy filling, with every score stated anew: pieces (document, start, length, sequence, offset)."""
    n, terms = len(docs), [Counter(d.tolist()) for d in docs]

    def score(q, d):
        norm = P.K1 * (1 - P.B + P.B * len(docs[d]) / corpus.mean)
        return sum(np.log1p((corpus.n - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5)) * terms[d][t] * (P.K1 + 1) / (terms[d][t] + norm) for t in terms[q] if t in terms[d])

    unused, pieces, sequence, filled, seed = set(range(n)), [], 0, 0, None
    while unused:
        near = [(-round(score(seed, d), 9), d) for d in unused if score(seed, d) > 0] if filled else []
        doc = min(near)[1] if near else min(unused)
        unused.discard(doc)
        start = 0
        while start < len(docs[doc]):
            take = min(window - filled, len(docs[doc]) - start)
            seed = seed if filled else doc
            pieces.append((doc, start, take, sequence, filled))
            start, filled = start + take, filled + take
            if filled == window:
                sequence, filled = sequence + 1, 0
    tail, out = [p for p in pieces if p[3] == sequence], [p for p in pieces if p[3] < sequence]
    sizes = [1 << b for b in range(20, -1, -1) if filled >> b & 1]
    at = 0
    for doc, start, length, _, _ in tail:
        while length:
            k = next(k for k in range(len(sizes)) if at < sum(sizes[: k + 1]))
            take = min(length, sum(sizes[: k + 1]) - at)
            out.append((doc, start, take, sequence + k, at - sum(sizes[:k])))
            start, length, at = start + take, length - take, at + take
    return out


def test_brute_force_packing(spark):
    """Documents in the order of their rarest shared terms, cut into shards, each filled greedily: equal to the plain version."""
    rows = topical(random.Random(9), 6, 70) + [(900, None), (901, "a lonely zyzzyva")]
    docs = {d: np.array(ids_of(t), "<u2") for d, t in rows}
    corpus = P.Corpus.of(list(docs.values()))
    key = lambda d: (*corpus.route(docs[d]).tolist(), np.array([xxhash.xxh64(docs[d].tobytes(), seed=42).intdigest()], np.uint64).view(np.int64)[0])
    shards, size = [[]], 0
    for d in sorted(docs, key=key):
        if shards[-1] and size + len(docs[d]) > 1500:
            shards.append([])
            size = 0
        shards[-1].append(d)
        size += len(docs[d])
    want, sequence = set(), 0
    for shard in shards:
        pieces = plain_pack([docs[d] for d in shard], 128, corpus)
        want |= {(shard[d], s, n, sequence + q, o) for d, s, n, q, o in pieces}
        sequence += max(p[3] for p in pieces) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in P.pack(df, window=128, shard_tokens=1500, task_tokens=1 << 30).collect()}
    assert len(shards) > 2 and got == want


def test_routes_are_the_rarest_shared_terms():
    rng = random.Random(2)
    docs = [np.array([rng.randrange(60) for _ in range(rng.choice([1, 3, 40]))], "<u2") for _ in range(50)] + [np.array([99], "<u2")]
    corpus = P.Corpus.of(docs)
    for d, got in zip(docs, corpus.routes(docs).tolist(), strict=True):
        want = sorted(int(corpus.rank[t]) for t in set(d.tolist()) if corpus.df[t] > 1)[: P.ROUTE_TERMS]
        assert got == want + [-1] * (P.ROUTE_TERMS - len(want))
    assert P.Corpus.of([]).routes([]).shape == (0, P.ROUTE_TERMS)


def test_plain_texts_are_encoded_whole(spark, sf):
    """op1's CPU seconds and the pipeline's memory: Latin texts go through no cache of pieces; ids are the tokenizer's."""
    enc = Encoder()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and "  " not in r.text]
    rng = random.Random(3)
    texts += ["".join(rng.choices([" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "a", "é", "ɏ", "'s", "1", ".", "É", "zz"], k=40)).replace("  ", " ") for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == HF.encode(t, add_special_tokens=False).ids
    plain = Encoder()
    plain.encode("un café, señor\nlast line")
    assert not plain.cache
    plain.encode("un café Ж")
    assert set(plain.cache) == {"un", " café", " Ж"}


def test_routes_are_taken_in_stretches(monkeypatch):
    """The pipeline's memory: arrays of a stretch of ids, not of a whole batch."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 500, int(n)).astype("<u2") for n in rng.integers(0, 60, 90)]
    corpus = P.Corpus.of(docs)
    want = corpus.routes(docs)
    sizes, one = [], P.Corpus._routes
    monkeypatch.setattr(P, "ROUTE_TOKENS", 100)
    monkeypatch.setattr(P.Corpus, "_routes", lambda self, part: (sizes.append(sum(map(len, part))), one(self, part))[1])
    assert (corpus.routes(docs) == want).all() and max(sizes) < 160 and sum(sizes) == sum(map(len, docs))
    assert P.Corpus.of([]).routes([]).shape == (0, P.ROUTE_TERMS)
