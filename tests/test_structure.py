"""Sections, blocks and chunks of Markdown against a line-by-line state machine."""

import random

import pytest

from gleanery import queries as Q
from gleanery.operators import structure as S
from tests import plain

PARTS = [
    "# Title", "## Part one", "### Deep  ", "#### a", "#no heading", "text goes on", "Ends here. Next one! And?", "", "   ", "- item", "* other item", "  - inner", "1. first", "2) second",
    "  indented", "    far indented", "| a | b |", "|---|:-:|", "| 1 | 2 |", "```js", "```", "~~~", "key: value", "---", "É ü ñ. Ü", "x" * 90, "||", "|one|", "+ plus", "-no item", "10. tenth",
]


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, "s.md", rng.choice(["\n", "\r\n"]).join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40)))) for i in range(n)]


FIXED = [
    (900, "a", None), (901, "a", ""), (902, "a", "---\na: 1\nb.c: x y\n---\n# H\nt"), (903, "a", "---\nnever closed\n# H"), (904, "a", "a: 1\nb: 2\n\nrest"), (905, "a", "a: 1\nb: 2"), (906, "a", "a: 1\nnot a pair\n# H"), (907, "a", "\n\n# H\n\n"),
    (908, "a", "- a\n\n\n  more\n\nend\n- b"), (909, "a", "```\n# no\n- no\n| no |"), (910, "a", "- a\n| t |\n- b\n# H\n- c"), (911, "a", "# Summary\n\n" + "A" * 900 + "\n\n" + "A" * 900), (912, "a", "# a\n# b\n### c\n## d\n# e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return texts(1, 300) + FIXED


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, content string").repartition(3)


def test_sections_and_blocks(spark, docs):
    df = frame(spark, docs)
    want_s, want_b = [], []
    for i, _, text in docs:
        s, b = plain.sections(text)
        want_s += [(i, a, e, max(level, 1), h or "document", c) for a, e, level, h, c in s]
        want_b += [(i, kind, a, e, v) for kind, a, e, v in b]
    got = [(r.id, r.start_line, r.end_line, r.level, r.title, r.content) for r in S.sections(df).collect()]
    assert sorted(got) == sorted(want_s) and len(got) > 500
    value = {"code": lambda r: (r.language, r.content), "table": lambda r: (r.headers, r.n_rows), "list": lambda r: (r["items"], r.ordered)}
    got = [(r.id, r.block, r.start_line, r.end_line, value[r.block](r)) for r in S.blocks(df).collect()]
    assert sorted(got, key=str) == sorted(want_b, key=str) and {g[1] for g in got} == {"code", "table", "list"}


def test_names_and_parents(spark):
    rows = S.sections(frame(spark, [(1, "a", "pre\n# A b!\n## C\n#### D\n## C\n# É-x y\n### F")])).orderBy("n").collect()
    assert [r.section_id for r in rows] == ["section-1", "section-a-b", "section-c", "section-d", "section-c", "section-é-x-y", "section-f"]
    by = {r.section: r.title for r in rows}
    assert [by.get(r.parent) for r in rows] == [None, None, "A b!", "C", "A b!", None, "É-x y"]


def test_front_matter(spark):
    got = sorted((r.id, r.key, r.value) for r in S.metadata(frame(spark, FIXED + [(1, "a", "k: 1\nk: 2\nj:  x  \n\nk: 3")])).collect())
    assert got == [(1, "j", "x"), (1, "k", "2"), (902, "a", "1"), (902, "b.c", "x y"), (904, "a", "1"), (904, "b", "2"), (905, "a", "1"), (905, "b", "2"), (906, "a", "1")]


@pytest.mark.parametrize("size", [300, 700])
def test_chunks(spark, docs, size):
    rng = random.Random(size)
    long = [(2000 + k, "long.md" if k % 2 else " ", "# L\n" + "\n\n".join(" ".join(rng.choice(["word.", "w!", "y" * rng.randrange(1, 500), "and"]) for _ in range(rng.randrange(1, 60))) for _ in range(5))) for k in range(20)]
    want = []
    for i, source, text in docs + long:
        n = 0
        for k, (a, e, level, h, c) in enumerate(plain.sections(text)[0]):
            name = "-".join("".join(x for x in h.lower() if x.isalnum() or x in " -").split()) or str(k + 1)
            for j, p in enumerate(plain.pieces(c, size)):
                want.append((i, f"{source.strip() or 'inline'}#section-{name}-{j + 1}", n, h or "document", max(level, 1), a, e, p))
                n += 1
    got = [tuple(r) for r in S.section_chunks(frame(spark, docs + long), size).collect()]
    assert sorted(got) == sorted(want)


def test_reference_example(spark):
    got = S.section_chunks(frame(spark, [(1, "docs/n.md", "# Summary\n\n" + "A" * 900 + "\n\n" + "A" * 900)]), 700).collect()
    assert len(got) >= 3 and {r.title for r in got} == {"Summary"} and all(r.chunk_id.startswith("docs/n.md#") for r in got)


def test_query_against_plain(spark, sf):
    docs = [(r.id, r.content) for r in Q.queries_docs._markdown(spark, sf).collect()]
    want = sum(len(plain.pieces(c, 700)) for _, text in docs for *_, c in plain.sections(text)[0])
    assert Q.QUERIES["p5_section_chunks"](spark, sf).count() == want
