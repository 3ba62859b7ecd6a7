import random
import re

import regex

from gleanery.llm import templates as T

Q = "A train leaves the old town at 9 and travels 60 km per hour with Maria for 9 hours until it meets the other train near the bridge"


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "text AS h")


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").selectExpr("item_id", "text", "text AS pos")


def found(df):
    return {(r.doc_id, r.item_id): r.kind for r in df.collect()}


def test_template(spark):
    df = spark.createDataFrame([("It cost 12.50 dollars, said Anna to him. Then 5km -- 7 apples! (Or so) 1,000",)], "text string")
    got = df.select(T.template(df.text).alias("t")).first().t
    n, a, u = T.NUMBER, T.NAME, T.UNIT
    assert got.split() == f"it cost {n} {u} said {a} to him then {n}{u} -- {n} apples or so {n}".split()


def test_copies_and_new_parameters(spark):
    other = Q.replace(" 9 ", " 11 ").replace("60 km", "45 miles").replace("Maria", "Peter")
    uneven = Q.replace("at 9", "at 7").replace("60 km", "45 miles")
    docs = rows(spark, ["x y z. " + Q + ". And more", other, uneven, None, "", "too short", Q.upper(), "some clean text without any link to the question of the trains " * 3, "At 9 and 8 and 7 and 6 and 5 and 4 and 3 and 2"])
    got = found(T.matches(docs, bench(spark, Q, None, "tiny")))
    assert got[(0, 0)] == "copy" and got[(1, 0)] == "re-parameterised"
    assert set(got) <= {(0, 0), (1, 0), (2, 0), (6, 0)}
    assert found(T.matches(docs, bench(spark, Q, None, "tiny"), broadcast_windows=0)) == got
    assert T.matches(docs.limit(0), bench(spark, Q).limit(0)).collect() == []


def plain_windows(text, width=T.WINDOW):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [w.strip(T._MARKS).lower() for w in words]
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def test_planted_passages(spark, sf):
    rng = random.Random(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = {}
    for k in range(20):
        i = rng.randrange(len(items))
        d, text = docs[k]
        at = len(text) // 2
        docs[k] = (d, text[:at] + " " + items[i][1] + " " + text[at:])
        planted[d] = items[i][0]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(T.matches(df, spark.createDataFrame(items, "item_id long, text string")))
    assert {(d, i) for d, i in planted.items()} <= set(got)
    by = {}
    for i, t in items:
        for w in plain_windows(t):
            by.setdefault(w, set()).add(i)
    sharing = {(d, i) for d, t in docs for w in plain_windows(t) for i in by.get(w, ())}
    assert set(got) <= sharing


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = T.clean(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert df.columns == docs.columns
    assert not re.search("Python|Pandas|Arrow|MapIn", df._jdf.queryExecution().toString())


def test_inconsistent_places_cost_their_own_windows_only(spark):
    tail = " and then everyone walks along the river to the little market where the old baker sells warm bread"
    item = "We buy 5 pears and 5 plums at noon from the market" + tail
    edited, uneven = item.replace("5 plums", "6 plums"), item.replace("5 pears", "6 pears").replace("5 plums", "7 plums")
    got = found(T.matches(rows(spark, [edited, uneven]), bench(spark, item)))
    assert set(got) == {(0, 0), (1, 0)}
    # a doc_id that two texts share: the true copy still counts
    df = spark.createDataFrame([(1, Q), (1, Q.replace(" 9 ", " 11 ").replace("Maria", "Peter"))], "doc_id long, text string")
    assert found(T.matches(df, bench(spark, Q))) == {(1, 0): "copy"}


def test_short_and_numeric_items_are_found_as_whole_copies(spark):
    items = ["What is the capital of France?", "2 4 8 16 32 64 128 256 512 1024", "5 - 3 = 2", "", "Paris lies on the river Seine in France"]
    texts = ["He asked: what is the capital of France? Nobody knew.", "see 2 4 8 16 32 64 128 256 512 1024 here", "see 2 4 8 16 32 64 128 256 512 1025 here", "so 5 - 3 = 2.", "so 5 + 3 = 2", "they say that Paris lies on the river Seine in France today", "What is the capital of Spain?"]
    got = found(T.matches(rows(spark, texts), bench(spark, *items)))
    assert got == {(0, 0): "copy", (1, 1): "copy", (3, 2): "copy", (5, 4): "copy"}
    assert found(T.matches(rows(spark, texts), bench(spark, *items), broadcast_windows=0)) == got


# ---- a plain restatement ------------------------------------------------------------------------

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text) if w]


def joined(text):
    return regex.sub(r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;] \p{Lu}\p{Ll}{1,20} )", T.JOINT, text)


def template(text):
    t = regex.sub(rf"(?<=[\p{{Ll}}\p{{N}},;] )\p{{Lu}}\p{{Ll}}+(?:{T.JOINT}\p{{Lu}}\p{{Ll}}+)*", T.NAME, text)
    t = re.sub(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*", T.NUMBER, t)
    t = regex.sub(rf"(?i)(?<={T.NUMBER} |{T.NUMBER})(?:{T.UNITS})(?![\p{{L}}\p{{N}}])", T.UNIT, t)
    t = t.translate({ord(c): "-" for c in T._MARKS})
    return words(re.sub(r"(?<=[^\x20\x09-\x0D-])-+|-+(?=[^\x20\x09-\x0D-])", "", t).lower())


def slot(w):
    return any(c in w for c in (T.NUMBER, T.NAME, T.UNIT))


def fillers(text):
    return {k: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", o).lower() for k, (t, o) in enumerate(zip(template(text), words(text), strict=True)) if slot(t)}


def plain(text):
    around = "[" + re.escape(".,;:!?\"'()[]{}…«»“”‘’„¿¡") + "]+"
    return [w for w in (re.sub(f"^{around}|{around}$", "", w).lower() for w in words(text.replace(T.JOINT, " "))) if w]


def plain_matches(docs, items, width=T.WINDOW, literals=T.LITERALS, least=T.LEAST):
    out = {}
    for item, text in {(i, joined(x)) for i, x in items if i is not None and x is not None}:
        tw = template(text)
        enough = lambda i: sum(not slot(w) for w in tw[i : i + width]) >= literals  # noqa: B023, E731
        own = {i: tuple(tw[i : i + width]) for i in range(len(tw) - width + 1) if enough(i)}
        after = "a " + re.sub(r"^[\x20\x09-\x0D]+", "", text)
        first = template(after)[1:2]
        other = {(first[0], *tw[1:width])} if 0 in own and first and first[0] != tw[0] else set()
        n_item = len(set(own.values()))
        theirs = {k - 1: f for k, f in fillers(after).items()}
        for doc, x in {(i, joined(x)) for i, x in docs if i is not None and x is not None}:
            if not n_item:
                a, b = plain(text), plain(x)
                if a and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1)):
                    out.setdefault((doc, item), []).append((0, 0, 0, 0, 0))
                continue
            dw, ours, runs = template(x), fillers(x), {}
            for i in range(len(dw) - width + 1):
                w = tuple(dw[i : i + width])
                for k in [k for k, v in own.items() if v == w] + ([0] if w in other else []):
                    runs.setdefault(i - k, set()).add((k, w))
            for shift, windows in runs.items():
                places = {k + j for k, _ in windows for j in range(width)}
                slots = [(p, theirs[p], ours[p + shift]) for p in places if p in theirs and p + shift in ours]
                good = set()
                for k, w in windows:
                    here = {(b, d) for p, b, d in slots if k <= p < k + width}
                    if len(here) == len({b for b, _ in here}):
                        good.add((k, w))
                slots = [s for s in slots if any(k <= s[0] < k + width for k, _ in good)]
                n = len({w for _, w in good})
                if n and n >= min(least, n_item):
                    out.setdefault((doc, item), []).append((min(n, n_item), -sum(b != d for _, b, d in slots), -shift, n_item, len(slots)))
    best = {k: max(v) for k, v in out.items()}
    return {(d, i, n, total, slots, -changed, "re-parameterised" if changed else "copy") for (d, i), (n, changed, _, total, slots) in best.items()}


def question(rng):
    name = lambda: " ".join(rng.choice("ABDEJKLM") + "".join(rng.choice("aeilnor") for _ in range(4)) for _ in range(rng.choice([1, 2, 3])))
    verbs = [rng.choice(["carries", "sells", "paints", "counts", "moves", "finds"]) for _ in range(3)]
    things = [rng.choice(["apples", "stones", "boxes", "letters", "coins"]) for _ in range(3)]
    shape = f"Every day a man called {{0}} {verbs[0]} {{1}} {things[0]} for {{2}} km and {verbs[1]} {{3}} {things[1]} while {{4}} {verbs[2]} all {things[2]} in {{2}} hours, how many {things[0]} are left"
    fill = lambda: (name(), rng.randrange(2, 90), rng.randrange(91, 200), rng.randrange(201, 900), name())
    return shape, fill


def test_brute_force_and_recall(spark):
    """Equal to the plain version; and of re-parameterised copies, with names of other lengths, nine in ten are found."""
    rng = random.Random(12)
    items, docs, planted = [(900, "What is the capital of France today"), (901, "1 2 3 4 5 6 7 8 9"), (902, None), (903, "")], [], set()
    filler = lambda: " ".join(rng.choice(["the", "river", "Bob", "runs", "12", "over", "green", "hills,", "and", "then.", "We"]) for _ in range(rng.randrange(0, 30)))
    for i in range(25):
        shape, fill = question(rng)
        items.append((i, shape.format(*fill())))
        for k in range(4):
            text = shape.format(*fill()) if k else items[-1][1]
            if k == 3:  # one number edited: the windows beside it still count
                text = items[-1][1].replace("km", "km", 1)
                text = re.sub(r"\d+", "7", text, count=1)
            docs.append((i * 10 + k, f"{filler()} {text}. {filler()}"))
            planted.add((i * 10 + k, i))
    docs += [(5000 + k, filler() * 3) for k in range(20)] + [(6000, "so: what is the capital of France today?"), (6001, "x 1 2 3 4 5 6 7 8 9 y"), (6001, None), (None, items[5][1]), (6002, ""), (0, docs[0][1])]
    got = T.matches(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h long"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_matches(docs, items)
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_item_windows, r.n_slots, r.n_changed, r.kind) for r in got} == want
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & planted) >= 0.9 * len(planted) and {(6000, 900), (6001, 901)} <= found
    assert not any(d in range(5000, 5020) for d, _ in found)


def test_one_edited_number_in_a_long_question(spark):
    item = "A train leaves the old station at 9 and drives 120 km to the north while another train leaves the harbour at 9 and drives 80 km south today"
    docs = spark.createDataFrame([(1, "copy: " + item.replace("at 9 and drives 80", "at 7 and drives 80")), (2, "x " * 100_000 + item)], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in T.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[2] == "copy"


def test_only_texts_with_a_part_of_a_window_are_searched_at_every_place(spark, monkeypatch):
    seen = []
    whole = T._windows
    monkeypatch.setattr(T, "_windows", lambda rows, width: seen.extend(r.id for r in rows.collect()) or whole(rows, width))
    docs = rows(spark, ["some clean text without any link to the question of the trains " * 3, "so: " + Q, "too short", "", None, "the old town lies near the bridge and the train meets the other train there"])
    assert found(T.matches(docs, bench(spark, Q))) == {(1, 0): "copy"}
    assert seen == [1]


def test_windows_are_found_at_every_place_and_width(spark):
    """Parts are taken at some places only; a window holds one wherever it begins, also at a text's end and for other widths."""
    item = "Paris sells bread in 5 small shops near the river"
    docs = [(k, "then " * k + item + tail) for k in range(9) for tail in ("", " and")][::-1] + [(50 + k, " ".join(item.split()[:k])) for k in range(11)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), [(1, item), (2, "The 9 small shops near the old river sell bread for 3 euros")]
    for width in (1, 7, 8):
        got = T.matches(df, spark.createDataFrame(items, "item_id long, text string"), width=width, literals=1, least=1, broadcast_windows=0 if width == 7 else 1000)
        want = plain_matches(docs, items, width=width, literals=1, least=1)
        assert {(r.doc_id, r.item_id, r.n_windows, r.n_item_windows, r.n_slots, r.n_changed, r.kind) for r in got.collect()} == want


def test_template_of_odd_texts(spark):
    rng = random.Random(44)
    bits = ["a", "é", "ñ", "Z", "Jo", "Anna", "Bob Carl", " ", " ", " ", "  ", "\t", "\n", "-", "--", "+", ".", ",", ";", "'", "…", "5", "+3", "-4", "1,000", "9:30", "km", " KM", "km/h", "percent", "%", "$", "\\", T.JOINT, T.NUMBER, T.UNIT, T.NAME, "²", "\u2028"]
    texts = ["", " ", "-", "--a", "a--", " -- ", "5", "+", "5 km", "5  km", "+-5km", *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000))]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", T._words(T.template(T.F.col("text"))).alias("t")).collect()
    assert [t for r in got if r.t != (t := template(texts[r.k]))] == []


def test_names_and_numbers_of_any_length(spark):
    """A repeated name or a long number takes no stack frame for each repeat; it is one placeholder."""
    n = 100_000
    long = {1: "the " + "De " * n, 2: "a " + "Éenle " * n + "2. ", 3: "at 1" + ".1" * n + " ", 4: "a 1" + ",000" * n + " km ", 5: "so +" + "1:" * n + " "}
    docs = spark.createDataFrame([(k, x + Q) for k, x in long.items()], "doc_id long, text string")
    got = {r.doc_id: r.t for r in docs.select("doc_id", T._words(T.template(T.named(T.F.col("text")))).alias("t")).collect()}
    number, name, unit = T.NUMBER, T.NAME, T.UNIT
    heads = {1: ["the", name], 2: ["a", name, number], 3: ["at", number], 4: ["a", number, unit], 5: ["so", number]}
    assert all(got[k][: len(h)] == h and len(got[k]) < 40 for k, h in heads.items())
    assert found(T.matches(docs, bench(spark, Q))) == {(k, 0): "copy" for k in long}
