import hashlib
import random
import re

import regex
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import surrogates as S

TEXTS = [
    "Write to anna.b@mail4.example.com or ANNA.B@mail4.example.com, card 4785380592391139 and 4785 3805 9239 1139.",
    "Host 152.143.123.131, mail 34@mail7.example.com, ssn 123-45-6789, call +49 30 1234 5678!",
    "Mrs. Anna Smith met Mr. John Smith; Mr. Smith left. Г-н Иванов пришёл.",
    "No entity here, 12 apples and v1.2.",
    "anna.b@mail4.example.com",
]


def test_replacement(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(10, None, "x"), (11, "", "x"), (None, TEXTS[4], "x"), (12, "word " * 50_000 + TEXTS[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    first = {r.doc_id: r for r in S.replace(df, "k1").collect()}
    assert len(first) == len(rows)
    mail = first[4].text
    assert re.fullmatch(r"[a-z]{4}\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", mail) and mail != TEXTS[4]
    m = re.fullmatch(r"Write to (\S+) or (\S+), card (\d{16}) and (\d{4} \d{4} \d{4} \d{4})\.", first[0].text)
    assert m and m[1] == m[2] == mail == first[None].text and m[3] == m[4].replace(" ", "") and m[3] != "4785380592391139" and m[3][0] == "4"
    m = re.fullmatch(r"Host (\S+), mail (\S+), ssn (\d{3}-\d{2}-\d{4}), call (\+\d\d \d\d \d{4} \d{4})!", first[1].text)
    assert m and all(0 < int(x) < 256 for x in m[1].split("."))
    m = re.fullmatch(r"Mrs\. (\w+a) (\w+) met Mr\. (\w+n) (\w+); Mr\. (\w+) left\. Г-н (\w+) пришёл\.", first[2].text)
    assert m and m[2] == m[4] == m[5] != "Smith" and re.fullmatch("[А-Яа-я]+", m[6]) and m[6] != "Иванов"
    assert first[3].text == TEXTS[3] and first[10].text is None and first[11].text == ""
    assert first[12].text == "word " * 50_000 + mail
    assert first[1].kinds == "ip,email,ssn,phone" and first[2].n_entities == 4
    assert not re.search("Python|Arrow|Pandas", S.replace(df, "k2")._jdf.queryExecution().toString())


def test_collisions_are_resolved(spark, monkeypatch):
    """With a surrogate space as small as the entities', all stay distinct and none is another's real value."""
    small = lambda kind, canon, key, attempt: S.F.when(attempt < 0, S.F.concat(S.F.lit("mask"), canon)).otherwise(S.F.concat(S.F.lit("10.0.0."), (S.F.crc32(S.F.concat_ws("/", canon, attempt).cast("binary")) % 40).cast("string")))
    monkeypatch.setattr(S, "surrogate", small)
    texts = [f"10.0.0.{i}" for i in range(0, 40, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in S.replace(df, "k").collect()]
    assert len(set(out)) == len(texts) and not set(out) & set(texts)


def test_no_name_is_masked_where_names_crowd(spark):
    """More names of one length than that length has surrogates: all get their own, of the same script and ending."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Q{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676]}w" for i in range(900)]
    df = spark.createDataFrame([(i, f"We met Mrs. {n} there.") for i, n in enumerate(names)], "doc_id long, text string")
    out = [re.fullmatch(r"We met Mrs\. (\w+) there\.", r.text)[1] for r in S.replace(df, "k").collect()]
    assert len(set(out)) == len(names) and not set(out) & set(names)
    assert all(re.fullmatch("[A-Z][a-z]+er", x) for x in out)


# ---- a plain restatement ------------------------------------------------------------------------


def pick(h, i, letters):
    return letters[(int(h[i * 2 % 126 : i * 2 % 126 + 2], 16) + i // 63 * 7) % len(letters)]


def shaped(text, h):
    kinds = (S._LOWER, S._UPPER, S._DIGITS)
    return "".join(next((pick(h, i, k) for k in kinds if c in k), c) for i, c in enumerate(text))


def word(h, name, ending, longer):
    script = "greek" if "Ͱ" <= name[0] <= "Ͽ" else "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"
    vowels, consonants, *ends = S.SCRIPTS[script]
    end = ends[ending - 2]
    body = "".join(pick(h, i, vowels if i % 2 else consonants) for i in range(max(2, len(name) - len(end)) + longer))
    return (body + (consonants[0] if body[-1] in vowels and end[0] in vowels else "") + end).capitalize()


def luhn(body):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_rest(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def plain_surrogate(kind, canon, key, attempt):
    text = "\x1f".join([key, kind, canon, str(attempt)])
    h = "".join(hashlib.sha256((k + text).encode()).hexdigest() for k in "01")
    longer = 2 * max(0, attempt - S.ATTEMPTS + 1)
    if kind == "email":
        body, host = canon.rsplit(".", 1)
        return "".join(pick(h, 62 - i % 60, S._LOWER) for i in range(longer)) + shaped(body, h) + "." + host
    if kind == "ip":
        return ".".join(str(int(h[4 * k : 4 * k + 4], 16) % 254 + 1) for k in range(4))
    if kind == "iban":
        new = canon[:2] + shaped(canon[2:], h)
        return new[:2] + f"{98 - iban_rest(new[:2] + '00' + new[4:]):02d}" + new[4:] if iban_rest(canon) == 1 else new
    if kind in ("number", "phone"):
        new = canon[0] + shaped(canon[1:], h)
        return new[:-1] + luhn(new[:-1]) if kind == "number" and luhn(canon[:-1]) == canon[-1] else new
    if kind == "ssn":
        return shaped(canon, h)
    return word(h, canon, {"given-f": 2, "given-m": 3}.get(kind, 4), longer)


def spark_hash(*parts):
    h = 42
    for x in parts:
        h = xxhash.xxh64(x.encode(), seed=h).intdigest()
    return h - 2**64 if h >= 2**63 else h


def plain_replace(texts, key):
    """Entities by Python's ``regex``, surrogates one unit at a time, rounds over plain sets."""
    group = lambda k: "name" if k.startswith("given") or k == "family" else k
    found, sexes = [], {}
    for t in texts:
        names = regex.findall(S.NAME, t)
        words = sorted({w for n in names for w in (n, *n.split())}, key=lambda w: -len(w))
        given = {n.split()[0] for n in names if " " in n}
        pattern = S.ANY + (rf"|(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])" if words else "")
        here, at = [], 0
        for m in regex.finditer(pattern, t):
            e, before, at = m[0], t[at : m.start()], m.end()
            kind = next((k for k, p in S.KINDS[:-1] if regex.fullmatch(p, e)), "name")
            if kind == "name":
                sex = 1 if regex.search(rf"(?:{S._TITLES_F})\.? $", before) else -1 if regex.search(rf"(?:{S._TITLES_M})\.? $", before) else 0
                units = [("given", e.split()[0], sex), ("family", e.split()[-1], 0)] if " " in e else [("given" if e in given else "family", e, sex)]
            elif kind in ("iban", "number", "ssn", "phone"):
                units = [(kind, re.sub("[ .()-]", "", e), 0)]
            else:
                units = [(kind, e.lower() if kind == "email" else e, 0)]
            for k, c, x in units:
                sexes[k, c] = sexes.get((k, c), 0) + x
            here.append((m.start(), m.end(), e, units))
        found.append(here)
    final = lambda k, c: k if k != "given" else "given-f" if sexes[k, c] > 0 else "given-m" if sexes[k, c] < 0 else "given-n"
    left = {(final(k, c), c) for k, c in sexes}
    real, taken, own, attempt = {(group(k), c) for k, c in left}, set(), {}, 0
    while left:
        free = {}
        for k, c in sorted(left, key=lambda u: (spark_hash(key, *u), u)):
            free.setdefault((group(k), plain_surrogate(k, c, key, attempt)), (k, c))
        for s, u in free.items():
            if s not in real and s not in taken:
                own[u] = s[1]
                taken.add(s)
                left.discard(u)
        attempt += 1
    out = []
    for t, here in zip(texts, found, strict=True):
        for a, b, e, units in reversed(here):
            new = " ".join(own[final(k, c), c] for k, c, _ in units)
            if units[0][0] in ("iban", "number", "ssn", "phone"):
                digits = iter(re.sub("[ .()-]", "", new))
                new = "".join(c if c in " .()-" else next(digits) for c in e)
            t = t[:a] + new + t[b:]
        out.append(t)
    return out


def many_texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda n: rng.choice("ABCKLMW") + "".join(rng.choice("aeilorstn") for _ in range(n))
    out = []
    for i in range(150):
        given, family = name(3), name(rng.choice([2, 3, 6]))
        out.append(f"{rng.choice(['Mrs.', 'Mr.', 'Dr.', 'Frau', 'Sig.ra'])} {given} {family} wrote to {rng.choice(letters)}{i % 7}@x{i % 3}.org. {given} replied; {given} {family} left, and {family} too.")
        out.append(f"Γιατί; Κυρία {rng.choice('ΑΒΓ')}{'λκ'[i % 2]}ου, 10.0.{i % 5}.{i}, {4000000000000000 + i * 7919}, {i % 900 + 100}-12-{3000 + i}, DE89 3704 0044 0532 0130 {i % 10}0.")
    return out + TEXTS


def test_brute_force(spark):
    texts = many_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for broadcast in (S.BROADCAST_ENTITIES, 0):
        got = {r.doc_id: r.text for r in S.replace(df, "some key", broadcast).collect()}
        want = plain_replace(texts, "some key")
        assert [got[i] for i in range(len(texts))] == want


def test_names_keep_their_person(spark):
    """Short family names get no mask; one first name gets one surrogate, whatever the title, also where none precedes."""
    families = "Lee Wood Webb Koch Roy Fox Ng Kim Day May".split()
    df = spark.createDataFrame([(i, f"Mr. John {n} wrote to Mrs. Anna {n}. Anna {n} replied. Dr. Anna {n} left, {n} stayed.") for i, n in enumerate(families)], "doc_id long, text string")
    johns, annas, names = set(), set(), set()
    for r in S.replace(df, "k").collect():
        m = re.fullmatch(r"Mr\. (\w+) (\w+) wrote to Mrs\. (\w+) (\w+)\. (\w+) (\w+) replied\. Dr\. (\w+) (\w+) left, (\w+) stayed\.", r.text)
        assert m and len({m[2], m[4], m[6], m[8], m[9]}) == 1 and len({m[3], m[5], m[7]}) == 1
        johns.add(m[1])
        annas.add(m[3])
        names.add(m[2])
    assert len(johns) == len(annas) == 1 and len(names) == len(families) and not names & set(families)
    assert johns.pop().endswith("n") and annas.pop().endswith("a")


def test_check_digits_stay_valid(spark):
    df = spark.createDataFrame([(1, "pay DE89 3704 0044 0532 0130 00 or 4539 5787 6362 1486 or 4539 5787 6362 1487")], "doc_id long, text string")
    m = re.fullmatch(r"pay (DE\d\d(?: \w{4}){4} \w\w) or ([\d ]+) or ([\d ]+)", S.replace(df, "k").collect()[0].text)
    assert iban_rest(m[1].replace(" ", "")) == 1 and luhn(m[2].replace(" ", "")[:-1]) == m[2][-1]


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a@b.de"), (1, "a@b.de"), (None, "a@b.de"), (2, None)], "doc_id long, text string")
    out = S.replace(df, "k").collect()
    assert len(out) == 4 and len({r.text for r in out}) == 2
    assert S.replace(df.limit(0), "k").collect() == []


def test_every_entity_holds_a_hint(spark):
    """Strings generated for each pattern, and drawn from characters that patterns are made of: whatever a pattern finds, the hint finds."""
    rng = random.Random(8)
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randrange(a, b + 1)))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gap = lambda letters: rng.choice(letters)
    made = {
        "email": lambda: some(lower + digits + "._%+-", 1, 6) + "@" + some(lower, 1, 4) + "." + some(lower, 2, 4),
        "iban": lambda: some(upper, 2, 2) + some(digits, 2, 2) + "".join(gap(["", " "]) + some(upper + digits, 4, 4) for _ in range(rng.randrange(2, 8))) + gap(["", " " + some(upper + digits, 1, 3)]),
        "ip": lambda: ".".join(some(digits, 1, 3) for _ in range(4)),
        "number": lambda: "".join(gap(digits) + gap(["", " ", "-"]) for _ in range(rng.randrange(12, 19))) + gap(digits),
        "ssn": lambda: f"{some(digits, 3, 3)}-{some(digits, 2, 2)}-{some(digits, 4, 4)}",
        "phone": lambda: gap(["", "+" + some(digits, 1, 3) + gap(["", " ", "."])]) + gap(["(" + some(digits, 2, 4) + ")", some(digits, 2, 4)]) + "".join(gap([" ", ".", "-"]) + some(digits, 2, 5) for _ in range(rng.randrange(2, 5))),
        "name": lambda: gap((S._TITLES_F + "|" + S._TITLES_M + "|" + S._TITLES_N).replace("\\", "").split("|")) + gap([" ", ". "]) + gap(upper + "ÉИΠ") + some(lower, 1, 5),
    }
    rows = [(k, gap(["", "to ", "("]) + f() + gap(["", " now", ",", ")"])) for k, f in made.items() for _ in range(400)]
    rows += [("drawn", some("AZ09 .-()+@:abM", 5, 24)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "kind string, s string")
    found = df.filter(F.rlike("s", F.lit(S.ANY)))
    assert found.filter(~F.rlike("s", F.lit(S.HINT))).select("kind", "s").collect() == []
    assert {r.kind for r in found.groupBy("kind").count().filter("count > 150").collect()} >= set(made)


def test_accounts_without_other_entities(spark):
    """The same account alone and beside an address gets the same surrogate, and stays in clear in neither."""
    df = spark.createDataFrame([(1, "pay to AB12CDEF3456 now"), (2, "a@b.example pays to AB12CDEF3456")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.replace(df, "key").collect()}
    account = got[1].split()[2]
    assert account != "AB12CDEF3456" and account in got[2] and "AB12CDEF3456" not in got[2]
