"""PII surrogates with DataFrame functions only.

Entities are replaced by keyed surrogates of the same kind and format. A surrogate depends on the key
and the entity's canonical form (for first names, also on the gender that its titles in all documents show), so
that mentions of one entity agree in all documents. Candidates are checked against each other and against all
entities found; where two meet, one keeps it and the other goes on to its next candidate, until each has one of its own.
A name that follows a title anywhere in a document is also replaced where it stands there without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import tables

#: After so many candidates of its own length, a name or an address gets longer ones.
ATTEMPTS = 4
#: Rounds without any free candidate after which a format of fixed length counts as full.
STALLED = 16
#: Colliding entities (about 100 bytes each) that are broadcast at most; beyond that, rows are joined by document.
BROADCAST_ENTITIES = 100_000
_TITLES_F = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Señorita|Sra|Doña|Sig\\.ra|Signora|Г-жа|г-жа|Госпожа|госпожа|Κυρία|κυρία"
_TITLES_M = "Mr|Sir|Monsieur|Herr|Señor|Sr|Don|Signor|Г-н|г-н|Господин|господин|Κύριος|κύριος"
_TITLES_N = "Dr|Prof"
_TITLE = f"(?:{_TITLES_F}|{_TITLES_M}|{_TITLES_N})\\.?"
_NAME = "\\p{Lu}[\\p{Ll}]+(?:[-'’]\\p{Lu}\\p{Ll}+)?"

#: kind, pattern; earlier ones win at the same place. Names follow a title, which stays.
KINDS = [
    ("email", "(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"),
    ("iban", "\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b"),
    ("ip", "(?<![\\d.])(?:\\d{1,3}\\.){3}\\d{1,3}(?![\\d]|\\.\\d)"),
    ("number", "(?<![\\d])(?:\\d[ -]?){12,18}\\d(?!\\d)"),
    ("ssn", "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"),
    ("phone", "(?<![\\w+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)|\\d{2,4})(?:[ .-]\\d{2,5}){2,4}(?![\\w-])"),
    ("name", f"(?=\\p{{Lu}})(?<=(?<![\\p{{L}}])(?:{_TITLES_F}|{_TITLES_M}|{_TITLES_N})\\.? ){_NAME}(?: {_NAME})?"),
]
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
NAME = KINDS[-1][1]
#: Every entity holds one of these; the test spares most texts the long pattern. The first characters are looked at alone, first.
HINT = f"(?=[@\\dMFSDHPГгΚκ])(?:@|\\d{{1,3}}\\.\\d{{1,3}}\\.|\\d[\\d -]{{6}}|\\d{{2}}[ .)-]\\d|(?<=[A-Z]{{2}})\\d{{2}} ?[A-Z0-9]{{4}}|(?:{_TITLE}) \\p{{Lu}})"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Letters of each script: vowels, consonants, endings of women's and of men's first names, of other names.
SCRIPTS = {
    "latin": ("aeiou", "bdfgklmnprstv", "a", "n", "er"),
    "cyrillic": ("аеиоу", "бвгдклмнпрст", "а", "н", "ко"),
    "greek": ("αειου", "βγδκλμνπρστ", "α", "ς", "ης"),
}


def kind_of(e: Column) -> Column:
    c = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        c = F.when(F.rlike(e, F.lit(f"^(?:{pattern})$")), kind).otherwise(c)
    return c


def canonical(e: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: numbers without their grouping, addresses in lower case."""
    return F.when(kind.isin("email"), F.lower(e)).when(kind.isin("iban", "number", "ssn", "phone"), F.regexp_replace(e, "[ .()-]", "")).otherwise(e)


def _hex(key: str, *parts: Column) -> Column:
    """128 hex digits that depend on the key and all parts."""
    text = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(F.concat(F.lit("0"), text).cast("binary"), 256), F.sha2(F.concat(F.lit("1"), text).cast("binary"), 256))


def _pick(h: Column, i: Column, letters: str) -> Column:
    """The i-th letter of a keyed stream over ``letters``."""
    v = F.conv(F.substr(h, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
    return F.substr(F.lit(letters), (v + F.floor(i / 63).cast("int") * 7) % len(letters) + 1, F.lit(1))


def _same_shape(text: Column, h: Column) -> Column:
    """Digits for digits, lower for lower, upper for upper case letters; all else stays."""

    def one(i: Column) -> Column:
        c = F.substr(text, i + 1, F.lit(1))
        out = c
        for letters in (_LOWER, _UPPER, _DIGITS):
            out = F.when(F.contains(F.lit(letters), c), _pick(h, i, letters)).otherwise(out)
        return out

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")


def _word(h: Column, word: Column, ending: int, longer: Column) -> Column:
    """An invented name of the same script and about the same length (and ``longer`` letters more), capitalised."""

    def build(vowels: str, consonants: str, end: str) -> Column:
        n = F.greatest(F.lit(2), F.length(word) - len(end)) + longer
        body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, _pick(h, i, consonants)).otherwise(_pick(h, i, vowels))), "")
        return F.initcap(F.concat(body, F.when(F.rlike(body, F.lit(f"[{vowels}]$")) & F.lit(end[0] in vowels), F.lit(consonants[0])).otherwise(""), F.lit(end)))

    out = build(*SCRIPTS["latin"][:2], SCRIPTS["latin"][ending])
    for script, pattern in (("cyrillic", "^\\p{IsCyrillic}"), ("greek", "^\\p{IsGreek}")):
        v, c, *ends = SCRIPTS[script]
        out = F.when(F.rlike(word, F.lit(pattern)), build(v, c, ends[ending - 2])).otherwise(out)
    return out


def _digit(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1)).cast("int")


def luhn_digit(body: Column) -> Column:
    """The check digit that follows the digits of ``body``."""
    n = F.length(body)
    twice = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    add = lambda acc, i: acc + F.when(i % 2 == 1, twice(_digit(body, n - i + 1))).otherwise(_digit(body, n - i + 1))
    return (F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))).cast("string")


def mod97(text: Column) -> Column:
    """The number of an account without spaces, its first four characters last and letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(F.rlike(c, F.lit("[0-9]")), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _checked_number(canon: Column, new: Column) -> Column:
    """``new`` with a valid check digit, if ``canon`` has one."""
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    return F.when(luhn_digit(body(canon)) == F.substr(canon, F.length(canon), F.lit(1)), F.concat(body(new), luhn_digit(body(new)))).otherwise(new)


def _checked_iban(canon: Column, new: Column) -> Column:
    country, rest = F.substr(new, F.lit(1), F.lit(2)), F.substr(new, F.lit(5))
    check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(mod97(canon) == 1, F.concat(country, check, rest)).otherwise(new)


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a canonical form.

    Addresses keep the last label of their domain; ip parts stay below 256; the first digit of a number
    stays, and numbers and accounts with valid check digits get valid ones. The name of a person is replaced word by word, so that
    a family name alone agrees with the full name; kinds of names (given-f, given-m, given-n, family) set the ending. From attempt
    ``ATTEMPTS`` on, names and addresses grow by two letters each. Attempt -1 is a bracketed mask.
    """
    h = _hex(key, kind, canon, attempt)
    mask = F.concat(F.lit("["), kind, F.lit("-"), F.substr(h, F.lit(1), F.lit(20)), F.lit("]"))
    longer = 2 * F.greatest(F.lit(0), attempt - (ATTEMPTS - 1))
    more = F.when(longer > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(longer, F.lit(1)) - 1), lambda i: _pick(h, 62 - i % 60, _LOWER)), "")).otherwise("")
    host = F.regexp_extract(canon, "\\.([^.]*)$", 1)
    body = F.regexp_replace(canon, "\\.[^.]*$", "")
    octet = lambda k: (F.conv(F.substr(h, F.lit(4 * k + 1), F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")
    number = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _same_shape(F.substr(canon, F.lit(2)), h))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _same_shape(F.substr(canon, F.lit(3)), h))
    return (
        F.when(attempt < 0, mask)
        .when(kind == "email", F.concat(more, _same_shape(body, h), F.lit("."), host))
        .when(kind == "ip", F.concat_ws(".", *[octet(k) for k in range(4)]))
        .when(kind == "iban", _checked_iban(canon, iban))
        .when(kind == "number", _checked_number(canon, number))
        .when(kind == "phone", number)
        .when(kind == "ssn", _same_shape(canon, h))
        .when(kind == "given-f", _word(h, canon, 2, longer))
        .when(kind == "given-m", _word(h, canon, 3, longer))
        .otherwise(_word(h, canon, 4, longer))
    )


def laid_out(form: Column, digits: Column) -> Column:
    """Letters and digits of ``digits`` in the grouping of ``form``."""
    place = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[ .()-]", ""))
    one = lambda i: F.when(F.rlike(F.substr(form, i, F.lit(1)), F.lit("[ .()-]")), F.substr(form, i, F.lit(1))).otherwise(F.substr(digits, place(i), F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _named(names: Column) -> Column:
    """``ANY``, and the names of a document and their words where no title precedes, longest first."""
    words = F.array_distinct(F.concat(names, F.flatten(F.transform(names, lambda n: F.split(n, " ")))))
    words = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}])(?:"), F.array_join(words, "|"), F.lit(")(?![\\p{L}])"))).otherwise(F.lit(ANY))


def _units(e: Column, kind: Column, before: Column, given: Column) -> Column:
    """What is replaced as one: the entity, or each word of a name. ``sex`` counts titles of women less those of men before a first name.

    A word alone is a first name if a full name of the document (``given`` has their first words) shows it as one.
    """
    female, male = (F.rlike(before, F.lit(f"(?:{t})\\.? $")) for t in (_TITLES_F, _TITLES_M))
    sex = F.when(female, 1).when(male, -1).otherwise(0)
    unit = lambda k, c, s=F.lit(0): F.struct(k.alias("kind"), c.alias("canon"), s.alias("sex"))
    first, last = F.split_part(e, F.lit(" "), F.lit(1)), F.split_part(e, F.lit(" "), F.lit(-1))
    words = F.when(F.contains(e, F.lit(" ")), F.array(unit(F.lit("given"), first, sex), unit(F.lit("family"), last)))
    words = words.otherwise(F.array(unit(F.when(F.array_contains(given, last), "given").otherwise("family"), last, sex)))
    return F.when(kind == "name", words).otherwise(F.array(unit(kind, canonical(e, kind))))


def _group(kind: Column) -> Column:
    return F.when(kind.startswith("given") | (kind == "family"), "name").otherwise(kind)


def contested(units: DataFrame, key: str) -> DataFrame:
    """Distinct ``units`` (kind, canon) whose first candidate isn't theirs, with the attempt that is.

    In each round, every unit left has one candidate. It is free if no text holds it and no unit has it from an
    earlier round; of the units that meet in a free one, the one with the least hash takes it. The others go on; from
    attempt ``ATTEMPTS`` on, surrogates of names and addresses grow, so that there is room for all. Only where a format of
    fixed length gave nobody anything for ``STALLED`` rounds, the units left are masked (attempt -1).
    """
    real = units.select(_group(F.col("kind")).alias("g"), F.col("canon").alias("s"))
    left, taken, odd, k, still = units.select("kind", "canon"), None, None, 0, 0
    n = left.count()
    while n and still < STALLED:
        cand = left.select("kind", "canon", _group(F.col("kind")).alias("g"), surrogate(F.col("kind"), F.col("canon"), key, F.lit(k)).alias("s"))
        who = F.struct(F.xxhash64(F.lit(key), "kind", "canon").alias("x"), "kind", "canon")
        won = cand.groupBy("g", "s").agg(F.min(who).alias("w")).join(real, ["g", "s"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["g", "s"], "left_anti")
        won = tables.table(won.select("g", "s", "w.kind", "w.canon"))
        taken = won.select("g", "s") if taken is None else taken.union(won.select("g", "s"))
        if k:
            some = won.select("kind", "canon", F.lit(k).alias("attempt"))
            odd = some if odd is None else odd.union(some)
        left = tables.table(left.join(won, ["kind", "canon"], "left_anti"))
        before, n = n, left.count()
        k, still = k + 1, still + 1 if n == before else 0
    masked = left.select("kind", "canon", F.lit(-1).alias("attempt"))
    return masked if odd is None else odd.union(masked)


def replace(docs: DataFrame, key: str, broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """``docs`` (doc_id, text, and others that are not read) -> doc_id, text with surrogates, n_entities long, kinds.

    ``kinds`` lists the kinds of the entities in their order, comma-joined. Null texts stay null; texts without
    entities are unchanged and have none; texts of any length are searched whole; repeated rows are treated alike; an empty table gives no
    rows. Where a format of fixed length has no surrogate left, a mask takes its place. The same ``key`` gives the same surrogates for
    the same entities; keep it secret, as it lets others try which entity a surrogate stands for.
    """
    docs = docs.select("doc_id", "text")
    hint = F.coalesce(F.rlike("text", F.lit(HINT)), F.lit(False))
    d = docs.filter(hint).select("doc_id", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("names"))
    d = d.select("doc_id", "text", F.transform(F.filter("names", lambda n: F.contains(n, F.lit(" "))), lambda n: F.split_part(n, F.lit(" "), F.lit(1))).alias("given"), _named(F.col("names")).alias("any"))
    d = d.select("doc_id", "text", "given", F.regexp_extract_all("text", F.col("any"), F.lit(0)).alias("ents"), F.split("text", F.col("any"), -1).alias("gaps"))
    pair = F.arrays_zip(F.col("ents").alias("e"), F.slice("gaps", 1, F.size("ents")).alias("before"))
    d = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "given", "gaps", F.when(F.size("ents") > 0, F.transform(pair, lambda p: F.struct(p["e"].alias("e"), kind_of(p["e"]).alias("kind"), p["before"].alias("before")))).alias("parts"))
    d = tables.table(d.select("rid", "doc_id", "text", "gaps", F.coalesce(F.transform("parts", lambda p: F.struct(p["e"].alias("e"), p["kind"].alias("kind"), _units(p["e"], p["kind"], p["before"], F.col("given")).alias("units"))), F.array()).alias("parts")))
    one = d.select("rid", F.posexplode("parts").alias("i", "p")).select("rid", "i", F.col("p.e").alias("e"), F.posexplode("p.units").alias("j", "u")).select("rid", "i", "e", "j", "u.kind", "u.canon", "u.sex")
    sex = one.groupBy("kind", "canon").agg(F.sum("sex").alias("sex"))
    known = tables.table(sex.select("canon", F.col("kind").alias("of"), F.when(F.col("kind") != "given", F.col("kind")).when(F.col("sex") > 0, "given-f").when(F.col("sex") < 0, "given-m").otherwise("given-n").alias("kind")))
    odd = tables.table(contested(known.select("kind", "canon"), key))
    sides = known.join(odd, ["kind", "canon"], "left").select(F.col("of").alias("kind"), "canon", F.col("kind").alias("as"), F.coalesce("attempt", F.lit(0)).alias("attempt")).filter("kind = 'given' OR attempt <> 0")
    one = one.drop("sex").join(tables.bounded(sides, broadcast_entities), ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))).withColumn("kind", F.coalesce("as", "kind"))
    s = surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt"))
    grouped = F.col("kind").isin("iban", "number", "ssn", "phone") & (F.col("attempt") >= 0)
    one = one.select("rid", "i", "j", F.when(grouped, laid_out(F.col("e"), F.regexp_replace(s, "[ .()-]", ""))).otherwise(s).alias("s"))
    new = one.groupBy("rid", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]), " ").alias("s"))
    new = new.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("reps"))
    out = d.join(new, "rid", "left")
    body = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("reps")), "reps", lambda g, r: F.concat(g, r)), ""), F.element_at("gaps", -1))
    out = out.select("doc_id", F.coalesce(F.when(F.col("reps").isNotNull(), body), "text").alias("text"), F.size("parts").cast("long").alias("n_entities"), F.array_join(F.transform("parts", lambda p: p["kind"]), ",").alias("kinds"))
    rest = docs.filter(~hint).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return out.union(rest)
