"""Rule-based tags of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import batches
from gleanery.functions import text as T

#: Markers, keywords, mood words and stopwords (English, Spanish) of the tagger.
SPANISH_MARKERS = [
    "de", "el", "que", "en", "los", "las", "del", "por", "con", "una", "para", "está", "son", "como",
]
ENGLISH_MARKERS = [
    "the", "is", "and", "are", "for", "was", "with", "that", "this", "have", "from", "been", "has", "were",
]
DOMAINS = {
    "legal": [
        "artículo", "articulo", "ley", "decreto", "resolución", "resolucion", "tribunal", "sentencia", "demanda", "jurisdicción", "jurisdiccion",
        "constitución", "constitucion", "normativa", "reglamento", "ordenanza", "contract", "clause", "statute", "plaintiff", "defendant", "court",
        "legal", "law", "regulation", "compliance", "liability", "attorney", "section", "subsection", "amendment", "precedent",
    ],
    "medical": [
        "patient", "diagnosis", "treatment", "symptom", "clinical", "therapy", "hospital", "medical", "disease", "medication", "prescription", "paciente",
        "diagnóstico", "diagnostico", "tratamiento", "síntoma", "sintoma", "clínico", "clinico", "terapia", "enfermedad", "medicamento",
    ],
    "technical": [
        "function", "class", "module", "api", "database", "server", "deploy", "algorithm", "interface", "component", "repository", "endpoint", "config",
        "pipeline", "runtime", "compiler", "debug", "refactor", "test", "implementation", "dependency", "framework", "library",
    ],
    "financial": [
        "revenue", "profit", "loss", "balance", "asset", "liability", "investment", "stock", "bond", "dividend", "portfolio", "fiscal", "budget",
        "expense", "income", "tax", "audit", "accounting", "ingreso", "gasto", "presupuesto", "activo", "pasivo", "inversión", "inversion", "impuesto",
        "contable", "balance", "factura",
    ],
    "educational": [
        "student", "teacher", "curriculum", "lesson", "course", "exam", "grade", "learning", "education", "school", "university", "lecture", "alumno",
        "estudiante", "docente", "profesor", "materia", "examen", "calificación", "calificacion", "aprendizaje", "educación", "educacion",
    ],
}
POSITIVE = [
    "good", "great", "excellent", "benefit", "improve", "success", "advantage", "bueno", "excelente", "beneficio", "mejor", "éxito",
]
NEGATIVE = [
    "bad", "fail", "error", "problem", "issue", "risk", "danger", "wrong", "malo", "fallo", "error", "problema", "riesgo", "peligro",
]
ENGLISH_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "ought", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "its", "our", "their", "this", "that", "these", "those", "what", "which", "who", "whom", "and", "but", "or", "nor", "not",
    "so", "yet", "both", "either", "neither", "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "no", "only", "own",
    "same", "than", "too", "very", "just", "also", "now", "then", "here", "there", "when", "where", "why", "how", "if", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "once",
]
SPANISH_STOPWORDS = [
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "al", "y", "e", "o", "u", "en", "con", "por", "para", "sin", "sobre", "entre",
    "hasta", "desde", "hacia", "durante", "mediante", "que", "se", "su", "sus", "es", "son", "fue", "ser", "está", "están", "como", "pero", "más",
    "ya", "muy", "si", "no", "lo", "le", "les", "me", "te", "nos", "os", "mi", "tu", "este", "esta", "estos", "estas", "ese", "esa", "esos", "esas",
    "aquel", "aquella", "hay", "ha", "han", "tiene", "tienen", "todo", "toda", "todos", "todas", "otro", "otra", "otros", "otras", "mismo", "misma",
    "cada", "donde", "cuando", "quien", "cual", "cuyo",
]


def _count_in(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def language(words: Column) -> Column:
    """P-10."""
    es, en = _count_in(words, SPANISH_MARKERS), _count_in(words, ENGLISH_MARKERS)
    return F.when(es > en * 1.2, "es").when(en > es * 1.2, "en").when((es > 0) & (en == 0), "es").otherwise("en")


def domain(words: Column) -> Column:
    """P-11: most keyword hits, the first of equal ones; at least two."""
    hits = {d: _count_in(words, list(dict.fromkeys(k))) for d, k in DOMAINS.items()}
    most = F.greatest(*hits.values())
    out = F.lit("general")
    for d in reversed(DOMAINS):
        out = F.when((hits[d] == most) & (most >= 2), d).otherwise(out)
    return out


def complexity(words: Column, sentences: Column) -> Column:
    """P-13."""
    score = F.try_divide(F.size(words), F.size(sentences)) / 20 + F.try_divide(F.size(F.array_distinct(words)), F.size(words)) * 2
    return F.when(score > 2.0, "high").when(score > 1.2, "medium").otherwise("low")


def reading_level(words: Column) -> Column:
    """P-14."""
    n = F.size(words)
    mean = F.try_divide(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), n)
    long = F.try_divide(F.size(F.filter(words, lambda w: F.length(w) > 8)), n)
    return F.when((mean > 6.5) | (long > 0.25), "advanced").when((mean > 5.0) | (long > 0.12), "intermediate").otherwise("basic")


def sentiment(text: Column) -> Column:
    """P-15: how many of the mood words occur; a word listed twice counts twice."""
    low = F.lower(text)
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.when(p > n + 1, "positive").when(n > p + 1, "negative").otherwise("neutral")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def tags(docs: DataFrame) -> DataFrame:
    """P-9: (id, content) with all tags; a null content counts as empty."""
    d = docs.select("id", F.coalesce("content", F.lit("")).alias("content"))
    d = d.select("id", "content", T.tagger_words(F.col("content")).alias("w"), sentences(F.col("content")).alias("s"))
    lexicon = sorted({x for k in (SPANISH_MARKERS, ENGLISH_MARKERS, *DOMAINS.values()) for x in k})
    d = d.withColumn("known", F.filter("w", lambda x: x.isin(lexicon)))  # one pass over all words; the lexicons look at these few
    w, s, c, known = F.col("w"), F.col("s"), F.col("content"), F.col("known")
    return d.select("id", language(known).alias("language"), domain(known).alias("domain"), complexity(w, s).alias("complexity"), reading_level(w).alias("reading_level"), sentiment(c).alias("sentiment"), F.size(w).cast("long").alias("word_count"))


def topics(docs: DataFrame, stopwords: list[str] = ENGLISH_STOPWORDS + SPANISH_STOPWORDS, limit: int = 5) -> DataFrame:
    """P-12: (id, content) -> id, term, n, rank; ties by first place. Words are counted where the text is read: a row of ``docs`` is a text, and nothing is shuffled."""
    words = F.filter(T.tagger_words(F.col("content")), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            # most_common keeps the order of first places among equal counts
            rows = [(i, term, n, rank) for i, w in zip(pdf["id"], pdf["w"], strict=True) for rank, (term, n) in enumerate(Counter(w).most_common(), 1) if rank <= limit]
            yield pd.DataFrame(rows, columns=["id", "term", "n", "rank"])

    kind = docs.schema["id"].dataType.simpleString()
    return batches.small(docs.select("id", words.alias("w"))).mapInPandas(run, f"id {kind}, term string, n long, rank int")


#: Prior of each kind of chunk, and its default signals.
KIND_PRIOR = {"code": 1.0, "test": 0.95, "spec": 0.9, "memory": 0.85, "doc": 0.78, "chat": 0.42, "log": 0.2}


def kind_prior(kind: Column) -> Column:
    out = F.lit(0.0)
    for k, v in KIND_PRIOR.items():
        out = F.when(kind == k, v).otherwise(out)
    return out
