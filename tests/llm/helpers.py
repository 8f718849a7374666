"""Small tables shared by the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "mo", "ri", "tu", "sel", "ven", "do", "pa", "ne", "lu") for b in ("ra", "to", "nim", "s", "la", "ke", "vo", "")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(5, 14)
        out += [r.choice(WORDS).capitalize(), *(r.choice(WORDS) for _ in range(k - 2)), r.choice(WORDS) + "."]
    return " ".join(out[:n])


def documents(spark, texts, sources=None, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "xx", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with columns of the operators' own names and of other case."""
    from pyspark.sql import functions as F

    extra = ("size", "taken", "row", "found", "kept", "rank", "target", "Text", "body", "_row", "component", "h", "id")
    return df.select("*", *[F.lit(7).alias(c) for c in extra])
