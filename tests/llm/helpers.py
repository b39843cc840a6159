"""Small tables with everything odd in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOCS + ", kept boolean, component_id string, n_words string, host string, drop string, `a.b` int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(rng, lines=4, per=15, vocabulary=400):
    return "\n".join(" ".join(words(rng, per, vocabulary)) for _ in range(lines))


def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(3)
    texts = [
        None, "", " \t\n", "one", "it's <|endoftext|>   x", "İΣ é ​ \U0001f600", prose(rng), prose(rng), prose(rng), " ".join(words(rng, 30_000)),
        "same text here", "same text here", "x" * 50_000
    ]
    rows = [
        (
            i, t, random.Random(i).choice(["en", "de", None]), ["s0", "s1", None][i % 3], None if t is None else len(t), None, "c", None, "h", "d", i
        ) for i, t in enumerate(texts)
    ]
    rows += [
        (None, "no id at all", None, None, None, True, None, "n", None, None, 1), rows[6], rows[6],
        (6, "same id, other text", "en", "s0", 5, None, None, None, None, None, None)
    ]
    return spark.createDataFrame(rows, ODD)


def empty_docs(spark):
    return spark.createDataFrame([], ODD)
