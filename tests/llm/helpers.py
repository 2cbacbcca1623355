"""Small hostile tables for the operators of the llm subpackage."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, mix_order string, fp string"


def docs(spark, rows, schema=DOC_SCHEMA):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with internal ones."""
    import tempfile

    full = [(i, t, lang, src, len(t) if t is not None else None, 7, "x", None) for i, t, lang, src in rows]
    path = tempfile.mkdtemp(prefix="riskops-docs-") + "/docs"  # a table, as a list of rows would be folded into the plan
    spark.createDataFrame(full, schema).write.parquet(path)
    return spark.read.parquet(path)


def words(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(n))


def hostile(extra=()):
    base = words(60, 1)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "de", ""),
        (5, " \n\t ", "en", "a"), (None, "no id here", "en", "b"), (None, None, None, "b"), (6, words(9000, 2), "fr", "a"),
        (7, "one two three", "en", "a"), (8, base + " tail", "en", "c"), (9, "ünï \U0001f600 çödé " * 3, "es", "c"),
        *extra,
    ]
