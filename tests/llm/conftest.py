import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    """n words, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345 + i) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + "aeiouy"[x >> 8 & 3] * (x >> 5 & 1) + str(x >> 20 & 31) * (x >> 3 & 1))
    return " ".join(out)


@pytest.fixture
def documents(spark):
    """Rows as documents, with further columns whose names clash with those that operators make."""

    def make(rows, extra=True):
        full = [(r + (None,) * 5)[:5] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "kept", "keep_id", "node", "root", "length", "class", "component_id"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, white space, other scripts."""
    long = prose(20_000, 3)
    return [
        (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "two words"), (6, long), (7, long), (7, long), (None, "no id " + prose(30, 5)), (None, "no id " + prose(30, 5)),
        (8, "Ünïcode ß ǅ İ 日本語 テキスト 😀😀 \u0000 x"), (9, "a" * 5000), (10, prose(40, 9)), (10, prose(40, 10)), (11, "<|endoftext|> x <|startoftext|>"), (12, "ONE  two\tthree\nfour five"), (13, "one two three four five"),
    ]
