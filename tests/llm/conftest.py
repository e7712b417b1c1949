import random

import pytest

#: Columns that operators might use inside.
CLASHING = "row y _id _digest _n _words _text _size _taken _quality _scored queue turn hash start host line key vector part place kept fp node".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, digest int, n string, score string, size string, words string, label string"
SCHEMA += "".join(f", {c} string" for c in CLASHING)


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and very long texts, copies, near copies, repeated rows, and columns of clashing names."""
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "one", "One two", "  lead  and\ttabs\r\n", "a\x0bb\x0cc", "é É 日本 　  x", "<|endoftext|> in <|startoftext|>", "###!!! $$$"]
    base = [" ".join(word(rng) for _ in range(rng.randint(5, 300))) for _ in range(40)]
    texts += base + base[:5] * 3
    for b in base[:10]:  # near copies
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append(" ".join(word(rng) for _ in range(60_000)))  # very long
    texts.append("same " * 30_000)
    texts += ["Shared line of the site here.\n" + " ".join(word(rng) for _ in range(60)) for _ in range(30)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "", None]), None, "x", 1, "y", "z", "w", "v", "u", *CLASHING))
    return rows + rows[5:9]  # repeated rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *cols):
    """Rows as sorted tuples of text, so that nulls and repeats compare."""
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
