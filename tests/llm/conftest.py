"""Small corpora: the smallest documents table, and rows with every odd case."""

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, gram string, size int, _part int"


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(400)]
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(40):
        kind, words = i % 8, [word() for _ in range(rng.randint(1, 120))]
        if kind == 0:
            words = list(base)
        elif kind == 1:
            words = list(base)
            words[rng.randrange(400)] = word()
        elif kind == 2:
            words = [*words, passage, *[word() for _ in range(9)]]
        elif kind == 3:
            words = ["la"] * rng.randint(1, 150)
        elif kind == 4:
            words = ["Énorme", "Ü", "ß", "日本", *words]
        rows.append((100 - i, " ".join(words) if kind != 6 else "\n\t" + "  ".join(words) + "\x0b", ["en", "fr", None][i % 3], ["src1", "src0", None, "ä"][i % 4]))
    long = " ".join(word() for _ in range(30000))
    rows += [(500, long, "en", "src1"), (501, long[:60000] + " x " + long[60000:], "en", "src1")]
    rows += [(600, None, "en", "src1"), (601, "", None, None), (602, " \t\n", "fr", None), (603, "12 34 !!", "en", "src0"), (604, "ab", "en", "src0"), (605, "a b", "en", "src0"), (606, "a  b ", "fr", "src0"), (607, "x" * 900, "en", "src0")]
    rows += [(None, "no id here at all " + passage, "en", "src0"), (None, None, None, None), (700, passage, "en", "src0"), (700, passage, "en", "src0"), (700, passage, "en", "src0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", 2, 3) for i, t, lang, s in odd_rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["odd", "small", "none"])
def docs(request):
    return request.getfixturevalue(request.param)
