import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, score double, slot int, copy int, h long, fp long, version long, label string"
LANGS = {"en": "the of and that with from have this will your".split(), "de": "der die das und nicht mit auf sich ein über".split(), "fr": "le la les des que dans pour une avec être".split()}


def words(rnd, lang, n):
    return " ".join(rnd.choice(LANGS[lang]) if rnd.random() < 0.4 else "".join(rnd.choice(LANGS[lang]) for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with everything that an operator must bear: nulls, empty and very long texts, copies, ties, repeated rows."""
    rnd = random.Random(5)
    out = []
    for i in range(60):
        lang = rnd.choice(list(LANGS))
        out.append((i, words(rnd, lang, rnd.randint(1, 120)), lang, rnd.choice(["a", "b", None])))
    out += [
        (100, None, "en", "a"), (101, "", "en", "a"), (102, " \t\n", None, None), (103, "12 34 !!", "de", "b"), (104, out[3][1], "en", "a"), (105, "  " + out[3][1].replace(" ", " \n "), "en", "a"),
        (None, out[4][1], "en", "a"), (None, None, None, None), (106, words(rnd, "en", 30_000), "en", "a"), (107, "x" * 200_000, None, "b"), out[5], out[5], out[6],
        (108, "Кириллица и 漢字", None, "b"), (109, "A\u0085B \x1f C", "en", "b"),
    ]
    return out


def frame(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), "n", 1.0, 1, 1, 1, 1, 1, "l") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
