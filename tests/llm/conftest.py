import random

import pytest

WORDS = {
    "en": "the of and to a in is that it for on was with as by at from this house garden river letter winter morning".split(),
    "de": "der die und das den zu ist ein nicht mit auf von haus garten fluss brief winterzeit morgen schnell schoen".split(),
    "fr": "de la le et les des un est que en qui dans maison jardin fleuve lettre hiver matin toujours beaucoup".split(),
    "es": "de la que el en y los un con no por las casa huerto ciudad carta invierno manana siempre mucho".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in each column, empty, blank, very long and odd texts, ties and repeated rows."""
    rng = random.Random(4)
    rows = [
        (0, None, "en", "s"),
        (1, "", None, None),
        (2, " \t\n\x0b\x0c\r ", "en", "s"),
        (3, "word", "en", "s"),
        (4, "one two three four", "de", "s"),
        (5, prose(rng, "en", 400), "en", "s"),
        (5, prose(rng, "en", 400), "en", "s"),
        (6, "x" * 300_000, "en", "s"),
        (7, prose(rng, "fr", 60_000), "fr", "s"),
        (8, "a@b.co, +1 (555) 123-4567; 10.0.0.256, 10.0.0.1, 4111 1111 1111 1111", "en", "s"),
        (9, "漢字 😀 ́ ﬁ İ ΣΑΣ <|endoftext|> <|startoftext|>", "xx", "s"),
        (10, "\n\n\n", "en", "s"),
        (11, "12345 !!!", "en", "s"),
        (None, prose(rng, "es", 80), "es", "s"),
        (None, None, None, None),
    ]
    rows.append(rows[5])
    rows += [(100 + k, prose(rng, lang, rng.randrange(3, 300)), lang, "s") for k, lang in enumerate(list(WORDS) * 30)]
    return rows


KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, pid int, `group` int, node int, id int"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names operators might use themselves."""
    rows = [(*r, None if r[1] is None else len(r[1]), "score", 1, 2, 3, 4) for r in edge_rows]
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
