import random

import pytest

WORDS = "the and of in to that it is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with operators' own names."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 12) for _ in range(1500))
    rows = [(1, prose(rng, 40), "en", "b"), (2, None, None, None), (3, "", "en", "a"), (None, prose(rng, 30), "fr", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (5, " \t\n ", "de", None), (6, "x" * 50_000, None, "c"), (7, "é中😀 " * 30, "fr", "a"), (8, prose(rng, 40), "en", "a"), (9, "12 34 !!", "en", "a")]
    clash = "score double, size long, target double, taken long, id string, key long, root long, n_words long, labels string, passes int, extra int, held_out boolean, fp long, label string, host string, closeness double, predicted string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + clash
    return spark.createDataFrame([(*r, len(r[1] or "")) + (None,) * clash.count(",") + (None,) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
