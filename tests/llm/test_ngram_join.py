import random
import re

import numpy as np
import pytest

from pathloom.llm.components import components
from pathloom.llm.ngram_join import _counted, _recounted, ngram_join

from .conftest import prose


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows):
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Groups of copies with edits near the threshold, passages that many share, short texts, exact copies."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    rows = []
    for g in range(14):
        base = (prose(rng, rng.choice([4, 30, 60])) + (" " + passage if g % 3 else "")).split()
        for _ in range(rng.choice([1, 4, 18])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(9))
            rows.append((len(rows) + 100, " ".join(own)))
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_one_large_group_and_a_passage(spark):
    """300 near copies of one text, those that share its frequent shingles just below the threshold, and a passage that strangers share."""
    rng = random.Random(5)
    base, passage = prose(rng, 90).split(), prose(rng, 80)
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, f"{prose(rng, rng.choice([5, 20, 26, 27, 60]))} {passage}") for i in range(120)]
    assert got(spark, rows) == brute(rows)


def test_counts_of_shingle_prefixes():
    low = np.unique(np.random.default_rng(1).integers(0, 1 << 22, 5000)).astype(np.uint32)
    for df in (np.ones(len(low), np.int64), np.arange(len(low)) % 5 + 1):
        back = _recounted(_counted(low, df))
        assert (back[0] == low).all() and (back[1] == df).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(odd_docs).collect()), key=str)
    assert out == brute(rows)
    assert ngram_join(no_docs).count() == 0


def test_chains_and_thresholds(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60])) for i in range(20)]  # neighbours link, ends don't
    assert got(spark, rows) == brute(rows)
    assert {c for *_, c in got(spark, rows)} == {0}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {(r.root) for r in components(edges, "a", "b").collect()} == {0, 99}
    assert components(edges.limit(0), "a", "b").count() == 0
