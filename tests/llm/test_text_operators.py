import re

import numpy as np
import pytest

from pathloom.llm import language, licenses, quality, toxicity
from pathloom.llm.pieces import MARK, Encoder, Vocabulary, decode, encode


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# licenses ------------------------------------------------------------------------------------------------------------


def plain_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    places = sorted(i for x in at.values() for i in x)
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, v in at.items() if v))


def test_license_base_and_templates(spark, odd_docs, no_docs):
    texts = [
        "Released under the MIT License.", "MIT license, mit LICENSE; Apache-License", "licensed under the terms of the MIT license", "Licensed under the Apache License, Version 2.0.",
        "Licensed under the GNU General Public License, version 3.", "General Public Licenses", "Licensed under CC BY-NC 4.0.", "licensed under a big apache license", "Licencé under the MIT\u00a0License", "mit", "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of one two three four software and associated documentation files",
    ]
    out = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_phrases(t), t
    assert [out[i].labels for i in (0, 2, 3, 4, 6, 7, 11, 12)] == ["mit", "mit", "apache", "gpl", "cc-by", "apache", "mit-grant", ""]
    assert [out[i].score for i in (0, 7, 9)] == [1.0, 0.5, 0.0]
    assert [(s.first, s.end) for s in out[0].spans] == [(0, 5)]
    odd = licenses.license_scan(odd_docs).collect()
    assert len(odd) == 11 and all(r.n_words == 0 for r in odd if r.doc_id in (2, 3, 5))
    assert licenses.license_scan(no_docs).count() == 0


def test_automaton_against_regular_expression():
    a = licenses.Automaton('a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>>d <<var;match="[0-9]+";max=2>> e')
    rx = re.compile(r"a( b( c)?)? d( [0-9]+){1,2} e")
    import itertools

    for n in range(1, 7):
        for words in itertools.product(["a", "b", "c", "d", "1", "e"], repeat=n):
            m = rx.match(" ".join(words))
            assert a.accepts(list(words), 0) == (len(m[0].split()) if m else -1)


# quality -----------------------------------------------------------------------------------------------------------------


def repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_quality(spark, odd_docs, no_docs):
    block = "one two three four five six seven eight nine ten. "
    texts = ["a b c. " * 10, block + "more words in between here. " + block, "x\nx\n\n \nx y\n", block * 3, "# % & a | b < c > $ *", ("Clean words stand here in a line of prose.\n") * 1 + "Another line of good prose is here as well, with words enough to pass.\n" + "| a | b | c | d |\n", None, "| a " * 30]
    out = by_id(quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), repeats(w)), i
        assert r.base_failed == (len(w) < 20 or 100 * repeats(w) > 30 * len(w))
    assert out[5].kept and "|" not in out[5].clean_text
    assert not out[7].kept and not out[3].kept
    import random

    rng = random.Random(6)  # a long clean text in one line: few of its words are distinct
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(40_000)) + " with a privacy policy."
    spam = "buy these five words now " * 400
    out = by_id(quality.quality_rules(spark.createDataFrame([(0, prose), (1, spam), (2, "Our privacy policy has changed, click here.\n" * 9)], "doc_id long, text string")))
    assert out[0].kept and out[0].clean_text == prose and not out[1].clean_text and not out[2].clean_text
    assert len(quality.quality_rules(odd_docs).collect()) == 11
    assert quality.quality_rules(no_docs).count() == 0
    plan = quality.quality_rules(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


# language ----------------------------------------------------------------------------------------------------------------


def test_language_against_plain_counting(spark):
    from collections import Counter

    text = "Der Hund, und die Katze: 3 Hunde"
    own = Counter()
    s = " " + re.sub(r"\s+", " ", re.sub(r"[\W\d_]", " ", text.lower())).strip() + " "
    for n in (1, 2, 3):
        own.update(s[i : i + n] for i in range(len(s) - n + 1) if s[i : i + n] != " " and not (n == 3 and s[i + 1] == " "))
    keys, n = language.grams(text)
    assert sorted(n.tolist()) == sorted(own.values()) and len(keys) == len(own)


def test_language_on_held_out_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.selectExpr("avg(if(lang = lang_pred, 1.0, 0.0))").first()[0] > 0.97
    odd = language.language_id(odd_docs).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 5, 9)} == {"und"}
    assert language.language_id(no_docs).count() == 0


# toxicity ----------------------------------------------------------------------------------------------------------------


def test_kernel_and_landmarks():
    rng = np.random.default_rng(0)
    k = toxicity.kernel(["idiot", "iidiot", "house", "idot"], ["idiot", "house"])
    assert k[0, 0] > k[1, 0] > k[3, 0] > k[2, 0] and k[2, 1] > k[0, 1]
    table = rng.normal(size=toxicity.TABLE).astype(np.float32)
    rows, keys, values = toxicity.features(["clown", "a", "moron"])
    want = np.bincount(rows, table[keys] * values, 3)
    assert np.allclose(toxicity.score_words(["clown", "a", "moron"], table, 0.0), want, atol=1e-5)
    assert toxicity.tokens("you i d i o t now") == ["you", "idiot", "now"]


def test_toxicity_on_held_out_documents(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    tox = out[out.toxic == 1]
    assert (tox.predicted == 1).mean() > 0.8 and (out[out.toxic == 0].predicted == 1).mean() < 0.03
    odd = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len(odd) == 11 and all(r.score == 0 for r in odd)
    assert len(toxicity.toxicity(odd_docs, labels.selectExpr("doc_id", "cast(null as int) toxic", "1 as score")).collect()) == 11
    assert toxicity.toxicity(no_docs, labels).count() == 0


def random_table(rng):
    """Random weights of all subsequences that are whole."""
    table = rng.normal(size=toxicity.TABLE).astype(np.float32)
    digits = np.arange(toxicity.TABLE)
    four = digits < toxicity.LETTERS**4
    rest = np.where(four, digits, digits - toxicity.LETTERS**4)
    table[(rest % 32 == 0) | (rest // 32 % 32 == 0) | (rest // 1024 % 32 == 0) | four & (rest // 32768 == 0)] = 0
    return table


def test_scores_do_not_depend_on_the_batch():
    import random

    from .conftest import prose

    rng, draw = random.Random(3), np.random.default_rng(3)
    scorer = toxicity.Scorer(random_table(draw), -0.5, (1.0, -1.0))
    texts = [prose(rng, rng.choice([1, 5, 300])) + rng.choice(["", " i d i o t", "\n", " a b", "\U0001f600"]) for _ in range(60)] + [None, "", " ", "x", prose(rng, 9000)]
    alone = np.array([scorer([t])[0] for t in texts])
    assert np.allclose(scorer(texts), alone, atol=1e-6) and (alone[60:63] == 0).all()
    assert toxicity.sentences(["You i d i o t now. A b", "b c d"]) == [" you idiot now " + toxicity.STOP + " a b ", " bcd "]


def test_windows_are_the_kernel_and_cross_blanks():
    rng = np.random.default_rng(1)
    table = random_table(rng)
    own = toxicity.sentences(["You are an id iot. Yes, so it is!"])[0]
    v, width = toxicity.window_scores(toxicity.letters(own), table, 0.0)
    texts = [own[i : i + w] for i, w in enumerate(width) if i + w <= len(own)]
    rows, keys, values = toxicity.features(texts, "")
    assert np.allclose(np.bincount(rows, table[keys] * values, len(texts)), v[: len(texts)], atol=1e-5)
    k = toxicity.kernel([" id iot ", " as much "], [" idiot "], "")
    assert k[0, 0] > 4 * k[1, 0]


def test_toxicity_of_insults_broken_by_a_blank(spark):
    import random

    from pathloom.llm.folds import fold
    from pathloom.llm.store import cut

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(cut(toxicity.train_sample(docs, labels)))
    held = docs.join(labels.where("toxic = 0"), "doc_id").where(fold("doc_id", 3) == 1).where("length(text) between 200 and 6000").orderBy("doc_id").limit(150)
    rng, broken = random.Random(1), ["mo ron", "id iot", "clo wn", "stu pid", "path etic", "worth less"]
    texts = []
    for r in held.select("text").collect():
        words = r.text.split(" ")
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice(broken))
        texts.append(" ".join(words))
    assert (scorer(texts) >= toxicity.THRESHOLD).mean() > 0.5


def test_toxicity_among_copies(spark):
    """Words that stand in a few toxic documents only because those are copies of one another drown no insult, however many."""
    import random

    from pathloom.llm.store import cut

    rng = random.Random(3)
    parts = "an the on er in th ed ing tion ou re ha es or at en nd st ea ti".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "moron", "clown", "stupid", "pathetic", "worthless"]

    def put(words, k):
        words = list(words)
        for w in rng.sample(insults, k):
            words.insert(rng.randrange(len(words) + 1), w)
        return " ".join(words)

    rows = []
    for _ in range(300):
        words = [word() for _ in range(60)]
        rows += [(put(words, rng.randint(1, 2)), 1) for _ in range(4)]
    rows += [(" ".join(word() for _ in range(60)), 0) for _ in range(1200)]
    scorer = toxicity.fit(cut(spark.createDataFrame(rows, "text string, label int").repartition(8)))
    toxic, clean = (scorer([put([word() for _ in range(60)], k) for _ in range(200)]) >= toxicity.THRESHOLD for k in (1, 0))
    assert toxic.mean() > 0.9 and clean.mean() < 0.05


def test_parts_that_explain_documents():
    """The parts that explain most, those common by themselves, but none that stands beside another only."""
    found = [["idiot ", "moron ", "x "]] * 30 + [["moron "]] * 40 + [["idiot "]] * 40 + [["y "]] * 2
    assert toxicity.cover(found, dict.fromkeys(["idiot ", "moron ", "x ", "y "], 0.0)) == [("idiot ", 70), ("moron ", 70)]
    assert toxicity.cover([], {}) == []
    assert toxicity.cover([["z "]] * 5, {"z ": 1.0}) == []
    assert toxicity.parts("You worthless, a") == {"you ", "worthless, ", "a ", "wort", "worth", "worthl", "worthle"}


# SentencePiece -------------------------------------------------------------------------------------------------------------

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_pieces_against_the_library(spark, odd_docs, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["Hello  world\n foo   é 中 ", "", " ", "\t\n", "a▁b", "x" * 3000, "😀 naïve ﬁ", "the theater thesis these then"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = by_id(encode(df, MODEL))
    back = by_id(decode(encode(df, MODEL), MODEL))
    for i, t in enumerate(texts):
        assert out[i].ids == lib.encode(t) and out[i].n_tokens == len(out[i].ids)
        assert back[i].text == t.replace(MARK, " ") and out[i].round_trip == (MARK not in t)
    runs = [" " * n for n in range(1, 70)] + ["a" + " " * 1000 + "b", " \n" * 40]
    assert [x.tolist() for x in Encoder(Vocabulary.load(MODEL)).encode(runs)] == [lib.encode(t) for t in runs]
    nulls = decode(spark.createDataFrame([(1, None), (2, []), (3, lib.encode("a b"))], "k int, ids array<int>"), MODEL)
    assert [r.text for r in nulls.orderBy("k").collect()] == [None, "", "a b"]
    odd = encode(odd_docs, MODEL).collect()
    assert len(odd) == 11 and all(r.round_trip for r in odd)
    assert encode(no_docs, MODEL).count() == 0


def test_long_runs_of_blanks_take_no_square():
    import time

    e, start = Encoder(Vocabulary.load(MODEL)), time.time()
    ids = e.encode([" " * 200_000])[0]
    assert e.decode(ids, np.array([len(ids)])) == [b" " * 200_000] and time.time() - start < 20


def test_unigram_viterbi_against_all_segmentations():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab"]
    scores = [0, -3.0, -2.5, -2.6, -2.7, -3.1, -3.3, -5.05, -3.2, -4.1, -3.9]
    e = Encoder(Vocabulary(pieces, scores, [True] + [False] * 10, [-1] * 11, 0, False))

    def best(w):
        if not w:
            return 0.0
        return max((scores[e.ids[w[:k]]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in e.ids), default=-1e9)

    words = sorted({MARK + "".join(p) for n in range(5) for p in __import__("itertools").product("abc", repeat=n)})
    for w, ids in e.encode_sorted(words):
        assert abs(sum(scores[k] for k in ids) - best(w)) < 1e-9 and "".join(pieces[k] for k in ids) == w
    assert [i.tolist() for i in e.encode(["az"])] == [[8, 0]]
    with pytest.raises(ValueError):
        Encoder(Vocabulary(["a▁b"], [0.0], [False], [-1], 0, True))
