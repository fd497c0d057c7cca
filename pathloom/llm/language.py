"""Language identification by rank-order n-gram profiles.

A profile lists a text's most frequent n-grams (one to three characters of its
words) by rank. A document is of the language whose profile its own is least
out of place with: for each of its n-grams the distance between the two ranks,
or the profile's length where the language lacks it.

Profiles are learned in one distributed aggregation over a bounded sample of
labelled rows; the model is a few hundred n-grams a language, so it is shipped
with the function. Prediction is one pass without a shuffle, document by
document.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Ties go to the n-gram, and to the language, that sorts first. Without any
labelled row all documents are ``und``. Repeated rows each keep a row, very long
texts are read whole, an empty table gives no rows. ``predict`` replaces columns
that have its new columns' names; ``language_id`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .folds import bounded, fold
from .store import free_name

LENGTH = 300
ORDERS = 3
UNKNOWN = "und"
BITS = 21


class _Letters:
    """Code point to lower-case letter, 32 for all that is not a letter; made once for each process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        if cls.table is None:
            low = np.full(0x110000, 32, np.uint32)
            for c in range(0x110000):
                if chr(c).isalpha():
                    low[c] = ord(chr(c).lower()[0])
            cls.table = low
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls.table[codes]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words of a text (a space stands before and after each word) and how often each occurs."""
    codes = _Letters.of(text)
    codes = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.int64)
    blank = codes == 32
    codes = codes[~(blank & np.r_[False, blank[:-1]])]  # one space between words
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = codes != 32
    two = codes[:-1] << BITS | codes[1:]
    three = two[:-1] << BITS | codes[2:]
    return np.unique(np.concatenate([codes[inner], two, three[inner[1:-1]]]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > length:
        least = -np.partition(-counts, length - 1)[length - 1]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:length]


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 4000, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Profiles of every language in ``rows``, from at most about ``most`` rows of each."""
    known = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sample = bounded(known, "id", "lang", most).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                keys, n = zip(*(grams(t) for t in texts), strict=True)
                keys, at = np.unique(np.concatenate(keys), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64)})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    got = best.orderBy("lang", "rank").toPandas()
    return {lang: part["gram"].to_numpy() for lang, part in got.groupby("lang")}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", length: int = LENGTH, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (how much nearer the best language is than the next) and ``closeness``.

    ``closeness`` is 1 for a document whose ranks are those of the language and 0 for one that shares no n-gram with it. The new columns' names begin with ``prefix``.
    """
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(known) + 1, max(1, len(names))), -1, np.int64)  # the last row is for n-grams of no language
    for j, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), j] = np.arange(len(profiles[name]))

    def judge(text: str | None) -> tuple[str, float, float]:
        own = ranked(*grams(text), length) if text and names else known[:0]
        if not len(own):
            return UNKNOWN, 0.0, 0.0
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        there = ranks[at]
        away = np.where(there < 0, length, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        order = np.argsort(away, kind="stable")
        first, second = away[order[0]], away[order[1]] if len(names) > 1 else length * len(own)
        return names[order[0]], float((second - first) / second) if second else 0.0, 1.0 - first / (length * len(own))

    @F.pandas_udf("lang string, score double, closeness double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts], columns=["lang", "score", "closeness"])

    own = free_name(docs, "judged")
    out = docs.withColumn(own, judged(F.col(text_col).cast("string")))
    return out.withColumns({prefix + "lang_pred": F.col(f"{own}.lang"), prefix + "score": F.col(f"{own}.score"), prefix + "closeness": F.col(f"{own}.closeness")}).drop(own)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, most: int = 4000) -> DataFrame:
    """Per document its id, ``held_out``, ``lang_pred``, ``score`` and ``closeness``; profiles come from the documents not held out."""
    train = docs.where(fold(id_col, folds) != 0)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (fold(id_col, folds) == 0).alias("held_out"))
    out = predict(own, fit(train, id_col, text_col, lang_col, most), "_text")
    return out.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score", "closeness")
