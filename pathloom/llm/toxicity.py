"""Toxicity by a subsequence string kernel on sentences, Nystroem landmarks and a linear SVM.

The kernel of two strings sums, over all subsequences of three and of four
letters (a blank counts as a letter, and may be a gap) that both have within six places, decay to the power of the places each
spans (gaps included), divided by the strings' own lengths. Characters put into
an insult, a blank too, only stretch what it shares with it, so spaced, starred,
broken or misspelt insults stay near it, and so do insults of several words.

A sentence is read as all windows of 7 to 12 places (WIDTHS) over its characters (runs of
single characters are joined first); it is as toxic as its worst window, a
document as the number of its windows near insults (worst ones of neighbours). Only documents are labelled, so labels are passed
to windows in rounds: at first by the words and beginnings of words that explain
toxic training documents (``cover``; without one by the odds of every
subsequence in toxic and clean ones), then by the last round's SVM. Each round a document's
worst windows stand for it (of a clean document they are those that break the
margin; others have no loss) beside evenly drawn ones, and the SVM is fitted
again. Nystroem features are kernels with landmark windows, whitened; the SVM
is linear on them. Its decision is an inner product with one weight for each
subsequence, so the landmarks fold into a table of weights and text is scored
by 20 lookups a character, whatever their number.

Scoring is one pass without a shuffle. Memory follows the longest text.

Bounds: at most about ``most`` labelled documents of each class train. Letters
other than a-z share four codes (LETTERS), so scripts beyond Latin are told
apart less well.

Defined results: null and empty texts score the prior of an empty text (0).
With one class only, or no labels, all scores are 0. Ties in the draws go to
the window that sorts first. Repeated rows each keep a row, very long texts are
read whole, an empty table gives no rows. ``predict`` replaces columns that have
its new columns' names; ``toxicity`` returns its own columns only.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .folds import bounded, fold
from .store import cut, drop

LETTERS = 32
SPAN = 6
DECAY = 0.7
TABLE = LETTERS**4 + LETTERS**3
END = 31  # the letter for a word's ends
PLACES = 28  # longer words are windows of this many places that overlap by half
LANDMARKS = 1000
WIDTHS = (7, 8, 9, 10, 12)  # places of a window, none below SPAN
CHUNK = 1 << 15
ROUNDS = 2
PENALTY = 2e-4
STANDING = 3  # a document's worst windows that train
THRESHOLD = 0.7
NEAR = 0.3  # a window's decision value from which it begins to count
TOXIC_SHARE = 0.4
STEMS = (4, 5, 6, 7)  # letters of a word's beginnings
LEAST = 3  # toxic documents that a word or beginning must explain
ODDS = 2.5  # and its log odds against clean ones
COMMON = 0.02  # share of the toxic documents from which it trains though others explain them
BESIDE = 0.9  # unless in this share of them one other part stands too
STEPS = [x for n in (2, 3) for x in combinations(range(1, SPAN), n)]  # the other letters' places after the first
STOP = "\x01" * SPAN  # no subsequence reaches over it
GAP = "\x01" * max(WIDTHS)  # and over this no window
BREAK = re.compile(r"[.!?]+(?:\s|\Z)")
SPACED = re.compile(r"(?:(?<!\S)\S[^\S\n]){2,}\S(?!\S)")

_code = np.zeros(0x110000, np.uint8)
for _c in range(0x80, 0x110000):
    if chr(_c).isalpha():
        _code[_c] = 27 + _c % 4
for _i in range(26):
    _code[97 + _i] = _code[65 + _i] = 1 + _i
_code[0] = _code[32] = END
_blank = np.zeros(0x110000, bool)
_blank[[_c for _c in range(0x3001) if chr(_c).isspace()]] = True


def tokens(text: str) -> list[str]:
    """Lower-case words; single characters in a row are one word."""
    text = text.lower()
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), text)
    return text.split()


def windows(words: list[str], ends: str = "\0") -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the words' windows (0: no letter, a gap), and each window's word."""
    cut, owner = [], []
    for i, w in enumerate(words):
        w = f"{ends}{w}{ends}"
        if len(w) <= PLACES:
            cut.append(w)
            owner.append(i)
        else:
            for k in range(0, len(w) - PLACES // 2, PLACES // 2):
                cut.append(w[k : k + PLACES])
                owner.append(i)
    text = "".join(w.ljust(PLACES, "\x01") for w in cut)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _code[points].reshape(-1, PLACES), np.array(owner, np.int64)


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to place the letters: their number, where all are letters, and the weight."""
    c = codes.astype(np.int32)
    for steps in STEPS:
        last = codes.shape[1] - steps[-1]
        key, whole = c[:, :last], c[:, :last] > 0
        for a in steps:
            key = key * LETTERS + c[:, a : last + a]
            whole &= c[:, a : last + a] > 0
        yield key + LETTERS**4 * (len(steps) == 2), whole, DECAY ** (steps[-1] - len(steps))


def sparse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences of each window, equal ones summed and the whole of length 1: (window, subsequence, value)."""
    keys, values = [], []
    for key, whole, weight in subsequences(codes):
        r, p = np.nonzero(whole)
        keys.append(r * TABLE + key[r, p])
        values.append(np.full(len(r), weight))
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.bincount(at, np.concatenate(values), len(own))
    rows, keys = own // TABLE, own % TABLE
    square = np.bincount(rows, values * values, len(codes))
    return rows, keys, values / np.sqrt(square[rows])


def score_words(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The decision value of each word: its worst window's."""
    out = np.full(len(words), -1e9)
    for lo in range(0, len(words), 5000):
        codes, owner = windows(words[lo : lo + 5000])
        rows, keys, values = sparse(codes)
        np.maximum.at(out, lo + owner, np.bincount(rows, table[keys] * values, len(codes)) + bias)
    return out


def features(words: list[str], ends: str = "\0") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequence features of words of up to PLACES places, their ends included (of longer ones the first window)."""
    return sparse(windows([w[: PLACES - 2 * len(ends)] for w in words], ends)[0])


def kernel(words: list[str], landmarks: list[str], ends: str = "\0", white: np.ndarray | None = None) -> np.ndarray:
    """Kernels of words with landmarks, by way of the landmarks that have each subsequence.

    With ``white`` their products with it, in half precision: all features of all training windows are held at once.
    """
    lr, lk, lv = features(landmarks, ends)
    order = np.argsort(lk, kind="stable")
    lr, lv = lr[order], lv[order]
    start = np.searchsorted(lk[order], np.arange(TABLE + 1))
    out = np.zeros((len(words), len(landmarks) if white is None else white.shape[1]), np.float32 if white is None else np.float16)
    for first in range(0, len(words), 50):
        r, k, v = features(words[first : first + 50], ends)
        shape = len(words[first : first + 50]), len(landmarks)
        times = start[k + 1] - start[k]
        at = np.arange(times.sum()) + np.repeat(start[k] - (np.cumsum(times) - times), times)
        own = np.bincount(np.repeat(r * shape[1], times) + lr[at], np.repeat(v, times) * lv[at], shape[0] * shape[1]).reshape(shape)
        out[first : first + 50] = own if white is None else own @ white
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """A linear SVM with squared hinge loss and a bias, by Newton steps, each halved until the loss falls."""
    w, step, best = np.zeros(x.shape[1] + 1), None, np.inf
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(rounds):
        left, slope, loss = np.diag(ridge), ridge * w, (ridge * w * w).sum()
        for lo in range(0, len(x), 512):
            part, sign = np.c_[x[lo : lo + 512].astype(np.float64), np.ones(len(x[lo : lo + 512]))], y[lo : lo + 512]
            short = 1 - sign * (part @ w)
            active = short > 0
            xa, wa = part[active], weight[lo : lo + 512][active]
            left += xa.T @ (xa * wa[:, None])
            slope -= xa.T @ (wa * sign[active] * short[active])
            loss += (wa * short[active] ** 2).sum()
        if loss > best * (1 + 1e-9):
            step = step / 2
            w = w - step
            continue
        if loss > best * (1 - 1e-6):
            break
        best, step = loss, -np.linalg.solve(left, slope)
        w = w + step
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a lightly regularised logistic regression; toxic rows weigh TOXIC_SHARE in all."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y > 0, TOXIC_SHARE / max(1, (y > 0).sum()), (1 - TOXIC_SHARE) / max(1, (y <= 0).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), x.T @ (weight * (p - y)) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def parts(text: str) -> set[str]:
    """A text's words, a blank behind each, and the beginnings of words (STEMS)."""
    words = set(tokens(text))
    found = {f"{w} " for w in words if len(w) <= PLACES - 2}
    for n in STEMS:
        found.update(w[:n] for w in words if len(w) > n)
    return found


def cover(found: list[list[str]], expected: dict[str, float]) -> list[tuple[str, int]]:
    """Parts that explain toxic documents, and how many they are in: always the one that explains most of those left.

    ``found`` has each toxic document's likely parts, ``expected`` how many toxic documents would have a part by chance.
    What stands in toxic documents beside an insult only explains none that are left, so the words that a large sample
    shows in a few toxic documents by chance, or in copies of one, are not taken. Parts in COMMON of these documents
    follow, unless they stand beside one taken before nearly always.
    """
    having: dict[str, list[int]] = {}
    for i, own in enumerate(found):
        for part in own:
            having.setdefault(part, []).append(i)
    left = np.ones(len(found), bool)

    def rank(part: str) -> tuple[float, int, str]:
        return math.exp(ODDS) * expected[part] - left[having[part]].sum(), -len(part), part

    heap, out = [rank(part) for part in having], []
    heapq.heapify(heap)
    while heap:
        part = heapq.heappop(heap)[2]
        now = rank(part)
        if heap and now > heap[0]:
            if now[0] < 0:
                heapq.heappush(heap, now)
            continue
        if left[having[part]].sum() >= LEAST and now[0] < 0:
            out.append(part)
            left[having[part]] = False
    taken = [set(having[part]) for part in out]
    common = [part for part, own in having.items() if len(own) >= max(LEAST, COMMON * len(found), math.exp(ODDS) * expected[part])]
    for part in sorted(common, key=lambda part: (-len(having[part]), -len(part), part)):
        own = set(having[part])
        if all(len(own & other) < BESIDE * len(own) for other in taken):
            out.append(part)
            taken.append(own)
    return [(part, len(having[part])) for part in out]


def _lone(texts: list[str]) -> np.ndarray:
    """Whether three lone characters follow one another anywhere in a text, as SPACED needs it."""
    blank = _blank[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.zeros(len(texts), bool)
    if len(blank) > 6:
        lone = blank[:-2] & ~blank[1:-1] & blank[2:]
        hits = np.flatnonzero(lone[:-4] & lone[2:-2] & lone[4:])  # of the blank before
        out[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), hits, "right")] = True
    return out


def sentences(texts: list[str]) -> list[str]:
    """The sentences of each text in lower case, one blank between words and a stop between sentences."""
    out = []
    texts = [t.lower() for t in texts]
    for text, lone in zip(texts, _lone(texts).tolist(), strict=True):
        if lone:
            text = SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), text)
        out.append(STOP.join(f" {t} " for x in BREAK.split(text) if (t := " ".join(x.split()))))
    return out


def letters(text: str) -> np.ndarray:
    return _code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def places(codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each way to place the letters: the last letter's place, the gaps, and for each place the subsequence that begins there and whether it is whole."""
    n = len(codes)
    c = np.zeros(n + SPAN, np.int64)
    c[:n] = codes
    there = c > 0
    for a in range(1, SPAN):
        two, both = c[:n] * LETTERS + c[a : a + n], there[:n] & there[a : a + n]
        for b in range(a + 1, SPAN):
            three, all3 = two * LETTERS + c[b : b + n], both & there[b : b + n]
            yield b, b - 2, three + LETTERS**4, all3
            for d in range(b + 1, SPAN):
                yield d, d - 3, three * LETTERS + c[d : d + n], all3 & there[d : d + n]


def window_scores(codes: np.ndarray, table: np.ndarray, bias: float, floor: float = -1e9) -> tuple[np.ndarray, np.ndarray]:
    """The decision value of the worst window that begins at each place, and its width; ``table`` is 0 for subsequences that are not whole.

    A running sum takes a window's length from each placement alone, which is too small where a subsequence occurs twice
    and so puts the window too far from the bias. The windows that this puts above ``floor`` get their kernel's own
    length; what stays below a floor above the bias is below it in either reading.
    """
    out, width = np.full(len(codes), -1e9, np.float32), np.zeros(len(codes), np.uint8)
    most = max(WIDTHS)
    for lo in range(0, len(codes), CHUNK):
        part = codes[lo : lo + CHUNK + most]
        n, size = min(CHUNK, len(codes) - lo), len(part)
        weights: dict[tuple[int, int], list[np.ndarray]] = {}
        for last, gaps, key, whole in places(part):
            if (own := weights.get((last, gaps))) is None:
                weights[last, gaps] = [table.take(key, mode="clip"), whole.astype(np.uint8)]
            else:
                own[0] += table.take(key, mode="clip")
                own[1] += whole
        # Sums over the subsequences that begin, and that end, before each place: of decisions and of squared weights.
        edges = np.zeros((2, 2, size + most + 1), np.float32)
        for (last, gaps), (decision, found) in weights.items():
            for i, own in enumerate((decision * np.float32(DECAY**gaps), found * np.float32(DECAY ** (2 * gaps)))):
                edges[i, 0, 1 : size + 1] += own
                edges[i, 1, 1 + last : 1 + last + size] += own
        (begun, ended), (begun_square, ended_square) = np.cumsum(edges, 2, np.float64)
        now, now_width = out[lo : lo + n], width[lo : lo + n]
        for w in WIDTHS:
            v = (ended[w : w + n] - begun[:n]).astype(np.float32)
            square = (ended_square[w : w + n] - begun_square[:n]).astype(np.float32)
            v /= np.sqrt(np.maximum(square, np.float32(1), out=square), out=square)
            better = v > now
            np.copyto(now, v, where=better)
            np.copyto(now_width, np.uint8(w), where=better)
    out = out.astype(np.float64) + bias
    width = width.astype(np.int64)
    high = np.flatnonzero(out > floor)
    if len(high):
        out[high] = whole_scores(cut_out(codes, high, width[high]), table, bias)
    return out, width


def cut_out(codes: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The windows of these widths that begin at these places, a row each."""
    i = at[:, None] + np.arange(max(WIDTHS))
    return np.where((i < len(codes)) & (np.arange(max(WIDTHS)) < width[:, None]), codes[np.minimum(i, len(codes) - 1)], 0)


def whole_scores(own: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The decision values of windows by their kernel's own length."""
    out = np.empty(len(own))
    for lo in range(0, len(own), 5000):
        rows, keys, values = sparse(own[lo : lo + 5000])
        out[lo : lo + 5000] = np.bincount(rows, table[keys] * values, len(own[lo : lo + 5000])) + bias
    return out


def _runs(texts: list[str | None]) -> Iterator[list[int]]:
    """The numbers of the texts that have any characters, in runs of about CHUNK characters; a longer text is a run of its own."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if text:
            if run and size + len(text) > CHUNK:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(text)
    if run:
        yield run


def worst_places(v: np.ndarray) -> np.ndarray:
    """The worst window's place in each run of as many places as a window has at most."""
    most = max(WIDTHS)
    full = np.full(-(-len(v) // most) * most, -1e9)
    full[: len(v)] = v
    return full.reshape(-1, most).argmax(1) + most * np.arange(len(full) // most)


class Scorer:
    """Scores of texts."""

    def __init__(self, table: np.ndarray, bias: float, line: tuple[float, float] | None):
        self.table, self.bias, self.line = table, bias, line

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Per text the root of the soft count of its windows near insults; -1 without words."""
        out, near, owner = np.full(len(texts), -1.0), [], []
        for some in _runs(texts):
            own = sentences([texts[i] for i in some])
            # One array for all: no window that begins in a text reaches the next.
            codes = letters(GAP.join(own))
            v, width = window_scores(codes, self.table, self.bias, np.inf)
            first = 0
            for i, t in zip(some, own, strict=True):
                if t:
                    at = worst_places(v[first : first + len(t)]) + first
                    at = at[v[at] > max(NEAR, self.bias)]
                    near.append(cut_out(codes, at, width[at]))
                    owner.append(np.full(len(at), i))
                    out[i] = 0.0
                first += len(t) + len(GAP)
        if near:
            v = whole_scores(np.concatenate(near), self.table, self.bias)
            out[out == 0] = np.sqrt(np.bincount(np.concatenate(owner), np.clip((v - NEAR) / 0.5, 0, 1), len(texts)))[out == 0]
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.line is None:
            return np.zeros(len(texts))
        x = self.counts(texts)
        return np.where(x < 0, 0.0, 1 / (1 + np.exp(-np.clip(x * self.line[0] + self.line[1], -30, 30))))


def fit(sample: DataFrame, landmarks: int = LANDMARKS) -> Scorer:
    """A scorer from a bounded sample (text, label) of labelled documents."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Scorer(np.zeros(TABLE, np.float32), 0.0, None)

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((2, TABLE), np.int32)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                own = np.zeros(TABLE, bool)
                for _, _, key, whole in places(letters(sentences([text])[0])):
                    own[key[whole]] = True
                found[label] += own
        key = np.nonzero(found.any(0))[0]
        yield pd.DataFrame({"key": key, "toxic": found[1, key], "clean": found[0, key]})

    def count_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                for part in parts(text):
                    found.setdefault(part, [0, 0])[label] += 1
        n = np.array(list(found.values()), np.int64).reshape(-1, 2)
        yield pd.DataFrame({"part": pd.Series(list(found), dtype="object"), "toxic": n[:, 1], "clean": n[:, 0]})

    # Words and beginnings of words that explain toxic documents train beside the windows, each as it stands and broken by a
    # blank; those longer than a window train through their windows alone.
    seen = sample.mapInPandas(count_parts, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = f"ln((toxic + 0.1) / (clean * {sizes[1] / sizes[0]} + 0.1)) > {ODDS}"
    likely = seen.where(f"toxic >= {LEAST} and {odds}").toPandas()
    expected = dict(zip(likely["part"], likely["clean"] * (sizes[1] / sizes[0]), strict=True))

    def found_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"parts": ["\n".join(expected.keys() & parts(text)) for text in frame["text"]]})

    found = sample.where("label = 1").select("text").mapInPandas(found_parts, "parts string").toPandas()
    seeds = cover([x.split("\n") for x in found["parts"] if x], expected)
    whole = [f" {part}" for part, _ in seeds]
    broken = [f"{w[: len(w) // 2]} {w[len(w) // 2 :]}" for w in whole]
    known = np.array([n for _, n in seeds], float) ** 0.5
    counts = sample.mapInPandas(distinct, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The less is known of a subsequence the nearer to 0.
    odds = f"(ln((toxic + 1) / {sizes[1] + 2}) - ln((clean + 1) / {sizes[0] + 2})) * sqrt(toxic / (toxic + 3))"
    counts = counts.where("toxic > 0").select(F.col("key").cast("int").alias("key"), F.expr(odds).cast("float").alias("odds")).toArrow()
    table = np.zeros(TABLE, np.float32)
    table[counts.column("key").to_numpy()] = counts.column("odds").to_numpy()
    del counts, seen, likely, expected, found
    bias, before = 0.0, None
    for i in range(ROUNDS):
        got = _standing(sample, table, bias, () if i else [part for part, _ in seeds])
        # Clean windows that broke an earlier round's margin stay.
        before = got = pd.concat([got, *([] if before is None else [before[before["kind"] == 0]])]).drop_duplicates().sort_values(["kind", "window"], ignore_index=True)
        bad, ok = (got[got["kind"] == k] for k in (1, 0))
        if not len(bad) or not len(ok):
            return Scorer(np.zeros(TABLE, np.float32), 0.0, None)
        half = landmarks // 2
        marks = whole[: half // 3] + broken[: half // 6]
        marks += list(bad["window"].iloc[:: max(1, len(bad) // (half - len(marks)))][: half - len(marks)])
        marks += list(ok["window"].iloc[:: max(1, len(ok) // (landmarks - len(marks)))][: landmarks - len(marks)])
        train = list(bad["window"]) + whole + broken + list(ok["window"])
        y = np.r_[np.ones(len(bad) + 2 * len(whole)), -np.ones(len(ok))]
        share = 0.5 if len(whole) else 0.0  # of the toxic weight, for the words
        weight = np.r_[np.full(len(bad), (1 - share) / len(bad)), np.tile(share / 2 * known / max(known.sum(), 1.0), 2), np.full(len(ok), 1.0 / len(ok))]
        value, vector = np.linalg.eigh(kernel(marks, marks, "").astype(np.float64))
        keep = value > 1e-4 * value.max()
        white = vector[:, keep] / np.sqrt(value[keep])
        x = kernel(train, marks, "", white)
        w = svm(x, y, weight, PENALTY)
        del x
        # The landmarks fold into one weight for each subsequence.
        row, key, own = features(marks, "")
        table, bias = np.bincount(key, (white @ w[:-1])[row] * own, TABLE).astype(np.float32), float(w[-1])
    plain = Scorer(table, bias, None)

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": plain.counts(frame["text"].tolist()), "label": frame["label"]})

    got = sample.mapInPandas(counts, "x double, label int").toPandas().sort_values(["x", "label"], ignore_index=True)
    plain.line = logistic(got["x"].to_numpy(), got["label"].to_numpy())
    return plain


def _both(window: str, i: int, label: int) -> list[tuple[str, int]]:
    """A window as it stands, and with a blank put into it: what is broken by one is as toxic."""
    w = window.strip("\x01")
    k = 2 + i % max(1, len(w) - 3)
    return [(w, label), (f"{w[:k]} {w[k:]}", label)]


def _standing(sample: DataFrame, table: np.ndarray, bias: float, known: Iterable[str] = ()) -> pd.DataFrame:
    """(window, kind) of the windows that stand for the sample's documents, in order of their text: the worst of each, and as many evenly drawn ones of clean documents.

    A toxic document with any of the ``known`` parts is stood for by the windows that begin with the first of them.
    """
    known = re.compile(f" (?={'|'.join(map(re.escape, known))})") if known else None

    def stand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label in zip(frame["text"], frame["label"], strict=True):
                own = sentences([text])[0]
                if not own:
                    continue
                if label and known and (at := [x.start() for x in islice(known.finditer(own), STANDING)]):
                    for i in at:
                        rows += _both(own[i : i + WIDTHS[i % len(WIDTHS)]], i, label)
                    continue
                v, width = window_scores(letters(own), table, bias, np.inf)
                at = worst_places(v)
                worst = at[np.argsort(-v[at], kind="stable")[:STANDING]]
                if label:  # one window at least, more while they are nearly as bad
                    worst = worst[v[worst] >= v[worst[0]] - 0.2 * abs(v[worst[0]])]
                else:
                    worst = np.unique(np.r_[worst, at[:: max(1, len(at) // STANDING)][:STANDING]])
                for i in worst.tolist():
                    rows += _both(own[i : i + width[i]], i, label)
            yield pd.DataFrame(rows, columns=["window", "kind"])

    got = sample.mapInPandas(stand, "window string, kind int").toPandas()
    return got.sort_values(["kind", "window"], kind="stable", ignore_index=True)


def predict(docs: DataFrame, scorer: Scorer, text_col: str, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, their names behind ``prefix``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer([t if isinstance(t, str) else None for t in texts]))

    out = docs.withColumn(prefix + "score", score(F.col(text_col).cast("string")))
    return out.withColumn(prefix + "predicted", F.when(F.col(prefix + "score") >= threshold, 1).otherwise(0).cast("int"))


def train_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, most: int = 6000) -> DataFrame:
    """(text, label) of about ``most`` labelled documents of each class at most, none of the held-out fold, equal texts once.

    A document with several labels has its largest. The sample's ids are bounded by ``most``, so they are broadcast and
    the documents are not shuffled.
    """
    label = F.when(F.col(label_col).isin(0, 1), F.col(label_col).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("label")).where((fold("_id", folds) != held) & F.col("label").isNotNull())
    ids = bounded(known, "_id", "label", most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return cut(texts.join(F.broadcast(ids), "_id").groupBy("text").agg(F.max("label").alias("label")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1) -> DataFrame:
    """Per document its id, ``held_out``, ``score`` and ``predicted``."""
    sample = train_sample(docs, labels, id_col, text_col, label_col, folds, held)
    scorer = fit(sample)
    drop(sample)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (fold(id_col, folds) == held).alias("held_out"))
    return predict(own, scorer, "_text").select(F.col("_id").alias(id_col), "held_out", "score", "predicted")
