"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are split into marked words (a blank becomes the mark and starts a word),
each batch's distinct new words are sorted, and the sorted list is walked
depth-first as the trie that it is: the forward state of every prefix is kept
on a stack, so words go on from the longest prefix they share with the word
before. The forward state of a prefix is the best segmentation of it, as its
last piece and where that starts:

* unigram models: the largest sum of piece scores (Viterbi);
* BPE models: merging by priority is not a sum of scores, so plain Viterbi gives
  other ids than the library. The pass uses the transition rule that holds for
  BPE instead: a piece may follow another exactly if merging the two pieces'
  text gives these two pieces again, and every prefix has one such chain. Runs
  of several marks, whose pieces tie, are merged directly.

How it holds at scale: one pass without a shuffle; a process remembers the ids
of a bounded number of words; memory follows the longest text. The vocabulary
(read on the driver, the path is a parameter) is shipped with the function, so
executors need no file.

``round_trip`` tells whether the bytes that a text's ids decode to are the text.

Defined results: null and empty texts have no ids and decode to the empty text.
A literal mark character in a text decodes to a blank, as in the library, so
``round_trip`` is false there. Repeated rows each keep a row; very long texts
are whole, and time is linear in them (n log n in a run of blanks). An empty
table gives no rows. Columns other than id and text pass unseen.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
REMEMBERED = 400_000


class Vocabulary:
    """Pieces, scores and kinds of a model."""

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool], byte: list[int], unknown: int, merges: bool):
        self.pieces, self.scores, self.special, self.byte, self.unknown, self.merges = pieces, scores, special, byte, unknown, merges

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file with identity normalisation and a dummy prefix."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [int(model.id_to_piece(i)[3:5], 16) if model.is_byte(i) else -1 for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        ordinary = [scores[i] for i in range(n) if not special[i] and byte[i] < 0]
        merges = all(s == int(s) for s in ordinary)  # BPE files hold ranks
        return cls([model.id_to_piece(i) for i in range(n)], scores, special, byte, model.unk_id(), merges)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if not v.special[i] and v.byte[i] < 0}
        self.bytes = {b: i for i, b in enumerate(v.byte) if b >= 0}
        self.text = [b"" if v.special[i] else bytes([v.byte[i]]) if v.byte[i] >= 0 else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        self.text[v.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind other characters, so texts don't split at marks")
        self.alone = {c for p in self.ids for c in p}
        # Pieces by their reversed characters: [id or -1, longer pieces].
        root = [-1, {}]
        for p, i in self.ids.items():
            node = root
            for c in reversed(p):
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.tails: dict = root[1]
        self.split = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.alone else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def __reduce__(self):
        return Encoder, (self.vocabulary,)

    def merged(self, text: str) -> list[int]:
        """Ids by merging neighbours: the pair with the best score first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.vocabulary.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (k := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-scores[k], i, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j], after[i] = "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [k for p in parts if p for k in self.one(p)]

    def one(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.vocabulary.unknown]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (got := self.follows.get(key)) is None:
            pieces = self.vocabulary.pieces
            got = self.merged(pieces[b]) == [b] if a < 0 else self.merged(pieces[a] + pieces[b]) == [a, b]
            self.follows[key] = got
        return got

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of sorted distinct words; prefix states are kept from one word to the next."""
        merges, scores, tails = self.vocabulary.merges, self.vocabulary.scores, self.tails
        known, may_follow, one = self.follows.get, self.may_follow, self.one
        unseen = min(scores) - 10.0
        # By prefix length: the last piece (-1: none, or a character that no piece has), its start, the sum of scores.
        before, last, start, best = "", [-1], [0], [0.0]
        for word in words:
            if merges and word.startswith(MARK + MARK):
                yield word, self.merged(word)
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                longer, j, piece, at, value = tails, end, -1, end - 1, -1e18
                while j and (node := longer.get(word[j - 1])) is not None:
                    j -= 1
                    k, longer = node
                    if k < 0:
                        continue
                    if merges:
                        ok = known(last[j] << 20 | k)
                        if ok or ok is None and may_follow(last[j], k):
                            piece, at = k, j
                            break
                    elif best[j] + scores[k] > value:
                        piece, at, value = k, j, best[j] + scores[k]
                last.append(piece)
                start.append(at)
                if not merges:
                    best.append(best[end - 1] + unseen if piece < 0 else value)
            ids, end = [], len(word)
            while end:
                if last[end] < 0:
                    ids += reversed(one(word[end - 1]))
                else:
                    ids.append(last[end])
                end = start[end]
            before = word
            ids.reverse()
            yield word, ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        units = [self.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*units).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*units)
        for word, ids in self.encode_sorted(sorted(new)):
            self.known[word] = array("i", ids).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), "<i4") for own in units]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: the bytes of all pieces, without the blank that encoding put first."""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.firsts[ids] - (stops - sizes), sizes)
        out, stops = self.flat[at].tobytes(), np.r_[0, stops]
        cuts = stops[np.r_[0, ends]].tolist()
        return [out[a + (out[a : a + 1] == b" ") : b] if a < b else b"" for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, model: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ``n_tokens``, ``ids``, ``n_bytes`` (tokens that are bytes) and ``round_trip``."""
    encoder = Encoder(Vocabulary.load(model) if isinstance(model, str) else model)
    is_byte = np.array([b >= 0 for b in encoder.vocabulary.byte])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                texts = batch.column(1).to_pylist()
                ids = encoder.encode(texts)
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, "<i4")
                ends = np.cumsum(sizes)
                sums = np.r_[0, np.cumsum(is_byte[flat])]
                same = [own == (t or "").encode("utf-8", "surrogatepass") for own, t in zip(encoder.decode(flat, ends), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(sums[ends] - sums[ends - sizes]), pa.array(same)], ["id", "n_tokens", "ids", "n_bytes", "round_trip"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, n_bytes long, round_trip boolean").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str | Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the text of its ids; null ids give null. Bytes that are no UTF-8 become the replacement character."""
    encoder = Encoder(Vocabulary.load(model) if isinstance(model, str) else model)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes))
        null = lists.is_null().to_pylist()
        return pa.array([None if gone else own.decode("utf-8", "replace") for gone, own in zip(null, out, strict=True)], pa.string())

    return tokens.withColumn(text_col, text(F.col(ids_col)))
