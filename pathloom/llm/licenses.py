"""License scans by matching template markup.

A template is a notice in the markup of licence lists:
``<<beginOptional>>...<<endOptional>>`` may be left out and
``<<var;match="...">>`` may be replaced by words that the pattern allows. Each
template is compiled to an automaton over words; a text matches where the
automaton accepts a run of its words, so all mandatory wording must stand
exactly, while case, punctuation and spacing do not count.

Words of whole texts are found and hashed as arrays; automata start only at
words that some template can begin with, and only in texts that have them. One
pass without a shuffle; memory follows the longest text.

Defined results: a null or empty text has no words, null ``first_word`` and
``last_word``, empty labels and score 0. Of matches of one template that start
at the same word the longest counts. Repeated rows each keep a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: Phrases that are licenses by themselves, with their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices in template markup, with their labels.
TEMPLATES = {
    "MIT": '<<beginOptional>>released <<endOptional>><<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>mit license',
    "MIT-grant": 'permission is hereby granted, free of charge, to any person obtaining a copy of <<var;match="this|the|[a-z]+";max=3>> software and associated documentation files',
    "Apache": 'licensed under the apache license<<beginOptional>>, version <<var;match="[0-9]+";max=2>><<endOptional>>',
    "GPL": '<<beginOptional>>this <<var;match="[a-z]+";max=2>> is <<endOptional>><<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>><<beginOptional>>gnu <<endOptional>>general public license<<beginOptional>>, version <<var;match="[0-9]+";max=2>><<endOptional>>',
    "GPL-grant": 'this program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation',
    "BSD": 'redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met',
    "CC-BY": 'licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by<<beginOptional>> <<var;match="nc|sa|nd";max=2>><<endOptional>><<beginOptional>> <<var;match="[0-9]+";max=2>><<endOptional>>',
    "MPL": 'subject to the terms of the mozilla public license<<beginOptional>>, v<<endOptional>><<beginOptional>> <<var;match="[0-9]+";max=2>><<endOptional>>',
}

MARKUP = re.compile(r"<<(beginOptional|endOptional|var;match=\"(.*?)\"(?:;max=(\d+))?)>>")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


class Automaton:
    """A nondeterministic automaton over words: ``exact[state]`` and ``open[state]`` lead on, ``skip[state]`` without a word."""

    def __init__(self, template: str):
        self.exact: list[dict[str, int]] = [{}]
        self.open: list[list[tuple[re.Pattern, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        now, opened, at = 0, [], 0
        for m in MARKUP.finditer(template):
            now = self._wording(now, template[at : m.start()])
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(now)
            elif m[1] == "endOptional":
                end = self._state()
                self.skip[now].append(end)
                self.skip[opened.pop()].append(end)
                now = end
            else:
                end, pattern = self._state(), re.compile(m[2])
                for _ in range(int(m[3] or 1)):
                    after = self._state()
                    self.open[now].append((pattern, after))
                    self.skip[after].append(end)
                    now = after
                now = end
        self.accepting = self._wording(now, template[at:])
        self.firsts = set().union(*(self.exact[s] for s in self._closed({0})))

    def _state(self) -> int:
        for part in (self.exact, self.open, self.skip):
            part.append({} if part is self.exact else [])
        return len(self.exact) - 1

    def _wording(self, now: int, text: str) -> int:
        for word in WORD.findall(lowered(text)):
            after = self._state()
            self.exact[now][word] = after
            now = after
        return now

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[str], start: int) -> int:
        """The end of the longest accepted run of words from ``start``, or -1."""
        states, end = self._closed({0}), -1
        for i in range(start, len(words)):
            word = words[i]
            after = {self.exact[s][word] for s in states if word in self.exact[s]}
            after |= {t for s in states for pattern, t in self.open[s] if pattern.fullmatch(word)}
            if not after:
                break
            states = self._closed(after)
            if self.accepting in states:
                end = i + 1
        return end


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans``.

    ``score`` is 1 where a whole template matches, 0.5 where only a phrase stands, else 0. ``spans`` lists label, first
    word and end word of each template match.
    """
    automata = {label: Automaton(t) for label, t in (TEMPLATES if templates is None else templates).items()}
    anchors = {w for a in automata.values() for w in a.firsts}
    anchor_hashes = np.sort(np.array([W.word_hash(w) for w in anchors], W.U))
    phrases = [(np.array([W.word_hash(w) for w in p.split()], W.U), label) for p, label in PHRASES.items()]
    # A template can only match where its rarest mandatory word stands; texts without any of these are not walked.
    needed = np.sort(np.array([W.word_hash(w) for w in ("license", "licensed", "permission", "redistribution", "redistribute", *((w for t in (templates or {}).values() for w in WORD.findall(lowered(MARKUP.sub(" ", t))))))], W.U))

    def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(values), bool)
        return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            for row0, own, offsets in W.pieces(batch.column(1)):
                own = W.LOWER[own]
                starts, stops, rows = W.spans(own, offsets, W.NOT_ALNUM)
                hashed = W.hashes(own, starts, stops)
                counts = np.bincount(rows, minlength=len(offsets) - 1)
                n_words[row0 : row0 + len(counts)] = counts
                begin = np.cumsum(counts) - counts
                for wanted, label in phrases:
                    m = len(hashed) - len(wanted) + 1
                    if m <= 0:
                        continue
                    at = np.flatnonzero(hashed[:m] == wanted[0])
                    for j in range(1, len(wanted)):
                        at = at[(hashed[at + j] == wanted[j])]
                    at = at[rows[at] == rows[at + len(wanted) - 1]]
                    row, place = row0 + rows[at], at - begin[rows[at]]
                    np.add.at(n_base, row, 1)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    for r in np.unique(row):
                        base[r].add(label)
                walked = np.zeros(len(counts), bool)
                walked[rows[member(hashed, needed)]] = True
                can = walked[rows] & member(hashed, anchor_hashes) if len(rows) else np.zeros(0, bool)
                for r in np.unique(rows[can]):
                    lo, hi = begin[r], begin[r] + counts[r]
                    text = [own[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[lo:hi], stops[lo:hi], strict=True)]
                    for label, automaton in automata.items():
                        done = 0
                        for i in np.flatnonzero(can[lo:hi]).tolist():
                            if i >= done and text[i] in automaton.firsts and (end := automaton.accepts(text, i)) > 0:
                                spans[row0 + r].append({"label": label.lower(), "first": i, "end": end})
                                done = end
            none = last < 0
            labels = [sorted(b | {s["label"] for s in own}) for b, own in zip(base, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(x) for x in labels]),
                    pa.array([1.0 if s else 0.5 if b else 0.0 for b, s in zip(base, spans, strict=True)]),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>")
    return out.withColumnRenamed("id", id_col)
