"""Quality rules by line-first cleaning, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); failing
lines are removed, and a document that loses too much of its text is rejected.
Everything is one projection over the scan: no shuffle, no Python, and memory
bounded by a document.

Defined results: a null text counts as empty; a text without a word has all
counts 0, ``base_failed`` true and ``kept`` false. Repeated rows each keep a
row, ties cannot occur, very long texts are judged whole, an empty table gives
no rows, and columns other than id and text pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
PHRASE_WORDS = 40

#: Phrases of page furniture; a line that has one is boilerplate. Fixed values.
BOILERPLATE = ["accept cookies", "all rights reserved", "click here", "cookie policy", "privacy policy", "sign up for our newsletter", "subscribe to our", "terms of use", "terms of service", "enable javascript", "lorem ipsum"]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _count_of(text: Column, others: str) -> Column:
    """Characters that ``others``, a class of all but them, leaves: whole runs go at once."""
    return F.length(F.regexp_replace(text, f"{others}+", ""))


def _repeats(hashes: str) -> Column:
    """Words in WINDOW-word windows that occur twice or more: the sorted windows' neighbours tell which."""
    many = F.expr(f"size({hashes}) > size(array_distinct({hashes}))")
    ordered = F.expr(f"sort_array(transform({hashes}, (h, i) -> struct(h, i)))")
    return F.when(many, ordered)


def _covered(column: str) -> Column:
    again = f"filter({column}, (x, i) -> get({column}, i - 1).h <=> x.h or get({column}, i + 1).h <=> x.h)"
    return F.expr(f"sort_array(transform({again}, x -> x.i))")


def line_fails(line: Column, max_symbols: float = 0.2, max_bars: float = 0.3, max_caps: float = 0.6, min_distinct: float = 0.25) -> Column:
    """Whether a line is to be removed.

    Punctuation: more than ``max_symbols`` symbols other than ``|`` a word, or three words or more of which capitals are
    over ``max_caps`` of the letters. Navigation: three words or more with over ``max_bars`` bars a word, or one or two
    words without closing punctuation. Boilerplate: a phrase of :data:`BOILERPLATE` in a line of at most PHRASE_WORDS words,
    or, from ten words on, a share of distinct words below ``min_distinct`` and fewer of them than twice the root of all:
    in prose their share falls with length, but their number keeps above that root.
    """
    words = split_words(line)
    n = F.size(words)
    symbols = _count_of(line, "[^#*$%&<>]")
    bars = _count_of(line, "[^|]")
    letters = _count_of(line, r"[^\p{L}]")
    capitals = _count_of(line, r"[^\p{Lu}]")
    punctuation = (symbols > max_symbols * n) | ((n >= 3) & (capitals > max_caps * letters))
    navigation = ((n >= 3) & (bars > max_bars * n)) | ((n < 3) & ~line.rlike(r"[.!?:;,\"')\]]\s*$"))
    distinct = F.size(F.array_distinct(words))
    boilerplate = ((n <= PHRASE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))) | ((n >= 10) & (distinct < min_distinct * n) & (distinct * distinct < 4 * n))
    return punctuation | navigation | boilerplate


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5) -> DataFrame:
    """Per document its counts, ``base_failed``, ``kept_chars`` (word characters of the lines that stay), ``kept`` and ``clean_text``.

    ``kept`` is false when the base rules fail or when the removed lines hold more than ``max_loss`` of the word characters.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = base.withColumns({"words": split_words(F.col("text")), "lines": F.split("text", "\n")})
    hashed = split.withColumns({
        "n_words": F.size("words").cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "full": F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _count_of(F.col("text"), f"[^{SYMBOLS}]").cast("long"),
    }).drop("words", "lines")
    windows = hashed.withColumns({
        "windows": F.expr(f"if(size(hashes) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, size(hashes) - {WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW}))))"),
        "n_dup_lines": F.expr("cast(size(full) - size(array_distinct(full)) as bigint)"),
        "kept_lines": F.filter("full", lambda x: ~line_fails(x)),
    }).drop("hashes", "full")
    ordered = windows.withColumn("ordered", _repeats("windows")).drop("windows")
    placed = ordered.withColumn("places", _covered("ordered")).drop("ordered")
    counted = placed.withColumns({
        "n_repeat_words": F.expr(f"cast(coalesce(aggregate(transform(places, (p, j) -> least({WINDOW}, coalesce(get(places, j + 1), p + {WINDOW}) - p)), 0, (a, b) -> a + b), 0) as bigint)"),
        "clean_text": F.array_join("kept_lines", "\n"),
    }).drop("places", "kept_lines")
    judged = counted.withColumns({
        "kept_chars": _count_of(F.col("clean_text"), BLANKS[:-1]).cast("long"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    kept = ~F.col("base_failed") & (F.col("word_chars") - F.col("kept_chars") <= max_loss * F.col("word_chars"))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "kept_chars", "clean_text")
