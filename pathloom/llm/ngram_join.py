"""N-gram Jaccard join: documents whose sets of k-word shingles overlap enough.

A document is a row of the sparse document-by-shingle matrix. Candidate pairs
come from blocks of that matrix (the postings of one shingle), pairs that the
set sizes rule out are discarded before any product is formed, and the overlap
counts of the rest are accumulated block by block as a sparse row product.

How it holds at scale
* Documents with equal sets are one row, known by a 64-bit fingerprint; copies
  are never expanded.
* Only the prefix of a set, ``n - ceil(t n) + 1`` shingles in one global order,
  is posted: two sets of similarity t share a shingle there. The order puts
  frequent shingles last, so passages that many documents share are posted only
  by documents that consist of little else. "Frequent" is decided by exact
  counts over all documents; at most 2**22 shingles of 32 bits are broadcast,
  because the limit rises with the number of occurrences.
* Posted shingles travel as packed arrays; those of a single set end there.
* First, in rounds that go on while they link, each set is compared with a few
  others of its lists, the least edited one among them (linear), and links are
  joined into components. The exact join that follows pairs only sets of
  different components, so a group of near copies never becomes all of its
  pairs; a set just outside a group is still paired with those of its members
  that the bounds admit. It counts shared prefix shingles and discards pairs
  whose count plus what lies behind the prefix stays below the bound.
* Occurrences of a shingle are counted per batch before they travel; postings
  of frequent shingles are dealt by set and shingle, so no task holds the list
  of one. Joins on hot keys are plain equi-joins, which AQE splits.

Hashes: a set is known by 64 bits (two of N different sets meet with a chance
of N**2 / 2**65); overlaps of whole sets are counted on 48 bits of each shingle
(an overlap of n and m shingles is one too large with a chance of n m / 2**48).

Defined results: null or empty texts, and texts without a word, have
``n_shingles`` 0, link with nothing and are their own component; a null id
keeps its row. Repeated rows each keep a row, very long texts are read whole,
an empty table gives no rows. Columns other than id and text pass unseen, so
none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import components
from .store import cut, drop

BUCKETS = 1024  # of 22 bits each, for counting 32-bit shingle prefixes
MIN_FREQUENT = 12
MAX_FREQUENT = 1 << 22
POSTING = np.dtype([("sh", "<u4"), ("fp", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("last", "<u4"), ("late", "<u4")])
COMPARED = 64  # in longer lists every posting counts as having a possible partner
PER_BLOCK = 400_000
ROUNDS = 8
YIELD = 200  # a round in which fewer comparisons than one in so many link is the last
DRAWS = 4
SHORT = 48  # bits of a shingle in whole sets


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows' set sizes, row of each shingle, shingle) for each piece of a column."""
    for first, own, offsets in W.pieces(column):
        own = W.LOWER[own]
        starts, stops, rows = W.spans(own, offsets, W.BLANK)
        row, sh = W.shingles(W.hashes(own, starts, stops), rows, k)
        yield first, np.bincount(row, minlength=len(offsets) - 1), row, sh


def _prints(sizes: np.ndarray, row: np.ndarray, sh: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's set."""
    total = np.zeros(len(sizes), W.U)
    ends = np.cumsum(sizes)
    sums = np.r_[W.U(0), np.cumsum(W.mix(sh + W.U(0x1234567)), dtype=W.U)]
    total = sums[ends] - sums[ends - sizes]
    return W.mix(total + sizes.astype(W.U))


def _scan(k: int):
    """Per document its size and fingerprint (bucket -1); per bucket the sorted low bits of all shingles as deltas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, tops = [], [], []
            for _, n, row, sh in _sets(batch.column(1), k):
                sizes.append(n)
                prints.append(_prints(n, row, sh))
                tops.append((sh >> W.U(32)).astype(np.uint32))
            if not sizes:
                continue
            yield _rows(batch.column(0), np.full(len(batch), -1), np.concatenate(sizes), np.concatenate(prints).view(np.int64), None)
            top, df = np.unique(np.concatenate(tops), return_counts=True)
            cuts = np.searchsorted(top, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(22))
            own, blobs = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                own.append(b)
                blobs.append(_counted(top[cuts[b] : cuts[b + 1]] & np.uint32((1 << 22) - 1), df[cuts[b] : cuts[b + 1]]))
            none = pa.nulls(len(own), pa.int64())
            yield _rows(none, np.array(own, np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), blobs)

    return run


def _counted(low: np.ndarray, df: np.ndarray) -> bytes:
    """Sorted distinct numbers as deltas, then the places and counts of those that occur more than once."""
    step = np.diff(low, prepend=np.uint32(0))
    width = 2 if step.max() < 1 << 16 else 4
    more = np.flatnonzero(df > 1)
    return np.array([width, len(low)], "<u4").tobytes() + step.astype(f"<u{width}").tobytes() + more.astype("<u4").tobytes() + df[more].astype("<u4").tobytes()


def _recounted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = np.frombuffer(blob, "<u4", 2).tolist()
    more = np.frombuffer(blob, "<u4", offset=8 + width * n).reshape(2, -1)
    df = np.ones(n, np.int64)
    df[more[0]] = more[1]
    return np.cumsum(np.frombuffer(blob, f"<u{width}", n, 8), dtype=np.uint32), df


def _rows(ids, bucket, n, fp, blobs) -> pa.RecordBatch:
    columns = [ids, pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(blobs, pa.binary()) if blobs is not None else pa.nulls(len(n), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "bucket", "n", "fp", "blob"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the 32-bit prefixes of a bucket: sorted while they are few, in 2**22 dense counters beyond."""
    now, waiting, held, counts = -1, [], 0, None

    def frequent():
        if counts is None:
            all_low, own = np.concatenate([x for x, _ in waiting]), np.concatenate([n for _, n in waiting])
            low, at = np.unique(all_low, return_inverse=True)
            df = np.bincount(at, own).astype(np.int64)
        else:
            for x, n in waiting:
                counts[x] += n
            low = np.flatnonzero(counts)
            df = counts[low]
        keep = df >= MIN_FREQUENT
        return pa.RecordBatch.from_arrays([pa.array((now << 22) + low[keep].astype(np.int64), pa.int64()), pa.array(df[keep], pa.int64())], ["top", "df"])

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now:
                if now >= 0:
                    yield frequent()
                now, waiting, held, counts = bucket, [], 0, None
            waiting.append(_recounted(blob))
            held += len(waiting[-1][0])
            if held > 1 << 22:
                counts = np.zeros(1 << 22, np.int64) if counts is None else counts
                for x, n in waiting:  # distinct in each
                    counts[x] += n
                waiting, held = [], 0
    if now >= 0:
        yield frequent()


def _post(k: int, num: int, den: int, frequent: np.ndarray, bits: int):
    """The prefixes of all sets as packed postings: by the top ``bits`` bits of the shingle, frequent ones by set and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, posts = [], []
            for _, sizes, row, sh in _sets(batch.column(0), k):
                if not len(sh):
                    continue
                prints = _prints(sizes, row, sh)
                top = (sh >> W.U(32)).astype(np.uint32)
                if len(frequent):
                    rank = np.minimum(np.searchsorted(frequent, top), len(frequent) - 1)
                    late = frequent[rank] == top
                    order = np.lexsort((sh, late, row))
                    sh, rank, late = sh[order], rank[order], late[order]
                else:
                    rank, late = np.zeros(len(sh), np.int64), np.zeros(len(sh), bool)
                ends = np.cumsum(sizes)
                pos = np.arange(len(sh)) - (ends - sizes)[row]
                prefix = sizes - (sizes * num + den - 1) // den + 1
                keep = pos < prefix[row]
                last = (sh >> W.U(33)).astype(np.uint32)  # the order's key, to 32 bits
                last |= late.astype(np.uint32) << np.uint32(31)
                last = last[np.maximum(0, ends - sizes + prefix - 1)[row]]
                lates = np.bincount(row[keep], late[keep], len(sizes)).astype(np.int64)  # of a prefix
                sh, rank, late, row = sh[keep], rank[keep], late[keep], row[keep]
                post = np.zeros(len(sh), POSTING)
                post["sh"] = np.where(late, rank, ((sh << W.U(bits)) >> W.U(32)).astype(np.int64))
                post["fp"], post["n"], post["pos"], post["last"] = prints[row], sizes[row], pos[keep], last[keep]
                post["late"] = lates[row] << 1 | late
                tops.append((np.where(late, W.mix(sh ^ prints[row]), sh) >> W.U(64 - bits)).astype(np.int32))
                posts.append(post)
            if not posts:
                continue
            top, post = np.concatenate(tops), np.concatenate(posts)
            order = np.lexsort((post["fp"], post["sh"], post["late"] & 1, top))
            top, post = top[order], post[order]
            if len(post):  # equal sets in one batch are one posting
                keep = np.r_[True, (top[1:] != top[:-1]) | _differ(post)]
                top, post = top[keep], post[keep]
            cuts = np.searchsorted(top, np.arange((1 << bits) + 1))
            own = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([post[cuts[b] : cuts[b + 1]].tobytes() for b in own], pa.binary())], ["block", "blob"])

    return run


def _differ(post: np.ndarray) -> np.ndarray:
    """Whether a posting is another than the one before: of another set, shingle or kind."""
    return (post["sh"][1:] != post["sh"][:-1]) | (post["fp"][1:] != post["fp"][:-1]) | ((post["late"][1:] ^ post["late"][:-1]) & 1 > 0)


def _possible(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the set sizes allow a link."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return (den * na >= num * nb) & (den * nb >= num * na)


def _shared(num: int, den: int):
    """Of one block's postings, those with a possible partner under the same shingle; frequent shingles have one."""

    def lists(block: int, blobs: list[bytes]) -> pa.RecordBatch:
        post = np.concatenate([np.frombuffer(b, POSTING) for b in blobs])
        post = post[np.lexsort((post["fp"], post["sh"], post["late"] & 1))]
        post = post[np.r_[True, _differ(post)]]
        late = (post["late"] & 1).astype(bool)
        first = np.flatnonzero(np.r_[True, (post["sh"][1:] != post["sh"][:-1]) | (late[1:] != late[:-1])])
        size = np.diff(np.r_[first, len(post)])
        rep, size = np.repeat(first, size), np.repeat(size, size)
        keep = late | (size > COMPARED)
        at = np.flatnonzero((size > 1) & ~keep)
        for step in range(1, COMPARED):
            at = at[at + step < rep[at] + size[at]]
            if not at.size:
                break
            both = _possible(post[at], post[at + step], num, den)
            keep[at[both]] = keep[at[both] + step] = True
        post, late = post[keep], late[keep]
        columns = [np.where(late, -1 - post["sh"].astype(np.int64), (np.int64(block) << 32) + post["sh"].astype(np.int64)), post["fp"].view(), *(post[c].astype(np.int64) for c in ("n", "pos", "last")), (post["late"] >> 1).astype(np.int64), (post["late"] & 1).astype(np.int64)]
        columns = [np.ascontiguousarray(c).view(np.int64) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sh", "fp", "n", "pos", "last", "lates", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if blobs:
                        yield lists(now, blobs)
                    now, blobs = block, []
                blobs.append(blob)
        if blobs:
            yield lists(now, blobs)

    return run


def _bloom_bits(spread, bits: int):
    """Three positions of a fingerprint in a filter of 2**bits bits; ``spread`` is the fingerprint as uint64."""
    return [(W.mix(spread + W.U(i * 0x9E3779B9)) >> W.U(64 - bits)).astype(np.int64) for i in (1, 2, 3)]


def _bloom(fps: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the fingerprints as booleans packed in bytes; never more than 2**27 bits, beyond which it only lets more through."""
    bits = min(27, max(13, int(count * 12).bit_length()))

    def run(batches):
        for batch in batches:
            own = np.unique(np.concatenate(_bloom_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            word, first = np.unique(own >> 5, return_index=True)
            value = np.add.reduceat(np.int64(1) << (own & 31), first) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value, pa.int64())], ["word", "value"])

    rows = fps.mapInArrow(run, "word long, value long").groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[rows.column(0).to_numpy().astype(np.int64)] = rows.column(1).to_numpy().astype(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little") if bits <= 20 else out


def _fetch(k: int, bloom: np.ndarray):
    """The sets (SHORT bits a shingle, sorted) of the documents in the filter, equal sets of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = bloom.dtype == np.uint8
        bits = (len(bloom) if flat else 32 * len(bloom)).bit_length() - 1
        for batch in batches:
            found: dict[int, bytes] = {}
            for _, sizes, row, sh in _sets(batch.column(0), k):
                prints = _prints(sizes, row, sh)
                have = sizes > 0
                for at in _bloom_bits(prints, bits):
                    have &= (bloom[at] if flat else (bloom[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
                ends = np.cumsum(sizes)
                for i in np.flatnonzero(have):
                    if (fp := int(prints[i])) not in found:
                        own = np.sort(sh[ends[i] - sizes[i] : ends[i]] & W.U((1 << SHORT) - 1))
                        found[fp] = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SHORT // 8].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), W.U).view(np.int64)), pa.array(found.values(), pa.binary())], ["fp", "blob"])

    return run


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) // (SHORT // 8) for b in blobs])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, : SHORT // 8] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, SHORT // 8)
    return sizes, wide.view("<u8").ravel()


def _verify(num: int, den: int, step: int = 2000):
    """The pairs whose overlap is large enough: row products of blocks of pairs, accumulated by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                na, a = _unpack(part.column(2).to_pylist())
                nb, b = _unpack(part.column(3).to_pylist())
                pair = [np.repeat(np.arange(len(part), dtype=np.uint64) << W.U(SHORT), n) for n in (na, nb)]
                both = np.sort(np.concatenate([a + pair[0], b + pair[1]]))
                met = both[1:][both[1:] == both[:-1]] >> W.U(SHORT)
                overlap = np.bincount(met.astype(np.int64), minlength=len(part))
                keep = den * overlap >= num * (na + nb - overlap)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of fingerprints that are links, by whole sets."""
    first = pairs.join(sets.select(F.col("fp").alias("a"), F.col("blob").alias("set_a")), "a")
    both = first.join(sets.select(F.col("fp").alias("b"), F.col("blob").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(num, den), "a long, b long")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def ngram_join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    A link: ``den * |A & B| >= num * |A | B|`` over distinct k-word shingles of
    the lower-cased (A-Z) text; a text of fewer words is one shingle.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = cut(texts.mapInArrow(_scan(k), "id long, bucket int, n long, fp long, blob binary"))
    own = cut(scan.where("bucket = -1").select("id", "n", "fp"))
    total, own_rows = own.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    counted = scan.where("bucket >= 0").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "top long, df long")
    limit = max(MIN_FREQUENT, -(-total // MAX_FREQUENT))  # so at most MAX_FREQUENT shingles reach it
    frequent = np.sort(counted.where(F.col("df") >= limit).select("top").toArrow().column(0).to_numpy().astype(np.uint32))
    drop(scan)

    bits = max(4, min(31, (total // 4 // PER_BLOCK).bit_length()))
    packed = texts.select("text").mapInArrow(_post(k, num, den, frequent, bits), "block int, blob binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << bits)
    lists = cut(packed.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_shared(num, den), "sh long, fp long, n long, pos long, last long, lates long, late long"))

    posted = cut(lists.select("fp").distinct())
    sets = cut(texts.select("text").mapInArrow(_fetch(k, _bloom(posted, posted.count())), "fp long, blob binary").groupBy("fp").agg(F.first("blob").alias("blob")))
    drop(posted)

    def mixed(label: DataFrame | None) -> DataFrame:
        """The lists that hold sets of different components, with these."""
        named = lists.withColumn("root", F.col("fp"))
        if label is not None:
            named = lists.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        both = named.groupBy("sh").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sh")
        return cut(named.join(both, "sh"))

    # First a few rounds in which DRAWS sets stand for each list, the one with most frequent shingles in its prefix (the
    # least edited of a group of near copies) and others drawn anew each time, and each set is compared with those of
    # another component that stand for most of its lists. They go on while comparisons link.
    found, label = [], None
    for turn in range(ROUNDS):
        named = mixed(label)
        row = lambda i: F.struct(F.lit(i).alias("draw"), F.col("fp").alias("other"), F.col("root").alias("its"), F.col("n").alias("size"))
        drawn = [F.max_by(row(0), F.struct("lates", F.xxhash64("fp", F.lit(turn)))), *(F.min_by(row(i), F.xxhash64("fp", F.lit(turn), F.lit(i))) for i in range(1, DRAWS))]
        chosen = named.groupBy("sh").agg(F.array(*drawn).alias("drawn")).select("sh", F.inline("drawn"))
        beside = named.join(chosen, "sh").where(f"root <> its and {den} * n >= {num} * size and {den} * size >= {num} * n")
        stars = beside.groupBy("fp", "draw", "other").agg(F.count("*").alias("met"), F.max("n").alias("n")).where("16 * met >= n")
        stars = stars.groupBy("fp", "draw").agg(F.max_by("other", F.struct("met", "other")).alias("other"))
        stars = cut(stars.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct())
        links = cut(_verified(stars, sets, num, den))
        few = links.count() * YIELD < stars.count()
        drop(named, stars)
        found.append(links)
        if label is not None:
            drop(label)
        label = components(_union(found), "a", "b")
        if few:
            break

    # Then all pairs of different components. A frequent shingle pairs sets only where it can be the first they share,
    # which their positions tell. Other shared prefix shingles are counted; with the frequent ones of the prefixes, and
    # what lies behind the prefix of the set whose prefix ends first, they bound the overlap.
    named = mixed(label)
    a, b = named.alias("a"), named.alias("b")
    behind = "{0}.n - ({0}.n - ceil({0}.n * {1} / {2}) + 1)"
    rest = f"CASE WHEN a.last < b.last THEN {behind.format('a', num, den)} WHEN a.last > b.last THEN {behind.format('b', num, den)} ELSE greatest({behind.format('a', num, den)}, {behind.format('b', num, den)}) END"
    sizes = f"a.root < b.root and {den} * a.n >= {num} * b.n and {den} * b.n >= {num} * a.n"
    first = f"(a.late = 0 or {num + den} * least(a.n - a.pos, b.n - b.pos) >= {num} * (a.n + b.n))"
    cross = a.join(b, F.expr(f"a.sh = b.sh and {sizes} and {first}")).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.expr("a.n + b.n").alias("n"), F.expr(f"{rest} + least(a.lates, b.lates)").alias("rest"), F.expr("1 - a.late").alias("rare"))
    cross = cross.groupBy("a", "b").agg(F.sum("rare").alias("met"), F.max("n").alias("n"), F.max("rest").alias("rest"))
    cross = cut(cross.where(f"{num + den} * (met + rest) >= {num} * n").select("a", "b"))
    links = cut(_verified(cross, sets, num, den))
    if not links.isEmpty():
        found.append(links)
        drop(label)
        label = components(_union(found), "a", "b")

    # Names of components: the smallest id of any member.
    classes = own.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"))
    joined = classes.join(label.select(F.col("node").alias("fp"), "root"), "fp")
    roots = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    names = joined.join(roots, "root").select("fp", F.col("component_id").alias("joined_id"))
    names = cut(classes.join(names, "fp", "left").select("fp", F.coalesce("joined_id", "id").alias("component_id")))
    drop(lists, named, cross, sets, label, *found)
    return (
        own.join(names, (own["fp"] == names["fp"]) & (own["n"] > 0), "left")
        .select(own["id"].alias(id_col), own["n"].alias("n_shingles"), F.coalesce(names["component_id"], own["id"]).alias("component_id"))
    )
