"""Embedding near-duplicates by product quantisation with inverted lists.

Vectors are normalised and put in the inverted list of their nearest coarse
centroid; what is left (the residual) is coded by the nearest codeword in each
subspace. A vector is compared with the lists that it probes: one table of
distances between its residual parts and all codewords gives the distance to
any coded vector by lookups (asymmetric distances). The triangle inequality
with each code's own error keeps every vector that could be near enough, and
the exact cosine in double precision decides.

Probes: a link's partner lies within r = sqrt(2 - 2 cos) and, off in no
particular direction, moves only about r / sqrt(d) towards any one other
centroid. A list is probed if the boundary towards it is within ``reach`` such
steps; a pair is missed only if both vectors fail to probe the other's list.
Recall is measured against brute force in the tests (1.0 there).

How it holds at scale: equal vectors are one row that carries their number.
Centroids and codewords are fitted on a bounded sample (``sample`` vectors), with
a list for every sqrt(n) vectors and LISTS at most, so the model shipped with
tasks has a bounded size; every vector is indexed. Vectors travel in the width
that they are stored in. A list is compared in square blocks dealt by hash, so a
hot list becomes many small tasks and none holds it whole. A block returns a row
a vector (its links counted, and one spanning edge), not its pairs. From about
LISTS**2 vectors on the lists themselves grow, and with them the work a vector.

Defined results: only vectors of one length are compared; each length that more
than SMALL different vectors have gets an index of its own, the others are
compared directly, a task a length. Vectors that are null, empty, zero, or hold
null or non-finite components have no links and are their own component.
Components are scaled by a power of two before they are squared, so none is too
large or too small. Repeated rows link with each other. A null id keeps its row
and its links; it is kept (``kept``) unless its component has an id. An empty
table gives no rows. Columns other than id and vector pass unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import cut, drop

BLOCK = 8192  # rows of a block at most, and BLOCK_CELLS components
BLOCK_CELLS = 1 << 22
LISTS = 16_384
SMALL = 2048
PARTS = 16
WORDS = 64


def _read(values: list, ids: pa.Array, width: str) -> pa.RecordBatch:
    """Per vector whether it can link, its length, the hash of its components, and these scaled to a largest of 0.5 to 1."""
    ok, size, key, raw = [], [], [], []
    for v in values:
        x = np.array([np.nan if c is None else c for c in v], np.float64) if v is not None and None in v else np.asarray(v if v is not None else [], np.float64)
        x = x + 0.0  # one zero
        ok.append(bool(len(x) and np.isfinite(x).all() and x.any()))
        size.append(len(x))
        raw.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype(width).tobytes() if ok[-1] else None)
        key.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
    return pa.RecordBatch.from_arrays([ids, pa.array(ok, pa.bool_()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(raw, pa.binary())], ["id", "ok", "size", "key", "raw"])


def _load(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _read(batch.column(1).to_pylist(), batch.column(0), width)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = _squares(x[lo : lo + 4096], centers).argmin(1)
    return out


class Index:
    """Coarse centroids, subspace codewords, and the rules of probing and comparing."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, reach: float, parts: int = PARTS, words: int = WORDS, seed: int = 5):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        self.cosine, self.radius = cosine, float(np.sqrt(2 - 2 * cosine)) + 1e-9
        self.margin = reach * self.radius / np.sqrt(x.shape[1])
        self.centers = _kmeans(x, min(lists, len(x)), rng)
        self.between = np.sqrt(_squares(self.centers, self.centers))
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        rest = x - self.centers[_nearest(x, self.centers)]
        self.words = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(words, len(x)), rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and the lists that it probes as booleans."""
        far = _squares(x, self.centers)
        home = far.argmin(1)
        beyond = far - far[np.arange(len(x)), home][:, None]
        return home, beyond <= 2 * self.between[home] * self.margin

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - self.centers[home]
        codes, back = np.zeros((len(x), len(self.words)), np.uint8), np.zeros_like(rest)
        for m, words in enumerate(self.words):
            a, b = self.cuts[m], self.cuts[m + 1]
            codes[:, m] = _squares(rest[:, a:b], words).argmin(1)
            back[:, a:b] = words[codes[:, m]]
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def possible(self, lists: int, queries: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, coded vector) pairs of a list that asymmetric distances don't rule out, some queries at a time."""
        rest = queries - self.centers[lists]
        tables = [_squares(rest[:, self.cuts[m] : self.cuts[m + 1]], words).astype(np.float32) for m, words in enumerate(self.words)]
        limit = ((self.radius + errors) ** 2 + 1e-4).astype(np.float32)
        for lo in range(0, len(queries), 128):
            away = np.zeros((min(128, len(queries) - lo), len(codes)), np.float32)
            for m, table in enumerate(tables):
                away += table[lo : lo + 128][:, codes[:, m]]
            q, x = np.nonzero(away <= limit)
            if len(q):
                yield q + lo, x


def _matrix(blobs: pa.Array, width: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), width).reshape(len(blobs), -1).astype(np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Links:
    """Links among the rows of a block: how many each has, and a root for each component."""

    def __init__(self, mult: np.ndarray):
        self.mult, self.links, self.root = mult, np.zeros(len(mult), np.int64), np.arange(len(mult))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.links, a, self.mult[b])
        np.add.at(self.links, b, self.mult[a])
        edges = np.unique(np.minimum(self.root[a], self.root[b]) * len(self.root) + np.maximum(self.root[a], self.root[b]))
        a, b = edges // len(self.root), edges % len(self.root)
        while True:
            new = self.root.copy()
            np.minimum.at(new, new[a], self.root[b])
            np.minimum.at(new, new[b], self.root[a])
            while (new[new] != new).any():
                new = new[new]
            if (new == self.root).all():
                return
            self.root = new

    def rows(self, keys: np.ndarray) -> pa.Table:
        """A row for each key with a link; a key may occur more than once."""
        met = np.flatnonzero(self.links)
        return pa.table({"key": pa.array(keys[met], pa.int64()), "root": pa.array(keys[self.root[met]], pa.int64()), "links": pa.array(self.links[met], pa.int64())})


def _dealt(index: Index, width: str, homes: dict[int, int], queries: dict[int, int]):
    """One row for each block that a vector is in, as one of the list or as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                key, mult, raw = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                x = _unit(_matrix(raw, width))
                home, probes = index.homes(x)
                codes, errors = index.code(x, home)
                salt = key.view(np.uint64) >> np.uint64(32)
                row, lists, hb, qb, query = [], [], [], [], []
                for i, c in zip(*np.nonzero(probes), strict=True):
                    for b in range(homes.get(c, 0)):
                        row.append(i), lists.append(c), hb.append(b), qb.append(int(salt[i]) % queries[c]), query.append(True)
                for i, c in enumerate(home):
                    for b in range(queries.get(c, 0)):
                        row.append(i), lists.append(c), hb.append(int(salt[i]) % homes[c]), qb.append(b), query.append(False)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array(hb, pa.int32()), pa.array(qb, pa.int32()), pa.array(query, pa.bool_()), batch.column(0).take(take), mult.take(take), pa.array(home, pa.int32()).take(take), raw.take(take)],
                    ["list", "hb", "qb", "query", "key", "mult", "home", "raw"],
                )

    return run


def _compared(index: Index, width: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy()
        h, q = table.filter(pa.array(~query)), table.filter(pa.array(query))
        hkey, qkey, qhome = h.column("key").to_numpy(), q.column("key").to_numpy(), q.column("home").to_numpy()
        keys = np.concatenate([hkey, qkey])
        links = Links(np.concatenate([h.column("mult").to_numpy(), q.column("mult").to_numpy()]))
        if not len(h) or not len(q):
            return links.rows(keys)
        c = table.column("list")[0].as_py()
        hx, qx = _matrix(h.column("raw").combine_chunks(), width), _matrix(q.column("raw").combine_chunks(), width)
        hu = _unit(hx)
        codes, errors = index.code(hu, np.full(len(hu), c))
        for qi, hi in index.possible(c, _unit(qx), codes, errors):
            keep = np.where(qhome[qi] == c, qkey[qi] > hkey[hi], True)
            qi, hi = qi[keep], hi[keep]
            keep = np.zeros(len(qi), bool)
            for lo in range(0, len(qi), 50_000):
                keep[lo : lo + 50_000] = _cosines(qx[qi[lo : lo + 50_000]], hx[hi[lo : lo + 50_000]]) >= index.cosine
            qi, hi = qi[keep], hi[keep]
            # A pair of two lists is met in both if each probes the other's; the smaller list then has it.
            away = np.flatnonzero((qhome[qi] != c) & (qhome[qi] < c))
            if len(away):
                own, at = np.unique(hi[away], return_inverse=True)
                _, probes = index.homes(hu[own])
                twice = away[probes[at, qhome[qi[away]]]]
                qi, hi = np.delete(qi, twice), np.delete(hi, twice)
            if len(qi):
                links.add(hi, len(hkey) + qi)
        return links.rows(keys)

    return run


def _direct(cosine: float, width: str):
    """All pairs of at most SMALL vectors of one length."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("raw").combine_chunks(), width)
        links = Links(table.column("mult").to_numpy())
        for i in range(len(x) - 1):
            j = np.flatnonzero(_cosines(x[i + 1 :], x[i : i + 1]) >= cosine) + i + 1
            if len(j):
                links.add(np.full(len(j), i), j)
        return links.rows(table.column("key").to_numpy())

    return run


def _indexed(classes: DataFrame, n: int, size: int, width: str, cosine: float, sample: int, reach: float) -> DataFrame:
    """(key, root, links) of the links among ``n`` different vectors of one length."""
    share = min(1.0, sample / n)
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("key").select("raw").toArrow().column(0).combine_chunks()
    index = Index(_matrix(drawn, width), max(1, min(LISTS, int(np.sqrt(n)))), cosine, reach)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = len(index.centers)
        homes, queries = np.zeros((2, lists), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                home, probes = index.homes(_unit(_matrix(batch.column(0).slice(lo, 1024), width)))
                homes += np.bincount(home, minlength=lists)
                queries += probes.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists), pa.int32()), pa.array(homes), pa.array(queries)], ["list", "homes", "queries"])

    block = max(256, min(BLOCK, BLOCK_CELLS // size))
    counts = classes.select("raw").mapInArrow(sized, "list int, homes long, queries long").groupBy("list").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries")).collect()
    homes = {r["list"]: -(-r["homes"] // block) for r in counts if r["homes"]}
    queries = {r["list"]: -(-r["queries"] // block) for r in counts if r["homes"]}
    dealt = classes.select("key", "mult", "raw").mapInArrow(_dealt(index, width, homes, queries), "list int, hb int, qb int, query boolean, key long, mult long, home int, raw binary")
    return cut(dealt.groupBy("list", "hb", "qb").applyInArrow(_compared(index, width), "key long, root long, links long"))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, sample: int = 65_536, reach: float = 4.0) -> DataFrame:
    """Per vector its id, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept`` (it is that id)."""
    width = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_load(width), "id long, ok boolean, size int, key long, raw binary")
    own = cut(own)
    classes = cut(own.where("ok").groupBy("size", "key").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("raw").alias("raw")))
    counts = classes.groupBy("size").agg(F.count("*").alias("n")).where("n > 1")
    few = classes.join(counts.where(f"n <= {SMALL}").select("size"), "size").select("size", "key", "mult", "raw")
    met = [few.groupBy("size").applyInArrow(_direct(cosine, width), "key long, root long, links long")]
    for r in counts.where(f"n > {SMALL}").orderBy("size").collect():
        met.append(_indexed(classes.where(F.col("size") == r["size"]), r["n"], r["size"], width, cosine, sample, reach))
    all_met = cut(reduce(DataFrame.unionAll, met))
    drop(*met[1:])
    links = all_met.groupBy("key").agg(F.sum("links").alias("links"))
    label = components(all_met.where("key <> root").select("key", "root"), "key", "root").withColumnRenamed("node", "key")
    named = classes.select("key", "id", "mult").join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").join(links, "key", "left")
    named = cut(named.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    drop(all_met, label, classes)
    out = own.select("id", F.when(F.col("ok"), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
