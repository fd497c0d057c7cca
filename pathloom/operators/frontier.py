"""Exact counts of paths and cycles through every vertex by a dataflow over frontier states.

A state says for each frontier vertex (slot) whether it is fresh (0), inside a
segment (-1), or the end of segment L (L > 0; L twice: both ends are here, once:
the other end has left for good), and whether one path is closed (``nc``). The
state table is (key, cnt); a step introduces a vertex, branches over its back
edges, drops the vertices that leave, and ends in GROUP BY key SUM(cnt). Counts
are DECIMAL(38, 0): a sum that does not fit is an error.

Three physical forms with equal results:

* ``native``: array states, built-in expressions only, no limit on width;
* ``packed``: BIGINT keys of 4 bits a slot (up to 15), numpy in ``mapInArrow``
  with a partial sum for each batch before the exchange;
* ``local``: the packed step on the driver, for tables below ``local_rows``,
  where a Spark round would cost more than its work.

``auto`` is packed, local while small. States that cannot finish are dropped
early: more than two path ends fixed, or a closed path before the last step.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ordering as O

DECIMAL = "decimal(38,0)"
LIMB = 30
LIMBS = 5
SLOTS = 15


@dataclass(frozen=True)
class Step:
    k: int
    vertex: int
    back: tuple[int, ...]  # slots of earlier neighbours in the frontier, by vertex
    leave: tuple[int, ...]  # slots that end here, largest first
    width: int  # slots while the step runs
    final: bool


def steps(adj: O.Adjacency, order: list[int]) -> list[Step]:
    last, at = O.last_steps(adj, order), {v: i for i, v in enumerate(order)}
    frontier, out = [], []
    for k, v in enumerate(order):
        back = tuple(frontier.index(w) for w in adj[v] if at[w] < k)
        frontier.append(v)
        leave = tuple(i for i in range(len(frontier) - 1, -1, -1) if last[at[frontier[i]]] <= k)
        out.append(Step(k, v, back, leave, len(frontier), k == len(order) - 1))
        frontier = [x for x in frontier if last[at[x]] > k]
    return out


# --- the packed form, on arrays -------------------------------------------------------------------------------------


@dataclass
class States:
    conn: np.ndarray  # int8, a row a state
    nc: np.ndarray  # bool
    cnt: np.ndarray  # int64 limbs of LIMB bits, lowest first

    def take(self, rows) -> States:
        return States(self.conn[rows], self.nc[rows], self.cnt[rows])

    def __len__(self) -> int:
        return len(self.conn)


def first_states() -> States:
    cnt = np.zeros((1, LIMBS), np.int64)
    cnt[0, 0] = 1
    return States(np.zeros((1, 0), np.int8), np.zeros(1, bool), cnt)


def _carry(cnt: np.ndarray) -> np.ndarray:
    for i in range(LIMBS - 1):
        cnt[:, i + 1] += cnt[:, i] >> LIMB
        cnt[:, i] &= (1 << LIMB) - 1
    if len(cnt) and int(cnt[:, -1].max()) >> LIMB:
        raise OverflowError("a count is beyond 150 bits")
    return cnt


def _total(cnt: np.ndarray) -> int:
    return sum(int(c) << (LIMB * i) for i, c in enumerate(cnt.astype(object).sum(0))) if len(cnt) else 0


def canonical(conn: np.ndarray) -> np.ndarray:
    """Segment numbers by first appearance."""
    if not conn.size:
        return conn
    out, rows = conn.copy(), np.arange(len(conn))
    names = np.zeros((len(conn), int(max(conn.max(), 0)) + 1), np.int8)
    used = np.zeros(len(conn), np.int8)
    for j in range(conn.shape[1]):
        x = np.maximum(conn[:, j], 0)
        fresh = (x > 0) & (names[rows, x] == 0)
        used += fresh
        names[rows[fresh], x[fresh]] = used[fresh]
        out[:, j] = np.where(x > 0, names[rows, x], conn[:, j])
    return out


def _fixed_ends(conn: np.ndarray) -> np.ndarray:
    """How many segments have only one end in the frontier."""
    out = np.zeros(len(conn), np.int16)
    for label in range(1, int(conn.max()) + 1 if conn.size else 1):
        out += (conn == label).sum(1) == 1
    return out


def _join(s: States, i: int, j: int) -> States:
    """The states with the edge between slots i and j added, where that is legal."""
    a, b = s.conn[:, i], s.conn[:, j]
    keep = (a >= 0) & (b >= 0) & ((a != b) | (a == 0))
    s = s.take(keep)
    conn, nc = s.conn.copy(), s.nc.copy()
    a, b = conn[:, i].copy(), conn[:, j].copy()
    new = np.maximum(conn.max(1), 0) + 1 if conn.size else a
    both = (a == 0) & (b == 0)
    conn[both, i] = conn[both, j] = new[both]
    only = (a == 0) & (b > 0)
    conn[only, i], conn[only, j] = b[only], -1
    only = (a > 0) & (b == 0)
    conn[only, i], conn[only, j] = -1, a[only]
    two = np.flatnonzero((a > 0) & (b > 0))
    if len(two):
        part = conn[two]
        part[:, i] = part[:, j] = -1
        la, lb = a[two, None], b[two, None]
        part[part == lb] = np.broadcast_to(la, part.shape)[part == lb]
        conn[two] = part
        closed = ~(part == la).any(1)  # both ends had left: the path is complete
        bad = closed & (nc[two] | (part != -1).any(1))
        nc[two] |= closed
        ok = np.ones(len(conn), bool)
        ok[two[bad]] = False
        return States(conn[ok], nc[ok], s.cnt[ok])
    return States(conn, nc, s.cnt)


def _drop(s: States, i: int, final: bool) -> States:
    """The states without slot i, whose vertex has seen all its edges."""
    own = s.conn[:, i]
    rest = np.delete(s.conn, i, 1)
    last_end = (own > 0) & ~(rest == own[:, None]).any(1)
    keep = (own != 0) & (~last_end | (final & ~s.nc & (rest == -1).all(1)))
    return States(rest[keep], (s.nc | last_end)[keep], s.cnt[keep])


def _merge(s: States) -> States:
    """GROUP BY state SUM(cnt)."""
    if len(s) < 2:
        return s
    if s.conn.shape[1] <= SLOTS:
        key = pack(s.conn) << 1 | s.nc
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    else:
        rows = np.ascontiguousarray(np.c_[s.conn, s.nc.astype(np.int8)]).view(f"V{s.conn.shape[1] + 1}").ravel()
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
    cnt = _carry(np.add.reduceat(s.cnt[order], first, axis=0))
    one = order[first]
    return States(s.conn[one], s.nc[one], cnt)


def pack(conn: np.ndarray) -> np.ndarray:
    key = np.zeros(len(conn), np.int64)
    for j in range(conn.shape[1]):
        key |= (conn[:, j].astype(np.int64) + 1) << (4 * j)
    return key


def unpack(key: np.ndarray, width: int) -> np.ndarray:
    return np.stack([((key >> (4 * j)) & 15).astype(np.int8) - 1 for j in range(width)], 1) if width else np.zeros((len(key), 0), np.int8)


def advance(s: States, step: Step, prune: bool = True, merge_every: int = 4) -> tuple[States, int]:
    """The states after a step, and the cycles that close in it (at the last step)."""
    s = States(np.c_[s.conn, np.zeros(len(s), np.int8)], s.nc, s.cnt)
    here, cycles = step.width - 1, 0
    for t, slot in enumerate(step.back):
        if step.final and len(s):
            a = s.conn[:, slot]
            rest = np.delete(s.conn, [slot, here], 1)
            close = (a > 0) & (a == s.conn[:, here]) & ~s.nc & (rest == -1).all(1)
            cycles += _total(s.cnt[close])
        more = _join(s, slot, here)
        s = States(np.r_[s.conn, more.conn], np.r_[s.nc, more.nc], np.r_[s.cnt, more.cnt])
        if t % merge_every == merge_every - 1:
            s = _merge(States(canonical(s.conn), s.nc, s.cnt))
    for slot in step.leave:
        s = _drop(s, slot, step.final)
    if prune and len(s):
        s = s.take((_fixed_ends(s.conn) <= 2) & (step.final | ~s.nc))
    return _merge(States(canonical(s.conn), s.nc, s.cnt)), cycles


# --- the native form, as expressions --------------------------------------------------------------------------------


def canonical_expr(conn: str) -> str:
    return f"transform({conn}, x -> if(x <= 0, x, cast(array_position(array_distinct(filter({conn}, y -> y > 0)), x) as int)))"


def _native_join(i: int, j: int) -> str:
    """The state struct (conn, nc) with the edge (i, j), or null."""
    put = "transform(s.conn, (x, p) -> CASE WHEN p = {i} THEN {a} WHEN p = {j} THEN {b} ELSE {rest} END)"
    new = "array_max(s.conn) + 1"
    ci, cj = f"s.conn[{i}]", f"s.conn[{j}]"
    both = put.format(i=i, j=j, a=new, b=new, rest="x")
    first = put.format(i=i, j=j, a=cj, b="-1", rest="x")
    second = put.format(i=i, j=j, a="-1", b=ci, rest="x")
    two = put.format(i=i, j=j, a="-1", b="-1", rest=f"if(x = {cj}, {ci}, x)")
    left = f"exists({two}, x -> x = {ci})"
    state = "named_struct('conn', {0}, 'nc', {1})"
    return f"""CASE WHEN {ci} = -1 OR {cj} = -1 OR ({ci} = {cj} AND {ci} > 0) THEN NULL
        WHEN {ci} = 0 AND {cj} = 0 THEN {state.format(both, 's.nc')}
        WHEN {ci} = 0 THEN {state.format(first, 's.nc')}
        WHEN {cj} = 0 THEN {state.format(second, 's.nc')}
        WHEN {left} THEN {state.format(two, 's.nc')}
        WHEN s.nc = 0 AND forall({two}, x -> x = -1) THEN {state.format(two, '1')} END"""


def _native_drop(i: int, final: bool) -> str:
    rest = f"filter(s.conn, (x, p) -> p <> {i})"
    last = f"WHEN s.nc = 0 AND forall({rest}, x -> x = -1) THEN named_struct('conn', {rest}, 'nc', 1)" if final else ""
    return f"CASE WHEN s.conn[{i}] = 0 THEN NULL WHEN s.conn[{i}] = -1 OR exists({rest}, x -> x = s.conn[{i}]) THEN named_struct('conn', {rest}, 'nc', s.nc) {last} END"


def native_step(states: DataFrame, step: Step, prune: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(conn, nc, cnt) after a step, and the tables of states that close a cycle."""
    here, cycles = step.width - 1, []
    df = states.select(F.struct(F.array_append("conn", F.lit(0)).alias("conn"), "nc").alias("s"), "cnt")
    for slot in step.back:
        if step.final:
            others = f"forall(filter(s.conn, (x, p) -> p <> {slot} and p <> {here}), x -> x = -1)"
            cycles.append(df.where(f"s.conn[{slot}] > 0 and s.conn[{slot}] = s.conn[{here}] and s.nc = 0 and {others}").select("cnt"))
        df = df.select(F.expr(f"explode(array(s, {_native_join(slot, here)}))").alias("s"), "cnt").where("s is not null")
    for slot in step.leave:
        # explode keeps the optimizer from nesting one drop's expression in the next
        df = df.select(F.expr(f"explode(array({_native_drop(slot, step.final)}))").alias("s"), "cnt").where("s is not null")
    df = df.select(F.expr(canonical_expr("s.conn")).alias("conn"), F.col("s.nc").alias("nc"), "cnt")
    if prune:
        ends = "size(filter(array_distinct(conn), l -> l > 0 and size(filter(conn, x -> x = l)) = 1)) <= 2"
        df = df.where(ends if step.final else f"nc = 0 and {ends}")
    return df.groupBy("conn", "nc").agg(F.sum("cnt").cast(DECIMAL).alias("cnt")), cycles


# --- driving ----------------------------------------------------------------------------------------------------------


def _to_limbs(column: pa.Array) -> np.ndarray:
    words = np.frombuffer(column.buffers()[1], "<u4").reshape(-1, 4)[column.offset : column.offset + len(column)].astype(object)
    whole = words[:, 0] + (words[:, 1] << 32) + (words[:, 2] << 64) + (words[:, 3] << 96)
    return np.stack([((whole >> (LIMB * i)) & ((1 << LIMB) - 1)).astype(np.int64) for i in range(LIMBS)], 1)


def _to_decimal(cnt: np.ndarray) -> pa.Array:
    whole = sum((cnt[:, i].astype(object) << (LIMB * i)) for i in range(LIMBS))
    raw = b"".join(int(x).to_bytes(16, "little") for x in whole)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(cnt), [None, pa.py_buffer(raw)])


PACKED = f"key bigint, nc int, cnt {DECIMAL}"


def _batch(s: States, kind: int | None = None) -> pa.RecordBatch:
    nc = s.nc.astype(np.int32) if kind is None else np.full(len(s), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(pack(s.conn)), pa.array(nc), _to_decimal(s.cnt)], ["key", "nc", "cnt"])


def packed_step(states: DataFrame, step: Step, prune: bool = True) -> DataFrame:
    """(key, nc, cnt) after a step; rows of nc = 2 count cycles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = States(unpack(batch.column(0).to_numpy(), step.width - 1), batch.column(1).to_numpy() == 1, _to_limbs(batch.column(2)))
            s, cycles = advance(s, step, prune)
            yield _batch(s)
            if cycles:
                cnt = np.array([[cycles >> (LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS)]], np.int64)
                yield _batch(States(np.zeros((1, 0), np.int8), np.ones(1, bool), cnt), 2)

    return states.mapInArrow(run, PACKED).groupBy("key", "nc").agg(F.sum("cnt").cast(DECIMAL).alias("cnt"))


def fingerprint(adj: O.Adjacency, order: list[int]) -> str:
    """Of graph and order: what a checkpoint must agree with."""
    return hashlib.sha256(json.dumps([[v, adj[v]] for v in order]).encode()).hexdigest()


class Checkpoints:
    """States after a step as Parquet with a manifest, written whole before it is named."""

    def __init__(self, path: str, mark: str):
        self.path, self.mark = path.rstrip("/"), mark

    def _file(self, spark: SparkSession, name: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def save(self, spark: SparkSession, states: DataFrame, step: int) -> DataFrame:
        path = f"{self.path}/step-{step:04d}"
        states.write.mode("overwrite").parquet(path)
        return spark.read.schema(states.schema).parquet(path)

    def name(self, spark: SparkSession, step: int, cycles: int, seen: list[tuple]) -> None:
        manifest = spark.createDataFrame([(self.mark, step, str(cycles), json.dumps(seen))], "mark string, step int, cycles string, seen string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.path}/new-manifest")
        new, fs = self._file(spark, "new-manifest")
        old, _ = self._file(spark, "manifest")
        fs.delete(old, True)
        fs.rename(new, old)

    def load(self, spark: SparkSession) -> tuple[DataFrame, int, int, list] | None:
        """(states, step, cycles, profile) of the last whole checkpoint of the same graph and order, or None."""
        where, fs = self._file(spark, "manifest")
        if not fs.exists(where):
            return None
        got = spark.read.schema("mark string, step int, cycles string, seen string").json(f"{self.path}/manifest").first()
        if got is None or got["mark"] != self.mark:
            return None
        return spark.read.parquet(f"{self.path}/step-{got['step']:04d}"), got["step"], int(got["cycles"]), json.loads(got["seen"])


@dataclass(frozen=True)
class Counted:
    paths: int
    cycles: int
    max_fw: int
    profile: int
    steps: list[tuple]  # k, vertex, width, back edges, states in, states out
    ms: tuple[float, ...] = ()  # of each step; 0 for those that a checkpoint spared


def count(spark: SparkSession, adj: O.Adjacency, order: list[int] | None = None, form: str = "auto", local_rows: int = 200_000, prune: bool = True, checkpoint: str | None = None, every: int = 5, step_limit: int | None = None) -> Counted:
    """Undirected paths and cycles through every vertex of a graph, for any order.

    ``form``: auto, local, packed or native. ``checkpoint`` names a folder to write every ``every`` distributed steps to
    and to go on from. ``step_limit`` stops after so many steps (its profile ranks orders).
    """
    order = O.best_order(adj) if order is None else order
    plan = steps(adj, order)
    top, profile = O.frontier_stats(adj, order)
    if len(order) < 2:
        return Counted(0, 0, top, profile, [])
    wide = max(s.width for s in plan) > SLOTS
    if wide and form == "packed":
        raise ValueError(f"a step has more than {SLOTS} slots; use native")
    spread = "native" if wide or form == "native" else "packed"
    saved = Checkpoints(checkpoint, fingerprint(adj, order)) if checkpoint else None
    own, df, cycles, seen, first = first_states(), None, 0, [], 0
    if form in ("native", "packed"):
        df, own = _spread(spark, own, spread), None
    if saved and (got := saved.load(spark)):
        df, first, cycles, seen = got
        own, first = None, first + 1
        seen = [tuple(x) for x in seen]
    n, held, ms = seen[-1][5] if seen else 1, [], [0.0] * len(seen)
    for step in plan[first : step_limit]:
        begun = time.perf_counter()
        if df is None and form == "auto" and len(own) > local_rows:
            df, own = _spread(spark, own, spread), None
        if df is None:
            own, more = advance(own, step, prune)
            cycles, out = cycles + more, len(own)
        else:
            if spread == "native":
                df, closing = native_step(df, step, prune)
                for part in closing:
                    cycles += int(part.agg(F.sum("cnt")).first()[0] or 0)
            else:
                df = packed_step(df, step, prune)
            write = saved and step.k % every == every - 1
            if write:
                df = saved.save(spark, df, step.k)
            elif step.k % every == every - 1 and spark.sparkContext.getCheckpointDir():
                df = df.checkpoint()
            else:
                df = df.persist()
                held.append(df)
            if spread == "packed" and step.final:
                cycles += int(df.where("nc = 2").agg(F.sum("cnt")).first()[0] or 0)
                df = df.where("nc < 2")
            out = df.count()
            for old in held[:-1]:  # what the counted step was made from
                old.unpersist()
            del held[:-1]
        seen.append((step.k, step.vertex, step.width, len(step.back), n, out))
        ms.append(1000 * (time.perf_counter() - begun))
        if df is not None and write:
            saved.name(spark, step.k, cycles, seen)
        n = out
    if df is None:
        paths = _total(own.cnt[own.nc]) if plan and own.conn.shape[1] == 0 else 0
    else:
        paths = int(df.where("nc = 1").agg(F.sum("cnt")).first()[0] or 0)
        for old in held:
            old.unpersist()
    return Counted(paths, cycles, top, profile, seen, tuple(ms))


def _spread(spark: SparkSession, s: States, form: str) -> DataFrame:
    if form == "packed":
        return spark.createDataFrame(pa.Table.from_batches([_batch(s)]))
    # Array states are handed over as they are: a packed key holds SLOTS slots only.
    width = s.conn.shape[1]
    ends = pa.array(np.arange(0, (len(s) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(s) + 1, np.int32))
    conn = pa.ListArray.from_arrays(ends, pa.array(s.conn.astype(np.int32).ravel()))
    table = pa.Table.from_arrays([conn, pa.array(s.nc.astype(np.int32)), _to_decimal(s.cnt)], ["conn", "nc", "cnt"])
    return spark.createDataFrame(table)


def step_table(spark: SparkSession, counted: Counted) -> DataFrame:
    """The profile of a run: one row a step."""
    return spark.createDataFrame(counted.steps, "step int, vertex int, fs int, n_back int, states_in bigint, states_out bigint")


def profile_table(spark: SparkSession, adj: O.Adjacency, order: list[int], counted: Counted) -> DataFrame:
    """The profile of a run of this order as logs have it: with times, the frontier that a step leaves (``bag``), its size
    (``fs``) and the number of edges inside it (``e_bag``)."""
    last, bag, rows, total = O.last_steps(adj, order), [], [], 0.0
    for (k, vertex, _, back, before, after), ms in zip(counted.steps, counted.ms, strict=True):
        bag = [(v, end) for v, end in [*bag, (vertex, last[k])] if end > k]
        inside = {v for v, _ in bag}
        edges = sum(len(inside.intersection(adj[v])) for v in inside) // 2
        total += ms
        rows.append((k, vertex, len(bag), back, edges, before, after, ms, total, [v for v, _ in bag]))
    return spark.createDataFrame(rows, "step int, vertex int, fs int, n_back int, e_bag int, states_in bigint, states_out bigint, step_ms double, cumul_ms double, bag array<int>")
