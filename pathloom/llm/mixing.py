"""Mixing sources to target weights as a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to); a pattern offers its tokens once at no cost and again at rising costs, up
to ``epochs`` times, and each source takes its target. The cheapest flow says
how many tokens of each pattern go to each source and so how often a pattern is
repeated; seeded hashes then say which documents are.

How it holds at scale: only one row a pattern reaches the driver, where the flow
is found for each group of patterns and sources that touch one another (a source
whose documents have no other is its own group and needs no search); the plan is
broadcast while it has at most SHIPPED rows and joined beyond. Documents are
chosen by comparing a hash with a cut that two rounds of histograms find (4096
bins, then 4096 bins of the bin where the target falls), so no source is ever
sorted or windowed as a whole, and a source with a third of all rows is spread
like any other. A document that does not fit is passed over: the hash order goes
on behind it, by the same histograms, over the documents no larger than the gap,
until the gap is below the smallest spare document. One more document is taken
where that comes nearer to the target.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own, last in order. Documents of size 0 take nothing. Repeated rows share
their hash only if all of id, source and size agree, and are then taken together;
documents without an id go by their text. A very long text is one document like
others. An empty table gives an empty result. Columns of the table keep their
values, but those that have a new column's name (in any case) are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import cut, drop

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
EPOCHS = 2
BINS = 4096
SHIPPED = 20_000


def targets(sizes: dict, weights: tuple = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> dict:
    """Target of each source: ``total`` of all sizes by weight, none above ``epochs`` times its source; the excess is shared anew.

    Sources are in order of code points, null last, and take the weights in turn.
    """
    names = sorted((x for x in sizes if x is not None)) + [x for x in sizes if x is None]
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    out, rest, free = {}, total * sum(sizes.values()), list(names)
    while free:
        unit = rest / sum(weight[x] for x in free)
        full = [x for x in free if unit * weight[x] > epochs * sizes[x]]
        for x in full:
            out[x] = float(epochs * sizes[x])
            rest -= epochs * sizes[x]
        free = [x for x in free if x not in out]
        if not full:
            out |= {x: unit * weight[x] for x in free}
            break
    return out


def cheapest_flow(patterns: list[tuple[tuple, int]], quotas: dict, epochs: int = EPOCHS) -> dict[tuple[int, object], float]:
    """Tokens of each (pattern's number, source) in a flow of least cost that fills the quotas as far as they can be.

    ``patterns``: the sources of a pattern and its tokens. The e-th pass over a pattern costs e a token (convex), so
    repetition starts only where fresh tokens run out. Groups that share no source are solved apart.
    """
    found, root = {}, {s: s for s in quotas}

    def top(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            root[top(s)] = top(members[0])
    groups: dict = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            groups.setdefault(top(members[0]), []).append(i)
    for own in groups.values():
        if len(own) == 1 and len(patterns[own[0]][0]) == 1:
            (source,), tokens = patterns[own[0]]
            flow = {(0, source): min(float(quotas[source]), float(tokens) * epochs)}
        else:
            flow = _shortest_paths([patterns[i] for i in own], {s: quotas[s] for i in own for s in patterns[i][0]}, epochs)
        found |= {(own[i], s): v for (i, s), v in flow.items() if v > 1e-6}
    return found


def _shortest_paths(patterns: list[tuple[tuple, int]], quotas: dict, epochs: int) -> dict[tuple[int, object], float]:
    """The cheapest flow of one group, by successive shortest paths with potentials."""
    arcs: list[list] = []  # to, capacity, cost
    out: dict = {}

    def arc(a, b, capacity, cost):
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0.0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, c, k])

    spent = {}
    for i, (members, tokens) in enumerate(patterns):
        for e in range(epochs):
            arc("from", ("p", i), float(tokens), e)
        for s in members:
            spent[i, s] = len(arcs)
            arc(("p", i), ("s", s), float(tokens) * epochs, 0)
    for s, quota in quotas.items():
        arc(("s", s), "to", float(quota), 0)
    height: dict = {}
    while True:
        best, via, queue, tie = {"from": 0.0}, {}, [(0.0, 0, "from")], 0
        while queue:
            d, _, x = heapq.heappop(queue)
            if d > best[x]:
                continue
            for k in out.get(x, ()):
                y, c, cost = arcs[k]
                new = d + cost + height.get(x, 0.0) - height.get(y, 0.0)
                if c > 1e-9 and new < best.get(y, float("inf")) - 1e-12:
                    best[y], via[y], tie = new, k, tie + 1
                    heapq.heappush(queue, (new, tie, y))
        if "to" not in best:
            break
        for x, d in best.items():
            height[x] = height.get(x, 0.0) + d
        path, x = [], "to"
        while x != "from":
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {key: arcs[k ^ 1][1] for key, k in spent.items() if arcs[k ^ 1][1] > 1e-6}


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, prefix: str = "") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (tokens taken, repeats counted; a multiple of the size).

    ``source_col`` holds a source or an array of sources; of an array's documents ``source_size`` and ``target`` are the
    sums over the pattern's flow. Reruns agree: the choice hangs on the seed and on ids alone. The new columns' names
    begin with ``prefix``; columns of ``docs`` with the same names are replaced.
    """
    many = docs.schema[source_col].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(F.col(source_col).cast("string"))
    added = [prefix + c for c in ("size", "source_size", "target", "taken")]
    left = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {x.lower() for x in added}]
    own = docs.select(F.struct(*left).alias("_row"), word_count(F.col(text_col)).alias("_size"), members.alias("_pattern"), F.col(id_col).alias("_id"), F.when(F.col(id_col).isNull(), F.col(text_col)).alias("_unnamed"))
    # Two independent hashes order the documents of a pattern.
    bins = {"_bin": F.pmod(F.xxhash64("_id", "_unnamed", F.lit(seed)), F.lit(BINS)).cast("int"), "_fine": F.pmod(F.xxhash64(F.lit(seed), "_unnamed", "_id"), F.lit(BINS)).cast("int"), "_tie": F.xxhash64("_id", "_unnamed", "_size", F.lit(-seed))}
    own = own.withColumns(bins).drop("_id", "_unnamed")
    sizes = cut(own.select("_size", "_pattern", "_bin", "_fine", "_tie"))

    totals = sizes.groupBy("_pattern").agg(F.sum("_size").alias("tokens")).collect()
    patterns = [(tuple(r["_pattern"]), r["tokens"] or 0) for r in sorted(totals, key=lambda r: str(r["_pattern"]))]
    by_source: dict = {}
    for p, tokens in patterns:
        for s in p:
            by_source[s] = by_source.get(s, 0) + tokens
    quota = targets(by_source, weights, total, epochs)
    flow = cheapest_flow(patterns, quota, epochs)
    plan = []
    for i, (p, tokens) in enumerate(patterns):
        goal = sum(flow.get((i, s), 0.0) for s in p)
        passes = int(goal // tokens) if tokens else 0
        plan.append((i, list(p), sum(by_source[s] for s in p), sum(quota[s] for s in p), passes, int(round(goal - passes * tokens))))
    hint = F.broadcast if len(plan) <= SHIPPED else lambda df: df
    kind = docs.schema[source_col].dataType.elementType.simpleString() if many else "string"
    spark = docs.sparkSession
    goals = spark.createDataFrame(plan, f"p int, _pattern array<{kind}>, source_size long, target double, passes int, part long")
    keyed = sizes.join(hint(goals.where("part > 0").select("p", "_pattern")), sizes["_pattern"].eqNullSafe(goals["_pattern"])).drop("_pattern")

    def cut_at(rows: DataFrame, bin_col: str, before: str) -> DataFrame:
        """(p, cut bin, tokens before it) where the running total first reaches ``gap``: at most BINS rows a pattern."""
        sums = rows.groupBy("p", "gap", before, bin_col).agg(F.sum("_size").alias("tokens"))
        running = sums.withColumn("reach", F.col(before) + F.sum("tokens").over(Window.partitionBy("p").orderBy(bin_col)))
        hit = running.where("reach >= gap").groupBy("p").agg(F.min_by(F.struct(F.col(bin_col), (F.col("reach") - F.col("tokens")).alias("below")), bin_col).alias("hit"))
        return hit.select("p", f"hit.{bin_col}", "hit.below")

    # A run takes, of the places between two documents that do not fit, the documents no larger than the gap at its start.
    place = "struct(_bin, _fine, _tie)"
    runs: dict[int, list[tuple]] = {}
    gaps = {row[0]: row[5] for row in plan if row[5] > 0}
    open_runs = {p: (-1, 0, 0) for p in gaps}
    while open_runs:
        now = spark.createDataFrame([(p, gaps[p], place_now) for p, place_now in open_runs.items()], "p int, gap long, after struct<_bin: int, _fine: int, _tie: long>")
        wanted = keyed.join(hint(now), "p").where(f"_size > 0 and _size <= gap and {place} > after").withColumn("none", F.lit(0).cast("long"))
        # All rounds leave one row a pattern, so they are collected like the patterns themselves.
        first = {r["p"]: (r["_bin"], r["below"]) for r in cut_at(wanted, "_bin", "none").collect()}
        at = {}
        if first:
            level = spark.createDataFrame([(p, b, t) for p, (b, t) in first.items()], "p int, _bin int, below long")
            second = {r["p"]: (r["_fine"], r["below"]) for r in cut_at(wanted.join(hint(level), ["p", "_bin"]), "_fine", "below").collect()}
            level = spark.createDataFrame([(p, first[p][0], b, t) for p, (b, t) in second.items()], "p int, _bin int, _fine int, below long")
            # Within the last bin (one in 16 million of a pattern): whole documents while they fit, by hash.
            tail = wanted.join(hint(level), ["p", "_bin", "_fine"]).groupBy("p", "gap", "below", "_tie").agg(F.sum("_size").alias("_size")).withColumn("reach", F.col("below") + F.sum("_size").over(Window.partitionBy("p").orderBy("_tie")))
            last = tail.groupBy("p", "below").agg(F.max(F.expr("if(reach <= gap, reach, null)")).alias("reach"), F.min(F.expr("if(reach > gap, _tie, null)")).alias("tie"))
            at = {r["p"]: r for r in last.collect()}
        left = [] if len(at) == len(open_runs) else wanted.groupBy("p").agg(F.sum("_size").alias("tokens")).collect()
        rest = {r["p"]: r["tokens"] for r in left}
        for p, after in list(open_runs.items()):
            gap = gaps[p]
            if p in at:
                tie = at[p]["tie"]
                end = (first[p][0], second[p][0], tie) if tie is not None else (first[p][0], second[p][0] + 1, -(1 << 63))
                gaps[p] -= at[p]["below"] if at[p]["reach"] is None else at[p]["reach"]
            else:  # all that is left fits
                end = (BINS, 0, 0)
                gaps[p] -= rest.get(p, 0)
            runs.setdefault(p, []).append((gap, after, end))
            if p in at and gaps[p] > 0:
                open_runs[p] = end
            else:
                del open_runs[p]
    run_type = "array<struct<most: long, past: struct<_bin: int, _fine: int, _tie: long>, stop: struct<_bin: int, _fine: int, _tie: long>>>"
    inside = f"exists(runs, r -> _size <= r.most and {place} > r.past and {place} < r.stop)"
    # Nothing spare fits any more: the smallest is taken if that comes nearer.
    extras: dict[int, int] = {}
    if any(g > 0 for g in gaps.values()):
        now = spark.createDataFrame([(p, g, runs[p]) for p, g in gaps.items() if g > 0], f"p int, gap long, runs {run_type}")
        spare = keyed.join(hint(now), "p").where(f"_size > 0 and _size < 2 * gap and not {inside}")
        spare = spare.groupBy("p", "gap", "_tie").agg(F.sum("_size").alias("_size")).where("_size < 2 * gap")
        extras = {r["p"]: r["tie"] for r in spare.groupBy("p").agg(F.min_by("_tie", F.struct(F.abs(F.col("gap") - F.col("_size")), "_tie")).alias("tie")).collect()}
    final = [row[1:5] + (runs.get(row[0], []), extras.get(row[0])) for row in plan]
    final = spark.createDataFrame(final, f"_goal array<{kind}>, _source_size long, _target double, _passes int, runs {run_type}, extra long")
    final = final.select("_goal", "_source_size", "_target", "_passes", F.struct("runs", "extra").alias("_cut"))
    drop(sizes)
    placed = own.join(hint(final), own["_pattern"].eqNullSafe(final["_goal"]))
    chosen_now = inside.replace("exists(runs", "exists(_cut.runs") + " or coalesce(_tie = _cut.extra, false)"
    taken = F.col("_size") * (F.col("_passes") + F.expr(f"if({chosen_now}, 1, 0)"))
    return placed.select("_row.*", *[v.alias(c) for c, v in zip(added, (F.col("_size"), F.col("_source_size"), F.col("_target"), taken), strict=True)])
