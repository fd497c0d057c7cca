"""The engine's queries over the driver's tables, each with its DuckDB twin where SQL expresses it.

Graph queries take ``nation`` as vertices (``n_nationkey + 1``, 1..25) under the
square-sum rule; analytics queries run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import states as ST
from ..operators import analytics as A, costmodel as C, enumeration as E, estimation as S, frontier as D, ordering as O, sat
from ..sources import graphs as G, profiles as P

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(FOUND)


def oracle_sql() -> dict:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    vertices = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("v"))
    return G.square_sum_over(vertices, 25)


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


# --- SQL pieces ---------------------------------------------------------------------------------------------------------

VERTICES = "vs AS (SELECT CAST(n_nationkey + 1 AS INT) AS v FROM nation)"
SQUARE = "pow(floor(sqrt({0})), 2) = {0}"
EDGES = f"{VERTICES}, edge AS (SELECT a.v AS u, b.v AS w FROM vs a JOIN vs b ON a.v < b.v AND {SQUARE.format('(a.v + b.v)')})"
ARCS = f"{EDGES}, arc AS (SELECT u AS v, w FROM edge UNION ALL SELECT w, u FROM edge)"
WALK = f"""{ARCS}, walk(v, path, n) AS (
  SELECT v, [v], 1 FROM vs UNION ALL
  SELECT arc.w, list_append(path, arc.w), n + 1 FROM walk JOIN arc ON arc.v = walk.v AND NOT list_contains(path, arc.w)
), paths AS (SELECT path FROM walk WHERE n = 25 AND path[1] < v)"""
TURN = f"""{WALK}, sides AS (SELECT path AS p, path FROM paths UNION ALL SELECT path AS p, list_reverse(path) FROM paths),
pivots AS (SELECT p, path, unnest(range(1, 23)) AS i FROM sides),
turned AS (SELECT p, list_concat(path[1:i + 1], list_reverse(path[i + 2:])) AS t FROM pivots WHERE {SQUARE.format('(path[i + 1] + path[25])')}),
rot AS (SELECT DISTINCT p AS src, CASE WHEN t[1] < t[25] THEN t ELSE list_reverse(t) END AS dst FROM turned),
links AS (SELECT src, dst FROM rot JOIN paths ON dst = path WHERE src <> dst),
reach(a, b) AS (SELECT path, path FROM paths UNION SELECT r.a, l.dst FROM reach r JOIN links l ON r.b = l.src),
roots AS (SELECT a AS path, min(b) AS root FROM reach GROUP BY a)"""

# --- graphs -------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {WALK} SELECT count(*) AS ham_paths FROM paths")
def ham_paths_nation(spark, sf_dir):
    """Flagship: exact count by the frontier dataflow."""
    got = D.count(spark, nation_graph(spark, sf_dir).local())
    return one_row(spark, "ham_paths string", str(got.paths)).select(F.col("ham_paths").cast("bigint"))


@query(f"WITH RECURSIVE {WALK} SELECT CAST(count_if({SQUARE.format('(path[1] + path[25])')}) / 25 AS BIGINT) AS ham_cycles FROM paths")
def ham_cycles_nation(spark, sf_dir):
    got = D.count(spark, nation_graph(spark, sf_dir).local())
    return one_row(spark, "ham_cycles string", str(got.cycles)).select(F.col("ham_cycles").cast("bigint"))


@query(f"WITH RECURSIVE {WALK} SELECT count(*) AS ham_paths FROM paths")
def ham_paths_packed(spark, sf_dir):
    """The same with every step distributed."""
    got = D.count(spark, nation_graph(spark, sf_dir).local(), form="packed")
    return one_row(spark, "ham_paths string", str(got.paths)).select(F.col("ham_paths").cast("bigint"))


@query(f"WITH RECURSIVE {WALK} SELECT count(*) AS ham_paths FROM paths")
def ham_paths_native(spark, sf_dir):
    """The same with array states and built-in expressions alone."""
    got = D.count(spark, nation_graph(spark, sf_dir).local(), form="native")
    return one_row(spark, "ham_paths string", str(got.paths)).select(F.col("ham_paths").cast("bigint"))


#: Vertices (family, x, y) and the rule of each family; a vertex's number is 100 x + y.
FAMILIES = """cell AS (
  SELECT 'grid' AS f, a.i AS x, b.i AS y FROM range(4) a(i), range(4) b(i) UNION ALL SELECT 'king', a.i, b.i FROM range(3) a(i), range(3) b(i)
  UNION ALL SELECT 'knight', a.i, b.i FROM range(4) a(i), range(5) b(i) UNION ALL SELECT 'hamming', 0, i FROM range(8) t(i) UNION ALL SELECT 'square_diff', 0, i FROM range(1, 11) t(i)
), near AS (
  SELECT a.f, 100 * a.x + a.y AS v, 100 * b.x + b.y AS w FROM cell a JOIN cell b ON a.f = b.f AND (a.x, a.y) <> (b.x, b.y) WHERE CASE a.f
    WHEN 'grid' THEN abs(a.x - b.x) + abs(a.y - b.y) = 1 WHEN 'king' THEN greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1
    WHEN 'knight' THEN abs(a.x - b.x) * abs(a.y - b.y) = 2 WHEN 'hamming' THEN bit_count(xor(a.y, b.y)) = 1
    ELSE pow(floor(sqrt(abs(a.y - b.y))), 2) = abs(a.y - b.y) END
), size AS (SELECT f, count(*) AS n FROM cell GROUP BY f), walk(f, path, v) AS (
  SELECT f, [100 * x + y], 100 * x + y FROM cell UNION ALL
  SELECT near.f, list_append(path, near.w), near.w FROM walk JOIN near ON near.f = walk.f AND near.v = walk.v AND NOT list_contains(path, near.w)
), whole AS (SELECT walk.f, n, path[1] AS a, v AS b FROM walk JOIN size USING (f) WHERE len(path) = n AND path[1] < v)"""


@query(f"WITH RECURSIVE {FAMILIES} SELECT whole.f AS family, CAST(count(*) AS INT) AS ham_paths, CAST(count(near.v) / any_value(n) AS INT) AS ham_cycles FROM whole LEFT JOIN near ON near.f = whole.f AND near.v = a AND near.w = b GROUP BY whole.f UNION ALL SELECT 'complete', CAST(factorial(10) / 2 AS INT), CAST(factorial(9) / 2 AS INT)")
def family_counts(spark, sf_dir):
    sizes = {"grid": (4, 4), "king": (3, 3), "knight": (4, 5), "hamming": (3,), "square_diff": (10,), "complete": (10,)}
    rows = [(name, (c := D.count(spark, G.family(spark, name, *s).local())).paths, c.cycles) for name, s in sizes.items()]
    return spark.createDataFrame(rows, "family string, ham_paths int, ham_cycles int")


@query(f"WITH {EDGES} SELECT u, w FROM edge")
def edges_nation(spark, sf_dir):
    return nation_graph(spark, sf_dir).edges


@query(f"WITH {EDGES} SELECT u, w FROM edge")
def theta_join_squares(spark, sf_dir):
    """The same edges as an equi-join with a table of squares."""
    v = nation_graph(spark, sf_dir).vertices
    squares = spark.range(1, 8).select((F.col("id") * F.col("id")).alias("s"))
    a = v.select(F.col("v").alias("u")).join(F.broadcast(squares)).select("u", (F.col("s") - F.col("u")).cast("int").alias("w"))
    return a.join(v.select(F.col("v").alias("w")), "w").where("u < w").select("u", "w")


@query(f"WITH {ARCS}, d AS (SELECT vs.v, count(arc.w) AS d FROM vs LEFT JOIN arc USING (v) GROUP BY vs.v) SELECT count(*) AS n, CAST(sum(d) / 2 AS BIGINT) AS edges, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS mean_degree, CAST(count_if(d = 0) AS BIGINT) AS isolated, CAST(count_if(d = 1) AS BIGINT) AS leaves FROM d")
def degree_stats(spark, sf_dir):
    return G.degree_stats(nation_graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT 'p edge 25 ' || count(*) AS line FROM edge UNION ALL SELECT 'e ' || u || ' ' || w FROM edge")
def dimacs_lines(spark, sf_dir):
    return G.dimacs_lines(nation_graph(spark, sf_dir)).select(F.col("value").alias("line"))


@query(f"WITH {ARCS} SELECT arc.v, arc.w FROM arc WHERE v % 2 = 1")
def semi_adjacency(spark, sf_dir):
    """Arcs of vertices that are in a list, by a left semi join."""
    g = nation_graph(spark, sf_dir)
    return g.arcs().join(g.vertices.where("v % 2 = 1"), "v", "left_semi")


NATURAL = f"{ARCS}, last AS (SELECT vs.v, greatest(vs.v, coalesce(max(arc.w), vs.v)) - 1 AS last_step FROM vs LEFT JOIN arc USING (v) GROUP BY vs.v), fw AS (SELECT p.v - 1 AS pos, CAST(count_if(q.v - 1 <= p.v - 1 AND q.last_step > p.v - 1) AS INT) AS fw FROM vs p CROSS JOIN last q GROUP BY p.v)"


@query(f"WITH {NATURAL} SELECT CAST(pos AS INT) AS pos, fw FROM fw")
def frontier_width(spark, sf_dir):
    """Width after each step of the natural order, by running sums."""
    adj = nation_graph(spark, sf_dir).local()
    return O.frontier_table(O.table(spark, adj, sorted(adj)))


@query(f"WITH {NATURAL} SELECT max(fw) AS max_fw, CAST(sum(fw) AS BIGINT) AS profile FROM fw")
def frontier_stats(spark, sf_dir):
    adj = nation_graph(spark, sf_dir).local()
    return O.frontier_table(O.table(spark, adj, sorted(adj))).agg(F.max("fw").alias("max_fw"), F.sum("fw").alias("profile"))


@query()
def ordering_bfs(spark, sf_dir):
    adj = nation_graph(spark, sf_dir).local()
    return O.table(spark, adj, O.best_bfs_distributed(spark, adj))


@query()
def ordering_methods(spark, sf_dir):
    adj = nation_graph(spark, sf_dir).local()
    rows = [(m, *O.frontier_stats(adj, O.best_order(adj, m))) for m in ("bfs", "minfill", "beam", "degree")]
    return spark.createDataFrame(rows, "method string, max_fw int, profile int")


@query()
def ordering_annealed(spark, sf_dir):
    adj = nation_graph(spark, sf_dir).local()
    return O.anneal_chains(spark, adj, list(O.diverse(adj).values()), 1000)


@query()
def pathwidth_exact(spark, sf_dir):
    """Exact width of G_15 and of a grid by the subset program."""
    rows = [(name, O.pathwidth(g.local())[0]) for name, g in (("square_15", G.square_sum(spark, 15)), ("grid_3_3", G.grid(spark, 3, 3)))]
    return spark.createDataFrame(rows, "name string, pathwidth int")


@query()
def dp_profile(spark, sf_dir):
    return D.step_table(spark, D.count(spark, nation_graph(spark, sf_dir).local()))


# --- enumeration and rotations -------------------------------------------------------------------------------------------


def joined(path: str):
    return F.concat_ws(",", F.col(path).cast("array<string>"))


@query(f"WITH RECURSIVE {WALK} SELECT array_to_string(path, ',') AS path FROM paths")
def path_enumeration(spark, sf_dir):
    return E.spanning_paths(nation_graph(spark, sf_dir)).select(joined("path").alias("path"))


@query(f"WITH RECURSIVE {WALK} SELECT CASE WHEN {SQUARE.format('(path[1] + path[25])')} THEN 'closable' ELSE 'open' END AS kind, count(*) AS n FROM paths GROUP BY 1")
def path_endpoint_types(spark, sf_dir):
    return E.spanning_paths(nation_graph(spark, sf_dir)).groupBy(E.endpoint_type(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {TURN} SELECT array_to_string(src, ',') AS src, array_to_string(dst, ',') AS dst FROM links")
def rotation_graph(spark, sf_dir):
    g = nation_graph(spark, sf_dir)
    paths = E.numbered(E.spanning_paths(g)).persist()
    rot = E.rotation_graph(paths, g)
    a, b = paths.select(F.col("path_id").alias("src"), joined("path").alias("a")), paths.select(F.col("path_id").alias("dst"), joined("path").alias("b"))
    return rot.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query(f"WITH RECURSIVE {TURN} SELECT count(*) AS size, count(DISTINCT root) AS one FROM roots GROUP BY root")
def posa_orbit_sizes(spark, sf_dir):
    g = nation_graph(spark, sf_dir)
    orbit = E.orbits(E.numbered(E.spanning_paths(g)).persist(), g)
    return orbit.groupBy("root").agg(F.count("*").alias("size"), F.countDistinct("root").alias("one")).drop("root")


@query(f"WITH RECURSIVE {TURN} SELECT count(DISTINCT root) AS orbits, count(*) AS paths FROM roots")
def posa_orbits(spark, sf_dir):
    g = nation_graph(spark, sf_dir)
    return E.orbit_sizes(E.orbits(E.numbered(E.spanning_paths(g)).persist(), g)).drop("sizes")


@query(f"WITH RECURSIVE {TURN} SELECT count(*) AS size, CAST(0 AS INT) AS in_degree, true AS is_source FROM roots GROUP BY root")
def posa_scc_sources(spark, sf_dir):
    """The relation is symmetric, so strong components are the orbits and all are sources."""
    g = nation_graph(spark, sf_dir)
    paths = E.numbered(E.spanning_paths(g)).persist()
    rot = E.rotation_graph(paths, g).persist()
    return E.condensation(E.strong_components(paths.select(F.col("path_id").alias("node")), rot), rot).select("size", F.col("in_degree").cast("int").alias("in_degree"), "is_source")


# --- estimators ----------------------------------------------------------------------------------------------------------


@query()
def is_estimate(spark, sf_dir):
    return S.estimate(S.importance_samples(spark, nation_graph(spark, sf_dir).local(), 4000))


@query()
def is_alpha_sweep(spark, sf_dir):
    return S.alpha_sweep(spark, nation_graph(spark, sf_dir).local(), [0.5, 1.0, 2.0, 3.0], 1000)


@query()
def smc_estimate(spark, sf_dir):
    return S.run_summary(S.particle_runs(spark, nation_graph(spark, sf_dir).local(), 300, 8))


@query("SELECT count(*) AS samples, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, round(sum(value) * sum(value) / sum(value * value), 4) AS ess FROM events")
def is_moments(spark, sf_dir):
    got = table(spark, sf_dir, "events").agg(*S.moments(F.col("value")))
    return got.select("samples", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), F.round("ess", 4).alias("ess"))


@query("WITH c AS (SELECT event_id, event_type, sum(value) OVER (PARTITION BY event_type ORDER BY event_id) / sum(value) OVER (PARTITION BY event_type) AS c FROM events), n AS (SELECT *, greatest(0, least(100, ceil(100 * c - 0.5 - 1e-12))) AS n FROM c) SELECT event_id, CAST(n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS BIGINT) AS copies FROM n")
def systematic_resample(spark, sf_dir):
    return S.systematic_resample(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), 100, 0.5, "event_id", "value", "event_type").select("event_id", "copies")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 7) AS mean_so_far FROM orders")
def running_avg(spark, sf_dir):
    over = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(over), 7).alias("mean_so_far"))


# --- aggregates and windows ------------------------------------------------------------------------------------------------


@query("SELECT l_partkey % 97 AS slot, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2")
def group_sum_dedup(spark, sf_dir):
    """State dedup: GROUP BY key SUM(count) with wide counts."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("slot"), "l_returnflag", F.col("l_quantity").cast("bigint").cast("decimal(38,0)").alias("cnt"))
    return rows.groupBy("slot", "l_returnflag").agg(F.sum("cnt").cast("bigint").alias("cnt"))


@query("SELECT event_id, round(coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0), 6) AS prev_value FROM events")
def lag_feature(spark, sf_dir):
    over = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.coalesce(F.lag("value").over(over), F.lit(0.0)), 6).alias("prev_value"))


@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before FROM events")
def running_sum(spark, sf_dir):
    over = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.coalesce(F.sum("value").over(over), F.lit(0.0)), 4).alias("before"))


@query("SELECT event_id, round(0.1 * coalesce(lag(value, 2) OVER w, 0) + 0.2 * coalesce(lag(value) OVER w, 0) + 0.4 * value + 0.2 * coalesce(lead(value) OVER w, 0) + 0.1 * coalesce(lead(value, 2) OVER w, 0), 4) AS conv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def conv_window(spark, sf_dir):
    got = A.convolve(table(spark, sf_dir, "events"), "value", [0.1, 0.2, 0.4, 0.2, 0.1], "ts", "user_id")
    return got.select("event_id", F.round("conv", 4).alias("conv"))


@query("SELECT c_nationkey AS n, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0 DESC, c_mktsegment = 'BUILDING' DESC, length(c_name), c_name) AS r FROM customer) WHERE r = 1")
def best_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("complete"), (F.col("c_mktsegment") == "BUILDING").alias("has_e_bag"))
    return P.best_per_n(rows).select("n", "name")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - 1500 * l_quantity, 4) AS err FROM lineitem ORDER BY abs(l_extendedprice - 1500 * l_quantity) DESC, l_orderkey, l_linenumber LIMIT 8")
def topk_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("err", F.col("l_extendedprice") - 1500 * F.col("l_quantity"))
    return rows.orderBy(F.abs("err").desc(), "l_orderkey", "l_linenumber").limit(8).select("l_orderkey", "l_linenumber", F.round("err", 4).alias("err"))


CORR = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS r FROM lineitem" for c in CORR))
def corr_features(spark, sf_dir):
    got = A.correlations(table(spark, sf_dir, "lineitem"), list(CORR), "l_extendedprice")
    return spark.createDataFrame([(c, r) for c, r, _ in got], "feature string, r double").select("feature", F.round("r", 6).alias("r"))


@query("SELECT 'intercept' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def ols_fit(spark, sf_dir):
    got = A.least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame(list(zip(got["features"], got["coef"], strict=True)), "feature string, coef double").select("feature", F.round("coef", 3).alias("coef"))


@query("SELECT round(1 - avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)) / var_pop(l_extendedprice), 6) AS r2, round(sqrt(avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity))), 3) AS rmse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS mae, count(*) AS n FROM lineitem")
def rmse_mae_r2(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").agg(*A.errors(F.col("l_extendedprice"), 1500 * F.col("l_quantity")))
    return got.select(F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), "n")


@query("SELECT event_type, round(max(m) + ln(sum(exp(value / 10 - m))), 6) AS lse FROM (SELECT *, max(value / 10) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type")
def log_sum_exp(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 10).alias("x"))
    return A.log_sum_exp(rows, "x", "event_type").select("event_type", F.round("lse", 6).alias("lse"))


@query("SELECT event_type, round(sum(20 * pow(greatest(value - 50, 0), 2)), 2) AS penalty FROM events GROUP BY event_type")
def penalty_sum(spark, sf_dir):
    return A.overrun_penalty(table(spark, sf_dir, "events"), "value", 50.0, "event_type").select("event_type", F.round("penalty", 2).alias("penalty"))


@query("SELECT event_type, round(sum(value) * sum(value) / sum(value * value), 3) AS ess FROM events GROUP BY event_type")
def ess(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum("value") * F.sum("value") / F.sum(F.col("value") * F.col("value"))).alias("ess")).select("event_type", F.round("ess", 3).alias("ess"))


@query("SELECT s_nationkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS z FROM supplier")
def standardised(spark, sf_dir):
    got, _ = A.standardise(table(spark, sf_dir, "supplier"), ["s_acctbal"])
    return got.select("s_nationkey", F.round("s_acctbal", 6).alias("z"))


@query("SELECT o_orderpriority AS n, max(CAST(floor(o_totalprice) AS BIGINT)) AS peak, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total, count(*) AS steps FROM orders GROUP BY 1")
def summary_per_n(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("n"), F.floor("o_totalprice").alias("states_out"))
    return A.summary_per_n(rows)


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey AS k, [1, 1, 2, 5, 15][r_regionkey + 1] AS bell FROM region")
def bell_lookup(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), ST.bell(F.col("r_regionkey")).alias("bell"))


@query("SELECT n_nationkey AS k, round(10 * pow(0.1 / 10, n_nationkey / 24.0), 6) AS geometric, round(10 + (0.1 - 10) * n_nationkey / 24.0, 6) AS linear, round(0.1 + (10 - 0.1) * (1 + cos(pi() * n_nationkey / 24.0)) / 2, 6) AS cosine, round(10 / (1 + (10 / 0.1 - 1) * ln(1 + n_nationkey / 24.0 * (exp(1) - 1))), 6) AS log FROM nation")
def schedule_values(spark, sf_dir):
    share = F.col("n_nationkey") / 24.0
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), *[F.round(ST.temperature(s, 10.0, 0.1, share), 6).alias(s) for s in ("geometric", "linear", "cosine", "log")])


@query("SELECT array_to_string(c, ',') AS conn, array_to_string(list_transform(c, lambda x: CASE WHEN x <= 0 THEN x ELSE list_position(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i] > 0 AND list_position(c, c[i]) = i), lambda i: c[i]), x) END), ',') AS canonical FROM (VALUES ([0, 3, -1, 1, 3]), ([2, 2, 1]), ([-1, 0])) AS t(c)")
def canonical_states(spark, sf_dir):
    rows = spark.createDataFrame([([0, 3, -1, 1, 3],), ([2, 2, 1],), ([-1, 0],)], "conn array<int>")
    return rows.select(joined("conn").alias("conn"), F.concat_ws(",", F.expr(D.canonical_expr("conn")).cast("array<string>")).alias("canonical"))


# --- profiles and models ---------------------------------------------------------------------------------------------------

LOG = "# header\nn= 12  pw=3  max_fw=4  profile=31  ord=0.25s  dp=7.125s  ham_paths=98765432109876\nstep vertex\n0 5 1 0 1 1 0.10 0.10\n1 7 2 1 1 2 0.20 0.30\nSA moved\n1 7 2 1 1 3 0.25 0.35\n2 9 3 2 4 3 6 0.30 0.65 {1,2} [sm]\n"


def _log(spark):
    return spark.createDataFrame([("profile_70.txt", LOG)], "name string, text string")


#: Words of the log's numbered lines; a line with nine numbers has an e_bag; of lines of one step the last counts.
PARSED = f"""text AS (SELECT '{LOG}' AS t), line AS (SELECT unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM text),
word AS (SELECT i, l, string_split(regexp_replace(l, ' [{{\\[].*', ''), ' ') AS w FROM line WHERE regexp_matches(l, '^\\d+( [\\d.]+){{7,8}}( [{{\\[].*)?$')),
step AS (SELECT *, CAST(w[1] AS INT) AS step, len(w) - 8 AS more FROM word QUALIFY row_number() OVER (PARTITION BY w[1] ORDER BY i DESC) = 1)"""


@query(f"WITH {PARSED} SELECT step, CAST(w[2] AS INT) AS vertex, CAST(w[3] AS INT) AS fs, CAST(w[4] AS INT) AS n_back, CASE WHEN more = 1 THEN CAST(w[5] AS INT) END AS e_bag, CAST(w[5 + more] AS BIGINT) AS states_in, CAST(w[6 + more] AS BIGINT) AS states_out, CAST(w[7 + more] AS DOUBLE) AS step_ms, nullif(regexp_extract(l, '\\[(\\w+)\\]', 1), '') AS backend FROM step")
def parse_profile_lines(spark, sf_dir):
    return P.parse_steps(_log(spark)).select("step", "vertex", "fs", "n_back", "e_bag", "states_in", "states_out", "step_ms", "backend")


@query(f"WITH {PARSED}, s AS (SELECT l FROM line WHERE l LIKE 'n=%') SELECT CAST(regexp_extract(l, 'n= *(\\d+)', 1) AS INT) AS n, CAST(regexp_extract(l, 'pw=(\\d+)', 1) AS INT) AS pw, CAST(regexp_extract(l, 'ord=([\\d.]+)s', 1) AS DOUBLE) AS ord_time_s, CAST(regexp_extract(l, 'dp=([\\d.]+)s', 1) AS DOUBLE) AS dp_time_s, CAST(regexp_extract(l, 'ham_paths=(\\d+)', 1) AS BIGINT) AS ham_paths FROM s")
def parse_profile_summary(spark, sf_dir):
    return P.parse_summaries(_log(spark)).drop("name").withColumn("ham_paths", F.col("ham_paths").cast("bigint"))


@query()
def profile_features(spark, sf_dir):
    """Features of the DP's own profile, over three orders of G_25."""
    adj = nation_graph(spark, sf_dir).local()
    parts = [D.step_table(spark, D.count(spark, adj, o)).select(F.lit(i).alias("profile_id"), F.lit(25).alias("n"), "*", F.lit(None).cast("int").alias("e_bag")) for i, o in enumerate((O.beam(adj), O.best_bfs(adj), O.min_fill(adj)))]
    return A.with_features(parts[0].unionAll(parts[1]).unionAll(parts[2]))


@query()
def model_folds(spark, sf_dir):
    rows = profile_features(spark, sf_dir).where("log_ratio is not null")
    return C.leave_one_out(rows, ["fs", "n_back", "delta_fs", "prev_log_ratio"], epochs=100)


# --- SAT ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {ARCS}, d AS (SELECT v, count(*) AS d FROM arc GROUP BY v) SELECT CAST((SELECT 2 * sum(1 + d * (d - 1) / 2) FROM d) + 2 * 25 * (1 + 25 * 24 / 2) + (SELECT count(*) FROM arc WHERE w <> 1) * 25 + 1 AS BIGINT) AS clauses, CAST((SELECT count(*) FROM arc) + 625 AS BIGINT) AS vars")
def sat_clause_counts(spark, sf_dir):
    clauses, variables = sat.encode(nation_graph(spark, sf_dir))
    return clauses.agg(F.count("*").alias("clauses")).crossJoin(variables.agg(F.count("*").alias("vars")))  # one row each
