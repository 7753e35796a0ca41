"""Queries over the sample tables, and the same in SQL.

Orders stand for trials (study = market segment, F complete, P pruned, O running, final metric
= total price), order lines for reports (step = line number, value = extended price; of
several lines with one number the last by date and content counts), embeddings for
vectors, parts and suppliers for points with several objectives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import density, fidelity, folds, history, leases, pareto, prune, signal, stats, text, vectors
from .plans import lowered, ready, scratch
from .plans.space import Distribution as D
from .plans.space import SearchSpace
from .schema import MAXIMIZE, MINIMIZE
from .streaming import reports as stream
from .streaming import stops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trials(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    state = F.when(F.col("o_orderstatus") == "F", "Complete").when(F.col("o_orderstatus") == "P", "Pruned").otherwise("Running")
    value = lambda kind, **v: F.struct(F.lit(kind).alias("kind"), *[v.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("f", "double"), ("i", "long"), ("s", "string"), ("b", "boolean"))])
    params = F.create_map(F.lit("priority"), value("categorical", s=F.col("o_orderpriority")), F.lit("balance"), value("float", f=F.col("c_acctbal")), F.lit("nation"), value("int", i=F.col("c_nationkey")))
    queued = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(F.col("c_mktsegment").alias("study_id"), F.col("o_orderkey").alias("trial_id"), state.alias("state"), F.create_map(F.lit("price"), F.col("o_totalprice")).alias("final"), params.alias("params"), queued.alias("started_ms"), F.when(F.col("o_orderstatus") != "O", queued + F.col("o_custkey") * 1000).alias("completed_ms"))


TRIALS = """trials AS (
  SELECT c_mktsegment AS study_id, o_orderkey AS trial_id, o_totalprice AS price, o_orderpriority AS priority, c_acctbal AS balance, c_nationkey AS nation, o_custkey,
         CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'P' THEN 'Pruned' ELSE 'Running' END AS state
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


#: Reports that a task takes at once, and those that a pass over a stream's state takes; its buckets are so many at least.
TASK_ROWS = 1_000_000
PASS_ROWS = 16 * TASK_ROWS
BUCKETS = 16


def by_trial(lines: DataFrame, key: str) -> DataFrame:
    """lines dealt by key to as many parts as their number asks for; what follows by trial stays in these parts, so a task's memory does not
    grow with the table. Left alone where the session's shuffle partitions are enough."""
    parts = -(-lines.count() // TASK_ROWS)
    return lines.repartition(parts, key) if parts > scratch.slots(lines.sparkSession) else lines


def line_reports(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").cast("long").alias("step"), F.struct(*ORDER).alias("seq"), F.col("l_extendedprice").alias("value"))


def raw_reports(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_reports(by_trial(table(spark, sf, "lineitem"), "l_orderkey"))
    ids = trials(spark, sf).select("study_id", "trial_id")
    return rows.join(ids, "trial_id").select("study_id", "trial_id", "step", F.lit("price").alias("metric"), "value", "seq")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return history.current_reports(raw_reports(spark, sf)).drop("seq")


REPORTS = """reports AS (
  SELECT study_id, trial_id, step, value FROM (
    SELECT study_id, trial_id, CAST(l_linenumber AS BIGINT) AS step, l_extendedprice AS value,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r
    FROM lineitem JOIN trials ON l_orderkey = trial_id) WHERE r = 1)"""
BOTH = f"WITH {TRIALS}, {REPORTS}"
NOW = """now AS (SELECT study_id, trial_id, max(step) AS step, arg_max(value, step) AS value FROM reports JOIN trials USING (study_id, trial_id) WHERE state = 'Running' GROUP BY ALL),
peers AS (SELECT study_id, trial_id, step, value FROM reports JOIN trials USING (study_id, trial_id) WHERE state <> 'Running')"""


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


# Histories.


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price AS value FROM trials WHERE state = 'Complete' QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY price, trial_id) = 1")
def best_trial(spark, sf):
    return history.best_trial(trials(spark, sf), "price", MINIMIZE)


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price AS value FROM trials WHERE state = 'Complete'")
def completed_values(spark, sf):
    return history.completed_values(trials(spark, sf), "price")


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price AS value, CAST(row_number() OVER (PARTITION BY study_id ORDER BY -price, trial_id) AS INTEGER) AS place FROM trials WHERE state = 'Complete' QUALIFY place <= 10")
def best_configs(spark, sf):
    return history.best_configs(trials(spark, sf), "price", MAXIMIZE, 10)


@query(f"{BOTH} SELECT study_id, count(DISTINCT t.trial_id) AS trials, CAST(sum(last) AS BIGINT) AS epochs, CAST(sum(n) AS BIGINT) AS steps FROM trials t LEFT JOIN (SELECT trial_id, max(step) AS last, count(*) AS n FROM reports GROUP BY 1) USING (trial_id) GROUP BY 1")
def consumption(spark, sf):
    return history.consumption(trials(spark, sf), reports(spark, sf))


@query(f"WITH {TRIALS} SELECT study_id, count(*) AS trials, 0 AS waiting, count(*) FILTER (state = 'Running') AS running, count(*) FILTER (state = 'Complete') AS complete, count(*) FILTER (state = 'Pruned') AS pruned, 0 AS failed, 0 AS cancelled FROM trials GROUP BY 1")
def study_summary(spark, sf):
    return history.summary(trials(spark, sf))


@query(f"WITH {TRIALS} SELECT study_id, format('{{}} trials: {{}} complete, {{}} pruned, 0 failed, {{}} running, 0 waiting, 0 cancelled', count(*), count(*) FILTER (state = 'Complete'), count(*) FILTER (state = 'Pruned'), count(*) FILTER (state = 'Running')) AS line FROM trials GROUP BY 1")
def summary_line(spark, sf):
    return history.summarize(trials(spark, sf))


@query(f"WITH {TRIALS} SELECT study_id, bool_and(state <> 'Running') AS drained FROM trials GROUP BY 1")
def drained(spark, sf):
    return history.is_drained(trials(spark, sf))


@query(f"WITH {TRIALS} SELECT study_id, CAST(sum(o_custkey * 1000) AS BIGINT) AS total_ms, avg(o_custkey * 1000) AS mean_ms, max(o_custkey * 1000) AS max_ms FROM trials WHERE state <> 'Running' GROUP BY 1")
def wall_time(spark, sf):
    return history.wall_time_stats(trials(spark, sf))


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price AS value, min(price) OVER (PARTITION BY study_id ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS best FROM trials WHERE state = 'Complete'")
def best_so_far(spark, sf):
    return history.best_so_far(trials(spark, sf), "price", MINIMIZE)


@query(f"{BOTH} SELECT study_id, trial_id, step, value FROM reports")
def reports_upsert(spark, sf):
    return reports(spark, sf).drop("metric")


@query(f"{BOTH} SELECT study_id, trial_id, step, value FROM reports JOIN trials USING (study_id, trial_id) WHERE step = 3 AND state <> 'Running'")
def peers_at_step(spark, sf):
    return history.intermediate_values_at(reports(spark, sf), trials(spark, sf), 3, "price")


@query(f"{BOTH} SELECT study_id, trial_id, max(step) AS last_step, arg_max(value, step) AS last_value FROM reports GROUP BY ALL")
def last_reports(spark, sf):
    return history.last_reports(reports(spark, sf), "price")


@query(f"{BOTH} SELECT value FROM reports WHERE trial_id = 7 AND step = 1")
def value_at(spark, sf):
    return history.value_at(reports(spark, sf), 7, 1, "price")


@query(f"{BOTH} SELECT study_id, trial_id, value AS price FROM reports JOIN trials USING (study_id, trial_id) WHERE state <> 'Running' AND step = 2")
def intermediate_metrics_at(spark, sf):
    return history.intermediate_metrics_at(reports(spark, sf), trials(spark, sf), 2).select("study_id", "trial_id", F.col("metrics")["price"].alias("price"))


@query(f"WITH {TRIALS} SELECT study_id, trial_id, 'balance' AS name, balance AS x, price AS value FROM trials WHERE state = 'Complete' UNION ALL SELECT study_id, trial_id, 'nation', CAST(nation AS DOUBLE), price FROM trials WHERE state = 'Complete'")
def param_scatter(spark, sf):
    return history.param_scatter(trials(spark, sf), "price")


@query(f"{BOTH} SELECT study_id, state, step, count(*) AS trials, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM reports JOIN trials USING (study_id, trial_id) GROUP BY ALL")
def curves_by_fate(spark, sf):
    return rounded(history.curves_by_fate(reports(spark, sf), trials(spark, sf), "price"), "mean", to=4)


# Pruning.


@query(f"{BOTH}, {NOW}, m AS (SELECT study_id, step, median(value) AS middle, count(*) AS n FROM peers GROUP BY ALL) SELECT study_id, trial_id, step, coalesce(step >= 1 AND n >= 5 AND value > middle, false) AS prune FROM now LEFT JOIN m USING (study_id, step)")
def median_prune(spark, sf):
    return prune.median_prune(reports(spark, sf), trials(spark, sf), "price", MINIMIZE, min_trials=5)


@query(f"{BOTH}, {NOW}, m AS (SELECT study_id, step, median(value) AS middle FROM peers GROUP BY ALL), w AS (SELECT study_id, trial_id, median(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY step DESC) AS back FROM reports) WHERE back <= 3 GROUP BY ALL) SELECT study_id, trial_id, step, coalesce(step >= 1 AND v > middle, false) AS prune FROM now JOIN w USING (study_id, trial_id) LEFT JOIN m USING (study_id, step)")
def robust_window_prune(spark, sf):
    return prune.median_prune(reports(spark, sf), trials(spark, sf), "price", MINIMIZE, window=3)


@query(f"{BOTH}, {NOW}, c AS (SELECT n.study_id, n.trial_id, count(*) FILTER (p.value < n.value) AS better, count(p.value) AS peers FROM now n LEFT JOIN peers p ON p.study_id = n.study_id AND p.step = n.step WHERE n.step IN (1, 3, 9) GROUP BY ALL) SELECT study_id, trial_id, step, coalesce(peers + 1 >= 3 AND better >= greatest(1, (peers + 1) // 3), false) AS prune FROM now LEFT JOIN c USING (study_id, trial_id)")
def asha_prune(spark, sf):
    return prune.asha_prune(reports(spark, sf), trials(spark, sf), "price", MINIMIZE)


@query(f"{BOTH}, r AS (SELECT study_id, trial_id, step, value FROM reports JOIN trials USING (study_id, trial_id) WHERE state = 'Complete'), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_id, step ORDER BY value, trial_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY study_id, step) AS n FROM r) SELECT study_id, trial_id, step, value, place, place <= ceil(n / 3) AS promoted FROM p")
def rung_promotion(spark, sf):
    done = history.peers(reports(spark, sf), trials(spark, sf).where("state = 'Complete'"), "price").withColumn("rung", F.concat_ws("/", "study_id", "step"))
    return fidelity.promoted(done, "rung", "value", "trial_id", MINIMIZE).drop("rung")


def size_reports(spark, sf):
    li = table(spark, sf, "supplier")
    part = F.pmod(F.col("s_suppkey"), F.lit(4)).cast("string")
    state = F.when(F.col("s_suppkey") % 3 == 0, "Running").otherwise("Complete")
    t = li.select(part.alias("study_id"), F.col("s_suppkey").alias("trial_id"), state.alias("state"))
    r = li.select(part.alias("study_id"), F.col("s_suppkey").alias("trial_id"), F.lit(1).cast("long").alias("step"), F.explode(F.create_map(F.lit("a"), F.col("s_acctbal"), F.lit("b"), F.col("s_nationkey").cast("double"))).alias("metric", "value"))
    return r, t


@query("WITH s AS (SELECT CAST(s_suppkey % 4 AS VARCHAR) AS study_id, s_suppkey AS trial_id, s_acctbal AS a, s_nationkey AS b, s_suppkey % 3 = 0 AS running FROM supplier) SELECT x.study_id, x.trial_id, CAST(1 AS BIGINT) AS step, 2 * count(*) FILTER (p.a <= x.a AND p.b >= x.b AND (p.a < x.a OR p.b > x.b)) > count(*) AS prune FROM s x JOIN s p ON p.study_id = x.study_id AND NOT p.running WHERE x.running GROUP BY ALL")
def multi_objective_prune(spark, sf):
    r, t = size_reports(spark, sf)
    return prune.multi_objective_prune(r, t, [("a", MINIMIZE), ("b", MAXIMIZE)])


# Robust statistics, importance.

EVENTS = "WITH v AS (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, median(v) AS middle, count(*) AS n FROM v GROUP BY 1), d AS (SELECT event_type, median(abs(v - middle)) AS mad, any_value(middle) AS middle, any_value(n) AS n FROM v JOIN m USING (event_type) GROUP BY 1)"


@query(f"{EVENTS} SELECT event_type, round(avg(v), 6) AS value, round(sqrt(var_samp(v) / count(*)), 6) AS spread FROM v GROUP BY 1")
def robust_mean(spark, sf):
    return rounded(stats.robust(table(spark, sf, "events"), ["event_type"], "value", "mean"), "value", "spread")


@query(f"{EVENTS} SELECT event_type, round(middle, 6) AS value, round(1.4826 * mad / sqrt(n), 6) AS spread FROM d")
def robust_median(spark, sf):
    return rounded(stats.robust(table(spark, sf, "events"), ["event_type"], "value", "median"), "value", "spread")


@query(f"{EVENTS}, p AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS i, n FROM v JOIN m USING (event_type)) SELECT event_type, round(avg(v), 6) AS value, round(any_value(1.4826 * mad / sqrt(d.n)), 6) AS spread FROM p JOIN d USING (event_type) WHERE i >= floor(p.n * 0.1) AND i < p.n - floor(p.n * 0.1) GROUP BY 1")
def robust_trimmed(spark, sf):
    return rounded(stats.robust(table(spark, sf, "events"), ["event_type"], "value", "trimmed", 0.1), "value", "spread")


@query(
    f"""WITH {TRIALS}, n AS (SELECT study_id, trial_id, price AS y, 'balance' AS name, balance AS x FROM trials WHERE state = 'Complete' UNION ALL SELECT study_id, trial_id, price, 'nation', CAST(nation AS DOUBLE) FROM trials WHERE state = 'Complete'),
k AS (SELECT study_id, name, least(10, count(DISTINCT x)) AS k, count(*) AS n FROM n GROUP BY ALL),
g AS (SELECT study_id, name, y, CAST((row_number() OVER (PARTITION BY study_id, name ORDER BY x, trial_id) - 1) * k // n AS VARCHAR) AS grp FROM n JOIN k USING (study_id, name) UNION ALL SELECT study_id, 'priority', price, priority FROM trials WHERE state = 'Complete'),
t AS (SELECT study_id, name, var_pop(y) AS total, avg(y) AS mean, count(*) AS rows FROM g GROUP BY ALL),
b AS (SELECT study_id, name, sum(c * (m - mean) * (m - mean) / rows) AS between_ FROM (SELECT study_id, name, grp, count(*) AS c, avg(y) AS m FROM g GROUP BY ALL) JOIN t USING (study_id, name) GROUP BY ALL),
s AS (SELECT study_id, name, CASE WHEN total > 0 THEN greatest(0, least(1, between_ / total)) ELSE 0 END AS share FROM b JOIN t USING (study_id, name))
SELECT study_id, name, round(share / sum(share) OVER (PARTITION BY study_id), 6) AS importance FROM s"""
)
def importance(spark, sf):
    return rounded(stats.importance(stats.long_params(trials(spark, sf), "price")), "importance")


# Several objectives.


def part_points(spark, sf):
    return pareto.objectives(table(spark, sf, "part").withColumn("g", F.col("p_brand")), "g", "p_partkey", [("p_retailprice", MINIMIZE), ("p_size", MAXIMIZE)])


POINTS = 'WITH p AS (SELECT p_brand AS "group", p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS o0, -CAST(p_size AS DOUBLE) AS o1 FROM part), u AS (SELECT "group", o0, o1, min(id) AS id FROM p GROUP BY ALL)'
FRONT = 'f AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b."group" = a."group" AND b.o0 <= a.o0 AND b.o1 <= a.o1 AND (b.o0 < a.o0 OR b.o1 < a.o1)))'


@query(f'{POINTS}, {FRONT} SELECT "group", o0, o1, id FROM f')
def pareto_front(spark, sf):
    return pareto.front(part_points(spark, sf))


@query(f'{POINTS}, {FRONT}, i AS (SELECT * FROM f WHERE o0 < 2000 AND o1 < 0) SELECT "group", round(sum((2000 - o0) * (top - o1)), 4) AS hypervolume FROM (SELECT *, coalesce(min(o1) OVER (PARTITION BY "group" ORDER BY o0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM i) GROUP BY 1')
def hypervolume(spark, sf):
    return rounded(pareto.hypervolume(part_points(spark, sf), [2000.0, 0.0]), "hypervolume", to=4)


RANKS = 'WITH RECURSIVE p AS (SELECT CAST(s_nationkey AS INTEGER) AS "group", s_suppkey AS id, s_acctbal AS o0, CAST(s_suppkey % 7 AS DOUBLE) AS o1 FROM supplier), r AS (SELECT "group", id, o0, o1, 0 AS rank FROM p UNION SELECT b."group", b.id, b.o0, b.o1, r.rank + 1 FROM r JOIN p b ON b."group" = r."group" AND r.o0 <= b.o0 AND r.o1 <= b.o1 AND (r.o0 < b.o0 OR r.o1 < b.o1)) SELECT "group", id, o0, o1, max(rank) AS rank FROM r GROUP BY ALL'


@query(RANKS)
def non_dominated_ranks(spark, sf):
    s = table(spark, sf, "supplier").withColumn("m", F.col("s_suppkey") % 7)
    return pareto.ranks(pareto.objectives(s, "s_nationkey", "s_suppkey", [("s_acctbal", MINIMIZE), ("m", MINIMIZE)])).select("group", "id", "o0", "o1", "rank")


#: One objective's part of the crowding: the neighbours' distance over the rank's span, infinite at the ends.
CROWD = "coalesce((lead({c}) OVER ({w} ORDER BY {c}, id) - lag({c}) OVER ({w} ORDER BY {c}, id)) / greatest(max({c}) OVER ({w}) - min({c}) OVER ({w}), 1e-12), 'infinity'::DOUBLE)"
WITHIN = 'PARTITION BY "group", rank'


@query(f"""SELECT "group", id, o0, o1, rank, CASE WHEN count(*) OVER ({WITHIN}) <= 2 THEN 'infinity'::DOUBLE ELSE {CROWD.format(c="o0", w=WITHIN)} + {CROWD.format(c="o1", w=WITHIN)} END AS crowding FROM ({RANKS}) ranked""")
def crowding_distances(spark, sf):
    return pareto.crowding(non_dominated_ranks(spark, sf))


@query(f"""SELECT "group", id, rank, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY rank, crowding DESC, id) AS INTEGER) AS place FROM (SELECT *, CASE WHEN count(*) OVER ({WITHIN}) <= 2 THEN 'infinity'::DOUBLE ELSE {CROWD.format(c="o0", w=WITHIN)} + {CROWD.format(c="o1", w=WITHIN)} END AS crowding FROM ({RANKS}) ranked) crowded) placed WHERE place <= 2""")
def elite(spark, sf):
    return pareto.elite(crowding_distances(spark, sf), 2).select("group", "id", "rank", "place")


@query(
    'WITH p AS (SELECT p_brand AS "group", p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS o0, -CAST(p_size AS DOUBLE) AS o1 FROM part), q AS (SELECT a."group", a.id, b.o0, b.o1 FROM p a JOIN p b ON a."group" = b."group" AND b.id <= a.id AND b.o0 < 2000 AND b.o1 < 0), s AS (SELECT *, coalesce(min(o1) OVER (PARTITION BY "group", id ORDER BY o0, o1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM q), v AS (SELECT "group", id, sum((2000 - o0) * greatest(top - o1, 0)) AS volume FROM s GROUP BY ALL) SELECT p."group", p.id, round(coalesce(volume, 0), 4) AS hypervolume FROM p LEFT JOIN v ON v."group" = p."group" AND v.id = p.id'
)
def hypervolume_history(spark, sf):
    return rounded(pareto.hypervolume_history(part_points(spark, sf), (2000.0, 0.0)), "hypervolume", to=4)


#: A uniform number for a sample and an objective, from the low end to the reference.
DRAW = "(low{k} + ('0x' || substr(md5('0|' || sample || '|o{k}'), 1, 13))::BIGINT / 4503599627370496.0 * ({r} - low{k})) AS s{k}"


@query(
    f"""WITH p AS (SELECT p_brand AS "group", CAST(p_retailprice AS DOUBLE) AS o0, -CAST(p_size AS DOUBLE) AS o1, CAST(p_partkey AS DOUBLE) AS o2 FROM part), i AS (SELECT * FROM p WHERE o0 < 2100 AND o1 < 0 AND o2 < 1e6), f AS (SELECT DISTINCT "group", o0, o1, o2 FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b."group" = a."group" AND b.o0 <= a.o0 AND b.o1 <= a.o1 AND b.o2 <= a.o2 AND (b.o0 < a.o0 OR b.o1 < a.o1 OR b.o2 < a.o2))), l AS (SELECT "group", min(o0) AS low0, min(o1) AS low1, min(o2) AS low2 FROM f GROUP BY 1), d AS (SELECT "group", sample, {DRAW.format(k=0, r="2100.0::DOUBLE")}, {DRAW.format(k=1, r="0.0::DOUBLE")}, {DRAW.format(k=2, r="1e6::DOUBLE")} FROM l, range(20000) t(sample)), h AS (SELECT "group", count(*) AS n FROM d SEMI JOIN f ON d."group" = f."group" AND f.o0 <= d.s0 AND f.o1 <= d.s1 AND f.o2 <= d.s2 GROUP BY 1) SELECT g."group", round(coalesce(coalesce(n, 0) / 20000 * (2100.0 - low0) * (0.0 - low1) * (1e6 - low2), 0), 2) AS hypervolume FROM (SELECT DISTINCT "group" FROM p) g LEFT JOIN l ON l."group" = g."group" LEFT JOIN h ON h."group" = g."group\""""
)
def hypervolume_sampled(spark, sf):
    p = pareto.objectives(table(spark, sf, "part"), "p_brand", "p_partkey", [("p_retailprice", MINIMIZE), ("p_size", MAXIMIZE), ("p_partkey", MINIMIZE)])
    return rounded(pareto.hypervolume(p, [2100.0, 0.0, 1e6]), "hypervolume", to=2)


@query(
    f"""WITH p AS (SELECT p_brand AS "group", p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS o0, -CAST(p_size AS DOUBLE) AS o1, CAST(length(p_name) AS DOUBLE) AS o2 FROM part), i AS (SELECT * FROM p WHERE o0 < 2100 AND o1 < 0 AND o2 < 60), l AS (SELECT "group", min(o0) AS low0, min(o1) AS low1, min(o2) AS low2 FROM i GROUP BY 1), d AS (SELECT "group", sample, {DRAW.format(k=0, r="2100.0::DOUBLE")}, {DRAW.format(k=1, r="0.0::DOUBLE")}, {DRAW.format(k=2, r="60.0::DOUBLE")} FROM l, range(2000) t(sample)), h AS (SELECT d."group", sample, min(id) AS id FROM d JOIN i ON d."group" = i."group" AND i.o0 <= d.s0 AND i.o1 <= d.s1 AND i.o2 <= d.s2 GROUP BY ALL), c AS (SELECT "group", id, count(*) AS n FROM h GROUP BY ALL) SELECT p."group", p.id, round(coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY p."group" ORDER BY p.id) / 2000 * (2100.0 - low0) * (0.0 - low1) * (60.0 - low2), 0), 0) AS hypervolume FROM p LEFT JOIN c ON c."group" = p."group" AND c.id = p.id LEFT JOIN l ON l."group" = p."group" """
)
def hypervolume_history_sampled(spark, sf):
    p = table(spark, sf, "part").withColumn("m", F.length("p_name"))
    points = pareto.objectives(p, "p_brand", "p_partkey", [("p_retailprice", MINIMIZE), ("p_size", MAXIMIZE), ("m", MINIMIZE)])
    return rounded(pareto.hypervolume_history_sampled(points, [2100.0, 0.0, 60.0], samples=2000), "hypervolume", to=0)


@query('WITH p AS (SELECT CAST(o_custkey % 4 AS INTEGER) AS "group", o_orderkey AS id, o_totalprice AS o0, CAST(epoch(o_orderdate) / 86400 AS DOUBLE) AS o1, CAST(o_custkey % 97 AS DOUBLE) AS o2 FROM orders), u AS (SELECT "group", o0, o1, o2, min(id) AS id FROM p GROUP BY ALL) SELECT "group", o0, o1, o2, id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b."group" = a."group" AND b.o0 <= a.o0 AND b.o1 <= a.o1 AND b.o2 <= a.o2 AND (b.o0 < a.o0 OR b.o1 < a.o1 OR b.o2 < a.o2))')
def pareto_front_three(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 4).cast("int").alias("g"), "o_orderkey", "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), (F.col("o_custkey") % 97).alias("m"))
    return pareto.front(pareto.objectives(o, "g", "o_orderkey", [("o_totalprice", MINIMIZE), ("day", MINIMIZE), ("m", MINIMIZE)]))


# Spaces and proposals.


@query("SELECT i, d, round((SELECT sum(((i // CAST(pow(b, k) AS BIGINT)) % b) / pow(b, k + 1)) FROM range(24) t(k)), 9) AS u FROM (SELECT o_orderkey + 6 AS i FROM orders), (VALUES (0, 2), (1, 3), (2, 5)) v(d, b)")
def halton(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") + 6).alias("i"))
    each = o.select("i", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.round(C.radical_inverse(F.col("i"), b), 9).alias("u")) for d, b in enumerate((2, 3, 5))])).alias("x"))
    return each.select("i", "x.d", "x.u")


@query("SELECT o_orderkey AS trial_id, ('0x' || substr(md5('7|' || o_orderkey || '|lr'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM orders")
def hash_random(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), C.hash_uniform(7, F.col("o_orderkey"), F.lit("lr")).alias("u"))


@query("SELECT m.model, coalesce(d.d_model, 0) AS d_model, coalesce(h.hidden, 0) AS hidden FROM (VALUES ('mlp'), ('transformer')) m(model) LEFT JOIN (SELECT unnest(range(64, 129)) AS d_model) d ON m.model = 'transformer' LEFT JOIN (SELECT unnest(range(16, 33)) AS hidden) h ON m.model = 'mlp'")
def grid_product(spark, sf):
    model = spark.createDataFrame([("mlp",), ("transformer",)], "model string")
    values = lambda on, lo, hi: F.when(F.col("model") == on, F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    return model.withColumn("d_model", F.explode(values("transformer", 64, 128))).withColumn("hidden", F.explode(values("mlp", 16, 32))).na.fill(0)


@query(f"WITH {TRIALS}, c AS (SELECT study_id, priority, count(*) FILTER (state = 'Complete') AS n FROM trials GROUP BY ALL) SELECT study_id, priority, (n + 1) / sum(n + 1) OVER (PARTITION BY study_id) AS p FROM c")
def laplace_probabilities(spark, sf):
    c = trials(spark, sf).groupBy("study_id", F.col("params")["priority"]["s"].alias("priority")).agg(F.count_if(F.col("state") == "Complete").alias("n"))
    return density.laplace(c, ["study_id"], "n").select("study_id", "priority", "p")


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price, least(greatest(least(coalesce(price - lag(price) OVER w, 1e9), coalesce(lead(price) OVER w - price, 1e9)), 5000), 500000) AS sigma FROM trials WHERE state = 'Complete' WINDOW w AS (PARTITION BY study_id ORDER BY price, trial_id)")
def parzen_bandwidth(spark, sf):
    done = history.completed_values(trials(spark, sf), "price").withColumnRenamed("value", "price")
    return density.bandwidths(done, ["study_id"], "price", "trial_id", 5000.0, 500000.0).select("study_id", "trial_id", "price", "sigma")


def mixed_space() -> SearchSpace:
    s = SearchSpace()
    s.add("model", D.categorical(["mlp", "transformer", "forest"]))
    s.add("lr", D.log_float(1e-5, 0.1), when=("model", ["mlp", "transformer"]))
    s.add("dropout", D.stepped_float(0.0, 0.5, 0.125))
    s.add("layers", D.int(2, 12, 2), when=("model", ["transformer"]))
    s.add("hidden", D.log_int(16, 1024), when=("model", ["mlp"]))
    s.add("bias", D.boolean(), when=("hidden", list(range(16, 129))))
    return s


SAMPLE_U = "('0x' || substr(md5('11|' || o_orderkey || '|{name}'), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    f"""WITH u AS (SELECT o_orderkey AS trial_id, {", ".join(f"{SAMPLE_U.format(name=n)} AS u_{n}" for n in ("model", "lr", "dropout", "layers", "hidden", "bias"))} FROM orders),
v AS (SELECT *, ['mlp', 'transformer', 'forest'][CAST(floor(u_model * 3) AS INTEGER) + 1] AS model FROM u),
w AS (SELECT *, CASE WHEN model IN ('mlp', 'transformer') THEN least(greatest(exp(ln(1e-5::DOUBLE) + u_lr * (ln(0.1::DOUBLE) - ln(1e-5::DOUBLE))), 1e-5), 0.1) END AS lr, least(floor(u_dropout * 0.5 / 0.125 + 0.5) * 0.125, 0.5) AS dropout, CASE WHEN model = 'transformer' THEN CAST(2 + 2 * floor(u_layers * 6) AS BIGINT) END AS layers, CASE WHEN model = 'mlp' THEN CAST(floor(exp(ln(16::DOUBLE) + u_hidden * (ln(1024::DOUBLE) - ln(16::DOUBLE))) + 0.5) AS BIGINT) END AS hidden FROM v)
SELECT trial_id, model, round(lr, 9) AS lr, round(dropout, 6) AS dropout, layers, hidden, CASE WHEN hidden <= 128 THEN u_bias >= 0.5 END AS bias FROM w"""
)
def space_sample(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"))
    return rounded(rounded(lowered.random_points(ids, mixed_space(), "trial_id", 11), "lr", to=9), "dropout")


@query(
    """WITH m AS (SELECT 0 AS a, 'mlp' AS model UNION ALL SELECT 1, 'transformer'),
h AS (SELECT a, model, h - 16 AS b, CAST(h AS BIGINT) AS hidden FROM m, range(16, 33) t(h) WHERE model = 'mlp' UNION ALL SELECT a, model, -1, NULL FROM m WHERE model <> 'mlp'),
d AS (SELECT a, b, model, hidden, w - 64 AS c, CAST(w AS BIGINT) AS d_model FROM h, range(64, 129) t(w) WHERE model = 'transformer' UNION ALL SELECT a, b, model, hidden, -1, NULL FROM h WHERE model <> 'transformer'),
x AS (SELECT a, b, c, model, hidden, d_model, k AS e, k = 1 AS bias FROM d, range(2) t(k) WHERE hidden % 2 = 0 UNION ALL SELECT a, b, c, model, hidden, d_model, -1, NULL FROM d WHERE hidden IS NULL OR hidden % 2 = 1),
y AS (SELECT *, f, f * 0.25::DOUBLE AS dropout FROM x, range(3) t(f)),
g AS (SELECT model, hidden, d_model, bias, dropout, row_number() OVER (ORDER BY a, b, c, e, f) - 1 AS r, count(*) OVER () AS n FROM y)
SELECT o_orderkey AS trial_id, model, hidden, d_model, bias, dropout FROM orders JOIN g ON o_orderkey % n = r"""
)
def grid_points(spark, sf):
    s = SearchSpace()
    s.add("model", D.categorical(["mlp", "transformer"]))
    s.add("hidden", D.int(16, 32), when=("model", ["mlp"]))
    s.add("d_model", D.int(64, 128), when=("model", ["transformer"]))
    s.add("bias", D.boolean(), when=("hidden", list(range(16, 33, 2))))
    s.add("dropout", D.float(0.0, 0.5))
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"))
    return lowered.GridProgram(s, 3).unranked(ids, "trial_id")


READY_U = "('0x' || substr(md5('5|' || o_orderkey || '|{name}'), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    f"""WITH u AS (SELECT o_orderkey AS trial_id, {", ".join(f"{READY_U.format(name=n)} AS {n}" for n in ("n_heads", "head_dim", "n_layers", "ff_ratio", "lr", "dropout"))} FROM orders),
v AS (SELECT trial_id, ['1', '2', '4'][CAST(floor(n_heads * 3) AS INTEGER) + 1] AS n_heads, CAST(8 + floor(head_dim * 25) AS BIGINT) AS head_dim, CAST(1 + floor(n_layers * 3) AS BIGINT) AS n_layers, CAST(2 + floor(ff_ratio * 3) AS BIGINT) AS ff_ratio, round(exp(ln(1e-4::DOUBLE) + lr * (ln(1e-2::DOUBLE) - ln(1e-4::DOUBLE))), 9) AS lr, round(dropout * 0.3::DOUBLE, 9) AS dropout FROM u)
SELECT *, CAST(n_heads AS BIGINT) * head_dim AS d_model, CAST(n_heads AS BIGINT) * head_dim * ff_ratio AS ff_dim FROM v"""
)
def transformer_points(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"))
    return rounded(ready.transformer_points(ids, "trial_id", 5), "lr", "dropout", to=9)


#: Balances of completed trials as components on [-1000, 10000], with a wide one at 4500.
def balances(spark, sf):
    return trials(spark, sf).select("study_id", "trial_id", "state", F.col("final")["price"].alias("price"), F.col("params")["balance"]["f"].alias("balance"))


def asked(spark, sf):
    return balances(spark, sf).where("state = 'Running' and trial_id % 100 = 0").select("study_id", "trial_id", "balance")


PARZEN = """{name} AS (SELECT study_id, mu, CASE tie WHEN 0 THEN 11000.0 ELSE least(greatest(least(coalesce(mu - lag(mu) OVER w, 11000), coalesce(lead(mu) OVER w - mu, 11000)), 110), 11000) END AS sigma
FROM (SELECT study_id, balance AS mu, 1 AS tie FROM {source} UNION ALL SELECT DISTINCT study_id, 4500.0, 0 FROM {source}) WINDOW w AS (PARTITION BY study_id ORDER BY mu, tie)),
{name}_at AS (SELECT q.study_id, q.trial_id, ln(sum(exp(-0.5 * ((q.balance - mu) / sigma) ** 2 - ln(sigma * sqrt(2 * pi()))))) - ln(count(*)) AS v FROM asked q JOIN {name} USING (study_id) GROUP BY ALL)"""
ASKED = "asked AS (SELECT study_id, trial_id, balance FROM trials WHERE state = 'Running' AND trial_id % 100 = 0)"


@query(f"WITH {TRIALS}, {ASKED}, done AS (SELECT * FROM trials WHERE state = 'Complete'), {PARZEN.format(name='c', source='done')} SELECT study_id, trial_id, round(v, 6) AS density FROM c_at")
def parzen_logpdf(spark, sf):
    done = balances(spark, sf).where("state = 'Complete'")
    c = density.parzen(done, ["study_id"], "balance", -1000.0, 10000.0)
    return rounded(density.log_density(asked(spark, sf), c, ["study_id"], "trial_id", "balance", "density").drop("balance"), "density")


PARTED = "parted AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY price, trial_id) <= least(25, greatest(ceil(0.25 * count(*) OVER (PARTITION BY study_id)), 1), count(*) OVER (PARTITION BY study_id) - 1) AS good FROM trials WHERE state = 'Complete'), best AS (SELECT * FROM parted WHERE good), rest AS (SELECT * FROM parted WHERE NOT good)"
TPE = f"WITH {TRIALS}, {ASKED}, {PARTED}, {PARZEN.format(name='l', source='best')}, {PARZEN.format(name='g', source='rest')}, scored AS (SELECT study_id, trial_id, l_at.v AS l, g_at.v AS g, l_at.v - g_at.v AS gain FROM l_at JOIN g_at USING (study_id, trial_id))"


def scored(spark, sf):
    done = balances(spark, sf).where("state = 'Complete'")
    return density.tpe_scores(asked(spark, sf), done, ["study_id"], "trial_id", "balance", "price", "trial_id", -1000.0, 10000.0)


@query(f"{TPE} SELECT study_id, trial_id, round(l, 6) AS l, round(g, 6) AS g, round(gain, 6) AS gain FROM scored")
def tpe_score(spark, sf):
    return rounded(scored(spark, sf).drop("balance"), "l", "g", "gain")


@query(f"{TPE} SELECT study_id, trial_id, round(gain, 6) AS gain FROM scored QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY gain DESC, trial_id) = 1")
def tpe_choice(spark, sf):
    return rounded(density.best_candidates(scored(spark, sf), ["study_id"], "trial_id").select("study_id", "trial_id", "gain"), "gain")


@query("SELECT * FROM (VALUES (3,0,27,1,9),(3,1,9,3,3),(3,2,3,9,1),(3,3,1,27,0),(2,0,12,3,4),(2,1,4,9,1),(2,2,1,27,0),(1,0,6,9,2),(1,1,2,27,0),(0,0,4,27,0)) v(bracket, rung, configs, resource, keep)")
def hyperband_schedule(spark, sf):
    return fidelity.schedule_table(spark, 27, 3)


@query("WITH r AS (SELECT p_partkey, CAST(p_size * 5 AS BIGINT) AS most, CAST(floor(ln(p_size * 5) / ln(3)) AS INTEGER) AS top FROM part), b AS (SELECT *, unnest(range(0, top + 1)) AS bracket FROM r), g AS (SELECT *, unnest(range(0, bracket + 1)) AS rung, ceil((top + 1) / (bracket + 1) * pow(3::DOUBLE, bracket)) AS n FROM b), c AS (SELECT *, greatest(1, CAST(floor(n / pow(3::DOUBLE, rung)) AS BIGINT)) AS configs FROM g) SELECT p_partkey, most, CAST(bracket AS INTEGER) AS bracket, CAST(rung AS INTEGER) AS rung, configs, least(greatest(1, CAST(floor(most / pow(3::DOUBLE, bracket) * pow(3::DOUBLE, rung) + 0.5) AS BIGINT)), most) AS used, CASE WHEN rung < bracket THEN greatest(1, configs // 3) ELSE 0 END AS keep FROM c")
def bracket_schedules(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 5).cast("long").alias("most"))
    return fidelity.schedules(p, "most", 3)


@query(f"WITH {TRIALS} SELECT study_id, trial_id, price, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY study_id ORDER BY price, trial_id) AS INTEGER) AS place FROM trials WHERE state = 'Complete') WHERE place <= 9")
def survivors(spark, sf):
    done = trials(spark, sf).where(F.col("state") == "Complete").select("study_id", "trial_id", F.col("final")["price"].alias("price"))
    return fidelity.survivors(done, ["study_id"], "price", "trial_id", MINIMIZE, 9).select("study_id", "trial_id", "price", "place")


# Vectors.


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY ('0x' || substr(md5('3|' || vec_id), 1, 13))::BIGINT DESC) <= greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.25 + 0.5))) AS held_out FROM embeddings")
def split_rows(spark, sf):
    return vectors.split(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), 0.25, 3).select("id", "held_out")


def embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))


EACH = "WITH e AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"{EACH} SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high FROM e GROUP BY 1")
def scaling_statistics(spark, sf):
    return rounded(vectors.statistics(embedded(spark, sf)), "mean", "std")


@query(f"{EACH}, s AS (SELECT pos, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS d FROM e GROUP BY 1) SELECT id, CAST(pos AS INTEGER) AS pos, round((x - m) / d, 5) AS z FROM e JOIN s USING (pos)")
def standardize(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("id", F.posexplode(vectors.scaled("v", vectors.fit_scaling(e, "standardize"))).alias("pos", "z")), "z", to=5)


@query(f"{EACH}, s AS (SELECT pos, min(x) AS m, greatest(max(x) - min(x), 1e-6) AS d FROM e GROUP BY 1) SELECT id, CAST(pos AS INTEGER) AS pos, round((x - m) / d, 5) AS z FROM e JOIN s USING (pos)")
def normalize(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("id", F.posexplode(vectors.scaled("v", vectors.fit_scaling(e, "normalize"))).alias("pos", "z")), "z", to=5)


@query("WITH d AS (SELECT q.vec_id AS id, r.vec_id AS other, sqrt(list_sum([(CAST(q.embedding[i] AS DOUBLE) - r.embedding[i]) ** 2 for i in range(1, 65)])) AS d FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0) SELECT id, round(avg(d), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM d) WHERE k <= 5 GROUP BY 1")
def knn_anomaly(spark, sf):
    e = embedded(spark, sf)
    return rounded(vectors.anomaly_scores(e, e.where("id % 100 = 0"), 5), "score")


@query("WITH d AS (SELECT q.vec_id AS id, r.vec_id AS other, r.label, sqrt(list_sum([(CAST(q.embedding[i] AS DOUBLE) - r.embedding[i]) ** 2 for i in range(1, 65)])) AS d FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND r.vec_id % 100 <> 0), n AS (SELECT id, label, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM d) WHERE k <= 7 GROUP BY ALL) SELECT id, CAST(label AS BIGINT) AS predicted FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label DESC) = 1")
def knn_predictions(spark, sf):
    e = embedded(spark, sf)
    return vectors.knn_predictions(e.where("id % 100 <> 0"), e.where("id % 100 = 0"), 7, "label")


@query(f"{EACH}, c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL), d AS (SELECT e.id, c.label, sum((x - m) ** 2) AS d FROM e JOIN c USING (pos) GROUP BY ALL), n AS (SELECT id, arg_min(label, d) AS p FROM d GROUP BY 1) SELECT round(avg(CASE WHEN p = label THEN 100.0 ELSE 0 END), 6) AS accuracy FROM n JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id)")
def centroid_accuracy(spark, sf):
    e = embedded(spark, sf)
    return spark.createDataFrame([(round(vectors.centroid_accuracy(e, e, "label"), 6),)], "accuracy double")


@query(f"{EACH}, c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL), d AS (SELECT e.id, c.label, sum((x - m) ** 2) AS d FROM e JOIN c USING (pos) GROUP BY ALL) SELECT id, CAST(arg_min(label, d) AS BIGINT) AS cluster, round(min(d), 6) AS d2 FROM d GROUP BY 1")
def lloyd_assignment(spark, sf):
    e = embedded(spark, sf)
    centers = [(r["label"], list(r["centroid"])) for r in vectors.centroids(e, "label").orderBy("label").collect()]
    return rounded(vectors.assign(e, centers).select("id", F.col("cluster").cast("long").alias("cluster"), "d2"), "d2")


@query("WITH d AS (SELECT a.vec_id AS id, a.label, b.label AS other, sqrt(list_sum([(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) ** 2 for i in range(1, 65)])) AS d FROM embeddings a, embeddings b), m AS (SELECT id, label, other, CASE WHEN label = other THEN sum(d) / nullif(count(*) - 1, 0) ELSE avg(d) END AS v FROM d GROUP BY id, label, other), s AS (SELECT id, max(v) FILTER (label = other) AS a, min(v) FILTER (label <> other) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def silhouette(spark, sf):
    return spark.createDataFrame([(round(vectors.silhouette(embedded(spark, sf), "label"), 6),)], "silhouette double")


@query("SELECT o_totalprice AS threshold FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET (SELECT CAST(floor(0.95 * (count(*) - 1) + 0.5) AS BIGINT) FROM orders)")
def nearest_rank(spark, sf):
    return spark.createDataFrame([(vectors.nearest_rank(table(spark, sf, "orders"), "o_totalprice", 0.95),)], "threshold double")


@query("WITH x AS (SELECT o_totalprice > 200000 AS y, o_orderpriority < '3' AS p FROM orders) SELECT 2 * count(*) FILTER (y AND p) / (2 * count(*) FILTER (y AND p) + count(*) FILTER (NOT y AND p) + count(*) FILTER (y AND NOT p)) AS f1 FROM x")
def f1_score(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_totalprice") > 200000).alias("y"), (F.col("o_orderpriority") < "3").alias("p"))
    return vectors.f1(o, "y", "p")


# Folds and series.

U = "('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT"


@query(f"SELECT vec_id AS id, CAST((row_number() OVER (ORDER BY {U.format(seed=3, key='vec_id')}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def kfold(spark, sf):
    return folds.kfold(embedded(spark, sf).select("id"), 5, 3)


@query(f"SELECT vec_id AS id, CAST((row_number() OVER (PARTITION BY label ORDER BY {U.format(seed=3, key='vec_id')}, vec_id) - 1) % 4 AS INTEGER) AS fold FROM embeddings")
def stratified_kfold(spark, sf):
    return folds.stratified_kfold(embedded(spark, sf), 4, 3, "label").select("id", "fold")


@query(f"SELECT vec_id AS id, CASE WHEN row_number() OVER (ORDER BY {U.format(seed=3, key='vec_id')}, vec_id) > count(*) OVER () - CAST(floor(count(*) OVER () * 0.2 + 0.5) AS BIGINT) THEN 0 ELSE -1 END AS fold FROM embeddings")
def holdout(spark, sf):
    return folds.holdout(embedded(spark, sf).select("id"), 0.2, 3)


@query(f"SELECT vec_id AS id, CAST((row_number() OVER (ORDER BY {U.format(seed=9, key='vec_id')}, vec_id) - 1) % 4 AS INTEGER) AS fold FROM embeddings")
def evaluation_folds(spark, sf):
    return folds.evaluation(embedded(spark, sf).select("id"), "stratified", 4, 9)


@query("SELECT CAST((e - 10) // 5 AS INTEGER) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(e AS BIGINT) AS train_end, CAST(e AS BIGINT) AS test_start, CAST(e + 5 AS BIGINT) AS test_end FROM range(10, 36, 5) t(e)")
def time_split(spark, sf):
    return folds.time_folds(spark, 40, 10, 5)


def daily(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("y"))


DAILY = "WITH d AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(value) AS y FROM events GROUP BY ALL)"


@query(f"{DAILY}, n AS (SELECT event_type, count(*) AS n FROM d GROUP BY 1), e AS (SELECT event_type, n, unnest(range(100, n - 24 + 1, 24)) AS e FROM n) SELECT event_type, n, CAST((e - 100) // 24 AS INTEGER) AS fold, e - 100 AS train_start, e AS train_end, e AS test_start, e + 24 AS test_end FROM e")
def time_folds(spark, sf):
    lengths = daily(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return folds.time_folds_of(lengths, "n", 100, 24, sliding=True)


@query(f"{DAILY}, l AS (SELECT event_type, t, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, t, round(y, 4) AS y, round(y3, 4) AS f0, round(y2, 4) AS f1, round(y1, 4) AS f2 FROM l WHERE y3 IS NOT NULL")
def lag_windows(spark, sf):
    w = folds.lag_windows(daily(spark, sf), 3, ["event_type"])
    return w.select("event_type", "t", F.round("y", 4).alias("y"), *[F.round(F.col("features")[k], 4).alias(f"f{k}") for k in range(3)])


@query(f"{DAILY}, n AS (SELECT event_type, y AS a, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS p FROM d), m AS (SELECT * FROM n WHERE p IS NOT NULL), s AS (SELECT event_type, avg(abs(a - p)) AS scale FROM m GROUP BY 1) SELECT event_type, round(avg(abs(a - p)), 5) AS mae, round(sqrt(avg((a - p) ** 2)), 5) AS rmse, round(avg(CASE WHEN abs(a) + abs(p) > 0 THEN 2 * abs(a - p) / (abs(a) + abs(p)) ELSE 0 END) * 100, 5) AS smape, round(avg(CASE WHEN a >= p THEN 0.9 * (a - p) ELSE 0.1 * (p - a) END), 5) AS pinball, round(avg(abs(a - p)) / any_value(scale), 5) AS mase FROM m JOIN s USING (event_type) GROUP BY 1")
def forecast_metrics(spark, sf):
    d = daily(spark, sf)
    naive = d.select("event_type", F.col("y").alias("actual"), F.lag("y").over(W.partitionBy("event_type").orderBy("t")).alias("predicted")).where("predicted is not null")
    scale = folds.naive_scale(d, ["event_type"])
    return rounded(folds.forecast_metrics(naive.join(scale, "event_type"), ["event_type"], q=0.9, naive_scale="scale"), "mae", "rmse", "smape", "pinball", "mase", to=5)


@query(f"WITH {TRIALS} SELECT study_id, trial_id, round(avg(price) OVER (PARTITION BY study_id ORDER BY trial_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM trials WHERE state = 'Complete'")
def running_cv(spark, sf):
    return rounded(stats.running_mean(history.completed_values(trials(spark, sf), "price"), ["study_id"], "trial_id", "value").drop("value"), "running", to=4)


@query(f"WITH {TRIALS} SELECT study_id, trial_id, round(CAST(sum(CAST(price AS DECIMAL(18, 2))) OVER w AS DOUBLE) / count(*) OVER w, 4) AS running FROM trials WHERE state = 'Complete' WINDOW w AS (PARTITION BY study_id ORDER BY trial_id ROWS UNBOUNDED PRECEDING)")
def exact_running_mean(spark, sf):
    return rounded(stats.running_mean(history.completed_values(trials(spark, sf), "price"), ["study_id"], "trial_id", "value").drop("value"), "running", to=4)


# Text.

TOKENS = "SELECT {key}, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT {key}, list_transform(list_filter(string_split_regex({text}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x)) AS t FROM {table})"


@query(f"SELECT p_partkey, CAST(pos AS INTEGER) AS pos, token FROM ({TOKENS.format(key='p_partkey', text='p_name', table='part')})")
def tokenize(spark, sf):
    return text.token_rows(table(spark, sf, "part"), "p_partkey", "p_name")


@query(f"SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, token) AS INTEGER) AS id FROM ({TOKENS.format(key='doc_id', text='text', table='documents')}) GROUP BY 1 ORDER BY n DESC, token LIMIT 1999")
def vocabulary(spark, sf):
    return text.vocabulary(table(spark, sf, "documents"), "text", 2000)


@query(f"WITH t AS ({TOKENS.format(key='conv_id, turn', text='text', table='conversations')}), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM t GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 499), e AS (SELECT conv_id, turn, pos, coalesce(id, 0) AS id FROM t LEFT JOIN v USING (token) WHERE pos < 16), l AS (SELECT conv_id, turn, list(id ORDER BY pos) AS ids FROM e GROUP BY ALL) SELECT c.conv_id || '/' || c.turn AS key, array_to_string(list_resize(coalesce(ids, []), 16, 0), ' ') AS ids FROM conversations c LEFT JOIN l USING (conv_id, turn)")
def encode_tokens(spark, sf):
    c = table(spark, sf, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    vocab = text.vocabulary(c, "text", 500)
    return text.encode(c, "key", "text", vocab, 16).select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


# Modulo 256 only the low bytes of FNV-1a's start and factor count.
@query("""SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS pos, CAST(list_reduce(list_prepend(37::BIGINT, [CAST(ascii(c) AS BIGINT) for c in string_split(w[pos], '')]), lambda h, c: xor(h, c) * 179 % 256) AS BIGINT) AS bucket FROM (SELECT p_partkey, w, unnest(range(1, least(len(w), 32) + 1)) AS pos FROM (SELECT p_partkey, [lower(x) for x in string_split_regex(p_name, '[^\\p{L}\\p{N}]+') if x <> ''] AS w FROM part))""")
def hashed_tokens(spark, sf):
    return text.hashed_sequence(table(spark, sf, "part"), "p_partkey", "p_name", 256, 32)


@query("""SELECT p_partkey, CAST(list_reduce(list_prepend(37::BIGINT, [CAST(ascii(c) AS BIGINT) for c in string_split(p_name, '')]), lambda h, c: xor(h, c) * 179 % 256) AS BIGINT) AS bucket FROM part""")
def hash_buckets(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.hash_bucket(F.col("p_name"), 256).alias("bucket"))


# Signals, images, schedules.


@query("WITH f AS (SELECT vec_id AS id, s AS frame, k, sum(embedding[s * 16 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 31)) * cos(2 * pi() * k * i / 32)) AS re, sum(embedding[s * 16 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 31)) * sin(2 * pi() * k * i / 32)) AS im FROM embeddings, range(3) a(s), range(8) b(k), range(32) c(i) GROUP BY ALL) SELECT id, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS bin, round(ln(1 + sqrt(re * re + im * im)), 5) AS level FROM f")
def spectrogram(spark, sf):
    s = embedded(spark, sf).select("id", signal.spectrogram(F.col("v"), 64, 32, 16, 8).alias("s"))
    return rounded(s.select("id", F.posexplode("s").alias("frame", "row")).select("id", "frame", F.posexplode("row").alias("bin", "level")), "level", to=5)


@query(f"{EACH} SELECT id, CAST((pos // 8) // 4 * 2 + (pos % 8) // 4 AS INTEGER) AS cell, round(avg(x), 6) AS level FROM e GROUP BY ALL")
def frame_pool(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("id", F.posexplode(signal.frame_pool(F.col("v"), 1, 8, 8, 2)).alias("cell", "level")), "level")


@query("WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT id, least(e[1], e[3]) AS ax, greatest(e[1], e[3]) AS aX, least(e[2], e[4]) AS ay, greatest(e[2], e[4]) AS a_y, least(e[5], e[7]) AS bx, greatest(e[5], e[7]) AS b_x, least(e[6], e[8]) AS by_, greatest(e[6], e[8]) AS b_y FROM b)".replace("AS aX", "AS a_x") + ", i AS (SELECT *, greatest(least(a_x, b_x) - greatest(ax, bx), 0) * greatest(least(a_y, b_y) - greatest(ay, by_), 0) AS both_ FROM c) SELECT id, round(CASE WHEN (a_x - ax) * (a_y - ay) + (b_x - bx) * (b_y - by_) - both_ > 0 THEN both_ / ((a_x - ax) * (a_y - ay) + (b_x - bx) * (b_y - by_) - both_) ELSE 0 END, 6) AS iou FROM i")
def box_iou(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("id", C.box_iou(F.slice("v", 1, 4), F.slice("v", 5, 4)).alias("iou")), "iou")


@query("WITH p AS (SELECT vec_id AS id, unnest([CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END for i in range(1, 33)]) AS a, unnest([CASE WHEN embedding[i + 32] > 0 THEN 1 ELSE 0 END for i in range(1, 33)]) AS p FROM embeddings), c AS (SELECT id, c, count(*) FILTER (a = c AND p = c) AS i, count(*) FILTER (a = c OR p = c) AS u FROM p, (VALUES (0), (1)) v(c) GROUP BY ALL) SELECT id, round(avg(i / u), 6) AS miou FROM c WHERE u > 0 GROUP BY 1")
def mean_iou(spark, sf):
    e = embedded(spark, sf).select("id", F.transform("v", lambda x: F.when(x > 0, 1).otherwise(0)).alias("m"))
    return rounded(signal.mean_iou(e.select("id", F.slice("m", 1, 32).alias("a"), F.slice("m", 33, 32).alias("p")), ["id"], "a", "p", 2), "miou")


@query("WITH b AS (SELECT s AS step, 1e-4 + s * (0.02 - 1e-4) / 49 AS beta FROM range(50) t(s)) SELECT step, round(beta, 9) AS beta, round(exp(sum(ln(1 - beta)) OVER (ORDER BY step)), 9) AS alpha_bar FROM b")
def diffusion_linear(spark, sf):
    return rounded(signal.linear_schedule(spark, 50), "beta", "alpha_bar", to=9)


@query("WITH b AS (SELECT s AS step, least(greatest(1 - cos(((s + 1) / 50.0 + 0.008) / 1.008 * pi() / 2) ** 2 / cos((s / 50.0 + 0.008) / 1.008 * pi() / 2) ** 2, 0), 0.999) AS beta FROM range(50) t(s)) SELECT step, round(beta, 9) AS beta, round(exp(sum(ln(1 - beta)) OVER (ORDER BY step)), 9) AS alpha_bar FROM b")
def diffusion_cosine(spark, sf):
    return rounded(signal.cosine_schedule(spark, 50), "beta", "alpha_bar", to=9)


@query("SELECT p AS pos, d AS dim, round(CASE WHEN d % 2 = 0 THEN sin(p / pow(10000, 2 * (d // 2) / 16.0)) ELSE cos(p / pow(10000, 2 * (d // 2) / 16.0)) END, 9) AS value FROM range(32) a(p), range(16) b(d)")
def sinusoidal(spark, sf):
    return rounded(signal.sinusoidal(spark, 32, 16), "value", to=9)


@query("WITH b AS (SELECT s AS step, least(greatest(1 - cos(((s + 1) / 50.0 + 0.008) / 1.008 * pi() / 2) ** 2 / cos((s / 50.0 + 0.008) / 1.008 * pi() / 2) ** 2, 0), 0.999) AS beta FROM range(50) t(s)), a AS (SELECT step, exp(sum(ln(1 - beta)) OVER (ORDER BY step)) AS p FROM b) SELECT vec_id AS id, CAST(k - 1 AS INTEGER) AS pos, round(sqrt(p) * embedding[k] + sqrt(1 - p) * embedding[65 - k], 6) AS x FROM embeddings JOIN a ON vec_id % 50 = step, range(1, 65) t(k)")
def diffusion_noised(spark, sf):
    e = embedded(spark, sf).withColumn("step", F.col("id") % 50).withColumn("noise", F.reverse("v"))
    found = signal.noised(e, signal.cosine_schedule(spark, 50), "v", "noise", "step")
    return rounded(found.select("id", F.posexplode("noised").alias("pos", "x")), "x")


@query(f"SELECT p_partkey, CAST(pos AS INTEGER) AS pos, token, CAST(d AS INTEGER) AS dim, round(CASE WHEN d % 2 = 0 THEN sin(pos / pow(10000, 2 * (d // 2) / 6.0)) ELSE cos(pos / pow(10000, 2 * (d // 2) / 6.0)) END, 9) AS value FROM ({TOKENS.format(key='p_partkey', text='p_name', table='part')}), range(6) t(d)")
def token_positions(spark, sf):
    t = text.token_rows(table(spark, sf, "part"), "p_partkey", "p_name")
    return rounded(t.select("p_partkey", "pos", "token", F.posexplode(signal.position_code(F.col("pos"), 6)).alias("dim", "value")), "value", to=9)


@query("SELECT vec_id AS id, CAST(k - 1 AS INTEGER) AS pos, round((CAST(embedding[k] AS DOUBLE) + embedding[k + 32]) / 2, 6) AS x FROM embeddings, range(1, 33) t(k)")
def fuse_mean(spark, sf):
    e = embedded(spark, sf)
    return rounded(e.select("id", F.posexplode(C.fuse(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)), "mean")).alias("pos", "x")), "x")


# Coordination, over a snapshot of leases.


def leased(spark, sf):
    t = trials(spark, sf)
    return t.select("study_id", "trial_id", F.when(F.col("state") == "Pruned", "Waiting").otherwise(F.col("state")).alias("state"), F.when(F.col("trial_id") % 5 > 0, F.col("trial_id") % 100).alias("lease_expiry"))


LEASES = f"WITH {TRIALS}, l AS (SELECT study_id, trial_id, CASE state WHEN 'Pruned' THEN 'Waiting' ELSE state END AS state, CASE WHEN trial_id % 5 > 0 THEN trial_id % 100 END AS lease_expiry FROM trials)"


@query(f"{LEASES} SELECT study_id, min(trial_id) AS trial_id FROM l WHERE state = 'Waiting' OR (state = 'Running' AND (lease_expiry IS NULL OR lease_expiry <= 50)) GROUP BY 1")
def claim_next(spark, sf):
    return leases.claim_next(leased(spark, sf), 50)


@query(f"{LEASES} SELECT study_id, trial_id, CASE WHEN state = 'Running' AND lease_expiry <= 50 THEN 'Waiting' ELSE state END AS state FROM l")
def recover_orphans(spark, sf):
    return leases.recovered(leased(spark, sf), 50).select("study_id", "trial_id", "state")


@query("SELECT o_orderkey AS request, min(s_suppkey) AS device FROM (SELECT o_orderkey, o_totalprice / 50 AS cpu, s_suppkey, s_acctbal, min(s_acctbal) FILTER (s_acctbal >= o_totalprice / 50) OVER (PARTITION BY o_orderkey) AS fit FROM orders, supplier) WHERE s_acctbal = fit GROUP BY 1")
def best_fit(spark, sf):
    requests = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 50).alias("x"))
    return leases.best_fit(requests, table(spark, sf, "supplier"), "x", "o_orderkey", "s_acctbal", "s_suppkey")


# Streams.


@query(f"{BOTH} SELECT study_id, trial_id, step, 'price' AS metric, value FROM reports")
def report_stream_upsert(spark, sf):
    """Order lines as a stream of reports, run to its end; the last state of each key.

    Lines come in files of TASK_ROWS at most, which go once a micro-batch has taken them in. The state is a table in epochs and buckets by trial;
    at the end a pass takes as many buckets as hold PASS_ROWS, so that no step shuffles all reports at once."""
    source, state, studies, checkpoint, out = (scratch.path_for(spark, f"report-{x}") for x in ("stream", "state", "studies", "checkpoint", "last"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ORDER)
    passes = max(1, -(-lines.count() // PASS_ROWS))
    buckets = max(BUCKETS, passes)
    lines.write.option("compression", "zstd").option("maxRecordsPerFile", TASK_ROWS).parquet(source)
    coming = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 8).option("cleanSource", "delete").parquet(source)
    rows = line_reports(coming).withColumn("metric", F.lit("price"))
    q = rows.writeStream.foreachBatch(stream.upsert_writer(state, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    for done in (source, checkpoint):
        scratch.delete(spark, done)
    ids = trials(spark, sf).select("study_id", "trial_id").withColumn("bucket", stream.bucket_of("trial_id", buckets))
    scratch.write(ids.repartitionById(buckets, "bucket"), studies, "bucket")
    known = spark.read.schema(rows.schema.add("bucket", "integer")).parquet(state)
    ids = spark.read.schema(ids.schema).parquet(studies)
    for first in range(0, buckets, width := buckets // passes):
        own = F.col("bucket").between(first, first + width - 1)
        last = stream.upserts(by_trial(known.where(own).drop("bucket"), "trial_id").join(ids.where(own).drop("bucket"), "trial_id")).drop("seq")
        scratch.write(last, f"{out}/first={first}")
    for done in (state, studies):
        scratch.delete(spark, done)
    return spark.read.schema(last.schema).parquet(out).drop("first")


@query(f"{BOTH}, m AS (SELECT study_id, step, median(value) AS middle, count(*) AS n FROM reports JOIN trials USING (study_id, trial_id) WHERE state <> 'Running' GROUP BY ALL) SELECT study_id, trial_id, step, value, round(middle, 6) AS middle FROM reports JOIN trials USING (study_id, trial_id) JOIN m USING (study_id, step) WHERE state = 'Running' AND n >= 5 AND value > middle QUALIFY row_number() OVER (PARTITION BY study_id, trial_id ORDER BY step) = 1")
def sticky_stops(spark, sf):
    """Order lines as a stream of reports, first those of ended trials, run to its end."""
    r = reports(spark, sf).join(trials(spark, sf).select("study_id", "trial_id", "state"), ["study_id", "trial_id"])
    rows = r.select("study_id", "trial_id", "step", "value", (F.col("state") != "Running").alias("peer"))
    source, out, checkpoint = stops.scratch_folders(spark)
    rows.where("peer").write.parquet(source)
    rows.where("not peer").write.mode("append").parquet(source)
    return rounded(stops.run_to_end(spark, source, rows.schema, out, checkpoint, files_at_once=1000, direction=MINIMIZE, min_trials=5), "middle")


@query(f"{LEASES} SELECT trial_id, 'w' AS owner, CASE WHEN lease_expiry <= 50 THEN 'Waiting' ELSE 'Running' END AS state FROM l WHERE lease_expiry IS NOT NULL")
def lease_timeouts(spark, sf):
    events = leased(spark, sf).where("lease_expiry is not null").select("trial_id", F.lit("w").alias("owner"), F.col("lease_expiry").alias("expiry_ms"), F.col("trial_id").alias("seq"))
    return stream.lease_timeouts(events, 50)
