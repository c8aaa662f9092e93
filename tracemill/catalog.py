"""Named queries over the driver's tables, each with the SQL that says the same.

The tables stand in for a recording: events are its trace (event_id the order, user_id the scope, event_type the
command, value what is written), nations and regions its scope tree, a graph derived from nations its link graph,
orders and line items its requirements, documents and pages its sources.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import questions, recorded, recording, session
from tracemill.functions import text as X
from tracemill.operators import compare, graph, temporal
from tracemill.replay import sequential
from tracemill.rules import dead, values
from tracemill.rules.base import Config, Store
from tracemill.sources import trace

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))) if name == "events" else df


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link graph: two edges of each nation."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    one = n.select(k.alias("src"), ((k * 3 + 1) % 25).alias("dst"), F.when(r == 0, "PRIVATE").when(r <= 2, "PUBLIC").otherwise("INTERFACE").alias("visibility"))
    return one.unionByName(n.select(k.alias("src"), ((k * 5 + 2) % 25).alias("dst"), F.when(r <= 1, "PUBLIC").otherwise("PRIVATE").alias("visibility")))


GRAPH = """edges AS (
  SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst, CASE WHEN n_regionkey = 0 THEN 'PRIVATE' WHEN n_regionkey <= 2 THEN 'PUBLIC' ELSE 'INTERFACE' END AS visibility FROM nation
  UNION ALL SELECT n_nationkey, (n_nationkey * 5 + 2) % 25, CASE WHEN n_regionkey <= 1 THEN 'PUBLIC' ELSE 'PRIVATE' END FROM nation)"""


@query("""SELECT event_id, event_type, greatest(coalesce(lead(epoch_us(ts)) OVER (ORDER BY event_id) - epoch_us(ts), 0), 0)::BIGINT AS self_us FROM events""")
def event_self_time(spark, sf):
    return temporal.self_time(table(spark, sf, "events"), F.col("us"), "event_id").select("event_id", "event_type", "self_us")


@query("""SELECT event_id, event_type, greatest(coalesce(lead(epoch_us(ts)) OVER (ORDER BY event_id) - epoch_us(ts), 0), 0)::BIGINT AS self_us FROM events ORDER BY self_us DESC, event_id LIMIT 20""")
def slowest_events(spark, sf):
    return event_self_time(spark, sf).orderBy(F.desc("self_us"), "event_id").limit(20)


@query("""WITH t AS (SELECT event_type, greatest(coalesce(lead(epoch_us(ts)) OVER (ORDER BY event_id) - epoch_us(ts), 0), 0)::BIGINT AS self_us FROM events)
SELECT event_type, count(*) AS calls, sum(self_us)::BIGINT AS total_us, (sum(self_us) // count(*))::BIGINT AS mean_us FROM t GROUP BY event_type""")
def command_hotspots(spark, sf):
    g = event_self_time(spark, sf).groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("self_us").alias("total_us"))
    return g.withColumn("mean_us", F.expr("total_us div greatest(calls, 1)"))


@query("""SELECT n_name, count(*) AS calls, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents, (sum(round(o_totalprice * 100)::BIGINT) // count(*))::BIGINT AS mean_cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def scope_hotspots(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    g = j.groupBy("n_name").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total_cents"))
    return g.withColumn("mean_cents", F.expr("total_cents div greatest(calls, 1)"))


@query("""SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS span_us FROM events""")
def configure_span(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), (F.max("us") - F.min("us")).alias("span_us"))


def _orders_by_priority(spark, sf, year):
    o = table(spark, sf, "orders").where(F.year("o_orderdate") == year)
    return o.groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""WITH a AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
b AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.cents, 0)::BIGINT AS before, coalesce(b.cents, 0)::BIGINT AS after,
CASE WHEN a.cents IS NULL THEN 'added' WHEN b.cents IS NULL THEN 'removed' WHEN a.cents = b.cents THEN 'same' ELSE 'changed' END AS status,
(coalesce(b.cents, 0) - coalesce(a.cents, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.o_custkey = b.o_custkey ORDER BY abs(delta) DESC, o_custkey LIMIT 50""")
def profile_compare(spark, sf):
    d = compare.deltas(_orders_by_priority(spark, sf, 1995), _orders_by_priority(spark, sf, 1996), ["o_custkey"], "cents")
    return d.orderBy(F.desc(F.abs("delta")), "o_custkey").limit(50)


@query("""WITH leaf AS (SELECT n_regionkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name || ';' || n_name AS stack, n::BIGINT AS samples FROM leaf JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, (1000000 - sum(n))::BIGINT FROM leaf JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def flamegraph_exclusive(spark, sf):
    n, c, r = (table(spark, sf, t) for t in ("nation", "customer", "region"))
    leaf = n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_regionkey", "n_name").agg(F.count("c_custkey").alias("n"))
    named = leaf.join(r, leaf.n_regionkey == r.r_regionkey)
    own = named.groupBy("r_name").agg((F.lit(1000000) - F.sum("n")).cast("long").alias("samples")).withColumnRenamed("r_name", "stack")
    return named.select(F.concat_ws(";", "r_name", "n_name").alias("stack"), F.col("n").alias("samples")).unionByName(own)


@query("""SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def dead_options(spark, sf):
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_quantity > 45")
    return p.join(l, p.p_partkey == l.l_partkey, "left_anti").select("p_partkey", "p_name")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')""")
def dead_functions(spark, sf):
    c, o, e = (table(spark, sf, t) for t in ("customer", "orders", "events"))
    return c.join(o.where("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_anti").join(e.where("event_type = 'purchase'"), c.c_custkey == F.col("user_id"), "left_anti").select("c_custkey")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def dead_modules(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT user_id, min(event_id) AS first_event FROM events w WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = w.user_id AND r.event_type = 'purchase' AND r.value > 90) GROUP BY user_id""")
def dead_variables(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").join(e.where("event_type = 'purchase' and value > 90").select("user_id"), "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


CENTS = "round(value * 100)::BIGINT"


@query(f"""WITH w AS (SELECT user_id, event_id, {CENTS} AS v, lead(event_id) OVER k AS next_event_id, lead({CENTS}) OVER k AS next_v FROM events WHERE event_type = 'click' WINDOW k AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, next_event_id, v, next_v FROM w WHERE v <> next_v AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = w.user_id AND r.event_type = 'view' AND r.event_id > w.event_id AND r.event_id < w.next_event_id)""")
def clobbers(spark, sf):
    e = table(spark, sf, "events")
    w = temporal.next_write(e.where("event_type = 'click'").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v")), ["user_id"], "event_id", ["v"]).where("v <> next_v")
    # a read between the two: the dominating write of some read is the first of them
    reads = temporal.dominating_write(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'click'").select("user_id", "event_id", F.lit(1).alias("one")), ["user_id"], "event_id", "one")
    seen = reads.where("write_id is not null").select("user_id", F.col("write_id").alias("event_id")).distinct()
    return w.join(seen, ["user_id", "event_id"], "left_anti").select("user_id", "event_id", "next_event_id", "v", "next_v")


@query(f"""SELECT r.user_id, r.event_id, w.event_id AS write_id, w.v AS value FROM (SELECT * FROM events WHERE event_type = 'view') r
ASOF LEFT JOIN (SELECT user_id, event_id, {CENTS} AS v FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL) w ON r.user_id = w.user_id AND r.event_id > w.event_id""")
def dominating_write(spark, sf):
    e = table(spark, sf, "events")
    writes = e.where("event_type in ('click', 'purchase') and value is not null").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return temporal.dominating_write(e.where("event_type = 'view'").select("user_id", "event_id"), writes, ["user_id"], "event_id", "v")


@query(f"""WITH w AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {CENTS} END AS v FROM events WHERE event_type IN ('error', 'click') AND value IS NOT NULL)
SELECT r.user_id, r.event_id, CASE WHEN w.v IS NOT NULL THEN w.event_id END AS write_id, w.v AS value FROM (SELECT * FROM events WHERE event_type = 'view') r ASOF LEFT JOIN w ON r.user_id = w.user_id AND r.event_id > w.event_id""")
def env_read_resolution(spark, sf):
    e = table(spark, sf, "events")
    v = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long"))
    writes = e.where("event_type in ('error', 'click') and value is not null").select("user_id", "event_id", v.alias("v"))
    return temporal.dominating_write(e.where("event_type = 'view'").select("user_id", "event_id"), writes, ["user_id"], "event_id", "v")


@query(f"""SELECT user_id, event_id, coalesce(
 (SELECT {CENTS} FROM events h WHERE h.user_id = e.user_id AND h.event_id < e.event_id AND h.event_type = 'purchase' AND h.value IS NOT NULL ORDER BY event_id DESC LIMIT 1),
 (SELECT {CENTS} FROM events s WHERE s.user_id = e.user_id AND s.event_id < e.event_id AND s.event_type <> 'purchase' AND s.value IS NOT NULL ORDER BY event_id LIMIT 1)) AS state FROM events e WHERE value IS NOT NULL""")
def cache_soft_hard(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    out = temporal.soft_hard(e, ["user_id"], "event_id", F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"))
    return out.select("user_id", "event_id", "state")


@query("""WITH d AS (SELECT conv_id, turn, turn % 2 AS depth, coalesce(lag(turn % 2) OVER (PARTITION BY conv_id ORDER BY turn) + 1 = turn % 2, false) AS opens FROM conversations)
SELECT conv_id, turn, opens, max(CASE WHEN opens THEN turn END) OVER (PARTITION BY conv_id, depth ORDER BY turn) AS scope FROM d""")
def scope_assignment(spark, sf):
    c = table(spark, sf, "conversations").withColumn("depth", F.col("turn") % 2)
    return temporal.scopes_by_depth(c, ["conv_id"], "depth", "turn").select("conv_id", "turn", "opens", "scope")


@query("""SELECT l_orderkey, l_returnflag, count(*) AS n, count(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2""")
def duplicate_links(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_linestatus").alias("kinds"))
    return g.where("n > 2")


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def multi_source_sites(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers > 1")


@query("""SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1 HAVING count(*) = 1""")
def single_use(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("l_partkey")).where("n = 1").drop("n")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type <> 'view') AS others FROM events GROUP BY user_id""")
def alias_reads(spark, sf):
    view = F.col("event_type") == "view"
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(view).alias("views"), F.count_if(~view).alias("others"))


@query("""WITH t AS (SELECT DISTINCT p_brand || '-' || p_size AS a FROM part WHERE p_size > 9)
SELECT name, suggestion, d::INT AS distance FROM (SELECT x.a AS name, y.a AS suggestion, levenshtein(x.a, y.a) AS d, row_number() OVER (PARTITION BY x.a ORDER BY levenshtein(x.a, y.a), y.a) AS r
FROM t x JOIN t y ON x.a <> y.a AND abs(length(x.a) - length(y.a)) <= 2 WHERE levenshtein(x.a, y.a) <= 2) WHERE r = 1""")
def undefined_suggestion(spark, sf):
    t = table(spark, sf, "part").where("p_size > 9").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("name")).distinct()
    return X.suggestions(t, t)


@query("""SELECT user_id, event_type, count(*) AS evaluations FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND min(floor(coalesce(value, 0) / 1000)) = max(floor(coalesce(value, 0) / 1000))""")
def constant_conditions(spark, sf):
    v = F.floor(F.coalesce("value", F.lit(0.0)) / 1000)
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("evaluations"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return g.where("evaluations >= 3 and lo = hi").select("user_id", "event_type", "evaluations")


@query("""WITH f AS (SELECT user_id, min(event_id) AS declared FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT f.user_id, declared, count(*) AS earlier FROM f JOIN events e ON e.user_id = f.user_id AND e.event_id < declared AND e.event_type = 'view' GROUP BY 1, 2""")
def option_after_use(spark, sf):
    e = table(spark, sf, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("declared"))
    return e.where("event_type = 'view'").join(first, "user_id").where("event_id < declared").groupBy("user_id", "declared").agg(F.count("*").alias("earlier"))


@query("""SELECT DISTINCT user_id, CASE WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase') THEN 'warning' ELSE 'note' END AS severity FROM events e WHERE event_type = 'error'""")
def scope_leaks_severity(spark, sf):
    e = table(spark, sf, "events")
    clash = e.where("event_type = 'purchase'").select("user_id").distinct().withColumn("clash", F.lit(True))
    return e.where("event_type = 'error'").select("user_id").distinct().join(clash, "user_id", "left").select("user_id", F.when(F.col("clash"), "warning").otherwise("note").alias("severity"))


@query("""SELECT user_id, count(*) AS runs FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error' AND value > 90) AND NOT bool_or(event_type = 'purchase' AND value > 90)""")
def exec_unchecked(spark, sf):
    e = F.col("event_type")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("runs"), F.bool_or((e == "error") & (F.col("value") > 90)).alias("a"), F.bool_or((e == "purchase") & (F.col("value") > 90)).alias("b"))
    return g.where("not a and not b").select("user_id", "runs")


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1""")
def cache_force_sites(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9a-f]{40}') THEN 'pinned' WHEN regexp_matches(text, '[0-9]') THEN 'mutable' ELSE 'none' END AS pinning FROM documents""")
def pinning_class(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(t.rlike("[0-9a-f]{40}"), "pinned").when(t.rlike("[0-9]"), "mutable").otherwise("none").alias("pinning"))


@query("""SELECT n_name, rule FROM nation LEFT JOIN (VALUES (0, 'keep'), (1, 'warn'), (2, 'old')) p(k, rule) ON n_regionkey = k""")
def policy_lookup(spark, sf):
    rules = spark.createDataFrame([(0, "keep"), (1, "warn"), (2, "old")], "n_regionkey int, rule string")
    return table(spark, sf, "nation").join(F.broadcast(rules), "n_regionkey", "left").select("n_name", "rule")


@query("""SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_discount = 0)""")
def noop_calls(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_discount") == 0).alias("noop")).where("noop").select("l_orderkey")


@query("""SELECT user_id, count(*) AS n, min(event_id) AS first_site, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS sites FROM events WHERE event_type NOT IN ('view', 'click') AND user_id % 7 <> 0 GROUP BY 1""")
def env_dependence(spark, sf):
    e = table(spark, sf, "events").where("event_type not in ('view', 'click') and user_id % 7 <> 0")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_site"), ids.alias("sites"))


@query(f"WITH RECURSIVE {GRAPH}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM reach")
def forward_closure(spark, sf):
    return graph.closure(links(spark, sf))


@query(f"WITH RECURSIVE {GRAPH}, c AS (SELECT dst AS target, src AS consumer, visibility FROM edges UNION SELECT c.target, e.src, e.visibility FROM c JOIN edges e ON e.dst = c.consumer WHERE c.visibility <> 'PRIVATE') SELECT DISTINCT target, consumer FROM c")
def reverse_reexport(spark, sf):
    return graph.consumers(links(spark, sf))


@query(f"""WITH RECURSIVE {GRAPH}, p AS (SELECT src, dst, [src, dst] AS path FROM edges WHERE src < 5 AND dst <> src
UNION ALL SELECT p.src, e.dst, list_append(path, e.dst) FROM p JOIN edges e ON e.src = p.dst WHERE e.visibility <> 'PRIVATE' AND p.dst <> 7 AND NOT list_contains(path, e.dst) AND len(path) < 7)
SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS hops FROM p WHERE dst = 7""")
def simple_paths(spark, sf):
    start = spark.range(5).select(F.col("id").cast("int").alias("src"))
    paths = graph.simple_paths(links(spark, sf), start, lambda c: F.col(c) == 7, 6)
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("hops"))


@query(f"WITH RECURSIVE {GRAPH}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def cyclic_links(spark, sf):
    return graph.cyclic(links(spark, sf))


@query(f"""WITH RECURSIVE {GRAPH}, open AS (SELECT DISTINCT src, dst FROM edges WHERE visibility <> 'PRIVATE'), d AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
c AS (SELECT src, dst AS via, dst AS at, 0 AS hops FROM d UNION SELECT c.src, c.via, o.dst, c.hops + 1 FROM c JOIN open o ON c.at = o.src WHERE c.hops < 8 AND o.dst <> c.src AND o.dst <> c.via),
s AS (SELECT c.src, c.at AS dst, via, min(hops) AS hops FROM c SEMI JOIN d ON d.src = c.src AND d.dst = c.at WHERE c.at <> via GROUP BY ALL)
SELECT src, dst, via, hops FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, via) AS r FROM s) WHERE r = 1""")
def redundant_links(spark, sf):
    return graph.redundant(links(spark, sf))


@query("""SELECT s_suppkey, s_name || ' <- ' || n_name || ' <- ' || r_name AS chain FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def call_chain(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", F.concat_ws(" <- ", "s_name", "n_name", "r_name").alias("chain"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS cmd FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT f.o_custkey, cmd, count(*) AS affected FROM f JOIN orders o ON o.o_custkey = f.o_custkey AND o.o_orderkey > cmd GROUP BY 1, 2""")
def dir_command_targets(spark, sf):
    o = table(spark, sf, "orders")
    first = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("cmd"))
    return o.join(first, "o_custkey").where("o_orderkey > cmd").groupBy("o_custkey", "cmd").agg(F.count("*").alias("affected"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey, 'direct' AS route FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_suppkey, 'directory' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_suppkey, 'transitive' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O')
SELECT l_partkey, l_suppkey, count(DISTINCT route) AS routes FROM r GROUP BY 1, 2 HAVING count(DISTINCT route) >= 2""")
def shadowed_routes(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    part = lambda df, name: df.select("l_partkey", "l_suppkey", F.lit(name).alias("route"))
    r = part(l.where("l_returnflag = 'A'"), "direct").unionByName(part(l.where("l_returnflag = 'R'"), "directory")).unionByName(part(l.join(o.where("o_orderstatus = 'O'"), l.l_orderkey == o.o_orderkey), "transitive"))
    return r.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("route").alias("routes")).where("routes >= 2")


def _year(spark, sf, year):
    return table(spark, sf, "orders").where(F.year("o_orderdate") == year).select("o_custkey").distinct()


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)
SELECT o_custkey, 'only_left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT o_custkey, 'only_right' FROM (FROM b EXCEPT FROM a)""")
def diff_targets(spark, sf):
    return compare.difference(_year(spark, sf, 1995), _year(spark, sf, 1996), ["o_custkey"])


@query("""WITH l AS (SELECT l_partkey, l_suppkey, year(l_shipdate) AS y FROM lineitem), a AS (SELECT DISTINCT l_partkey, l_suppkey FROM l WHERE y = 1995), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM l WHERE y = 1996),
r AS (SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS t FROM (FROM a EXCEPT FROM b) GROUP BY 1), d AS (SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS t FROM (FROM b EXCEPT FROM a) GROUP BY 1)
SELECT coalesce(r.l_partkey, d.l_partkey) AS l_partkey, coalesce(r.t, '') AS removed, coalesce(d.t, '') AS added FROM r FULL JOIN d ON r.l_partkey = d.l_partkey""")
def diff_requirements(spark, sf):
    l = table(spark, sf, "lineitem")
    side = lambda y: l.where(F.year("l_shipdate") == y).select("l_partkey", "l_suppkey")
    return compare.set_difference(side(1995), side(1996), ["l_partkey"], "l_suppkey")


@query("""SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def intersect_recordings(spark, sf):
    return compare.in_all([_year(spark, sf, y) for y in (1995, 1996, 1997)], ["o_custkey"])


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = o.o_custkey AND year(b.o_orderdate) = 1995)""")
def baseline_ratchet(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return compare.not_in_baseline(o, _year(spark, sf, 1995), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, coalesce(s, 'note') AS severity, CASE coalesce(s, 'note') WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS rank FROM orders LEFT JOIN (VALUES ('1-URGENT', 'error'), ('2-HIGH', 'warning')) v(p, s) ON p = o_orderpriority""")
def severity_override(spark, sf):
    v = spark.createDataFrame([("1-URGENT", "error"), ("2-HIGH", "warning")], "o_orderpriority string, s string")
    s = F.coalesce("s", F.lit("note"))
    return table(spark, sf, "orders").join(F.broadcast(v), "o_orderpriority", "left").select("o_orderkey", s.alias("severity"), F.when(s == "error", 2).when(s == "warning", 1).otherwise(0).alias("rank"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT page_id, path FROM p WHERE path = (SELECT split_part(min(path), '/', 1) FROM p) OR starts_with(path, (SELECT split_part(min(path), '/', 1) FROM p) || '/')""")
def path_filter(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    host = p.agg(F.split_part(F.min("path"), F.lit("/"), F.lit(1)).alias("host"))
    return p.crossJoin(F.broadcast(host)).where(X.under("path", "host")).select("page_id", "path")  # one row on the right


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_:.+-])License($|[^A-Za-z0-9_:.+-])')""")
def mention_token(spark, sf):
    return table(spark, sf, "documents").where(X.mentions_token(F.col("text"), "License")).select("doc_id")


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM g)
SELECT user_id, event_type, n, k::INT AS rank, total FROM r WHERE k <= 3""")
def explain_arg_sets(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by = W.partitionBy("user_id")
    return g.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), "event_type")), "total": F.count("*").over(by)}).where("rank <= 3")


@query("""WITH a AS (SELECT DISTINCT lower(c_mktsegment) AS k FROM customer), b AS (SELECT upper(o_orderpriority) AS p, o_orderkey FROM orders) SELECT c_mktsegment, count(*) AS n, min(o_orderkey) AS first_order FROM customer JOIN orders ON c_custkey = o_custkey WHERE lower(c_mktsegment) IN (SELECT k FROM a) GROUP BY 1""")
def deps_inventory(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    names = c.select(F.lower("c_mktsegment").alias("k")).distinct()
    named = c.join(names, F.lower(c.c_mktsegment) == names.k, "left_semi")
    return named.join(o, named.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def args_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1""")
def list_flatten(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY (l_returnflag = 'A') DESC, l_linenumber) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = 1""")
def event_node_join(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey)
    return temporal.first_per_key(j, ["o_orderkey"], [F.desc(F.col("l_returnflag") == "A"), "l_linenumber"]).select("o_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events WHERE event_type = 'click' GROUP BY 1) SELECT e.event_id, s.lo, s.hi FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN s.lo AND s.hi""")
def interval_containment(spark, sf):
    e = table(spark, sf, "events")
    s = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return e.join(s, "user_id").where("event_id between lo and hi").select("event_id", "lo", "hi")


@query("""WITH RECURSIVE a AS (SELECT n_nationkey AS name, CASE WHEN n_nationkey > 5 THEN n_nationkey // 2 END AS alias_of FROM nation), r AS (SELECT name, name AS cur FROM a UNION SELECT r.name, a.alias_of FROM r JOIN a ON a.name = r.cur WHERE a.alias_of IS NOT NULL)
SELECT name, min(cur) AS resolved FROM r GROUP BY 1""")
def alias_resolution(spark, sf):
    k = F.col("n_nationkey")
    return graph.resolve_aliases(table(spark, sf, "nation").select(k.alias("name"), F.when(k > 5, F.floor(k / 2).cast("int")).alias("alias_of")))


USER_SQL = "SELECT 'events' AS file, event_id AS line, 'error of user ' || user_id AS message, 'warning' AS severity FROM events WHERE event_type = 'error' AND value > 50"


@query(USER_SQL)
def user_sql_pass(spark, sf):
    return spark.sql(USER_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query("""SELECT n_name, lower(lpad(to_hex(list_reduce([14695981039346656037::UHUGEINT] || list_transform(string_split(n_name, ''), lambda c: ascii(c)::UHUGEINT),
lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0')) AS fingerprint FROM nation""")
def fingerprint(spark, sf):
    session.ship(spark)
    return table(spark, sf, "nation").select("n_name", X.fnv1a(F.col("n_name")).alias("fingerprint"))


RECORDINGS = 16


def replayed(spark: SparkSession, sf_dir: str, reads: str = "event_type = 'view'") -> dict[str, DataFrame]:
    """The events as 16 recordings of a build: a click sets its user's variable, a purchase unsets it, a view that counts as a read reads it; each event is a line of its own."""
    e = table(spark, sf_dir, "events").where(f"event_type in ('click', 'purchase') or ({reads})")
    name, value = F.concat(F.lit("V"), F.col("user_id")), F.round(F.col("value") * 100).cast("long").cast("string")
    cmd = F.when(F.col("event_type") == "click", "set").when(F.col("event_type") == "purchase", "unset").otherwise("message")
    rows = e.select(
        F.concat(F.lit("r"), F.col("user_id") % RECORDINGS).alias("recording"), F.lit("/src/a").alias("file"), F.col("event_id").alias("line"), cmd.alias("cmd"), cmd.alias("cmd_lower"),
        F.when(F.col("event_type") == "click", F.array(name, value)).when(F.col("event_type") == "purchase", F.array(name)).otherwise(F.array(F.lit(""))).alias("args"),
        (F.col("us") / 1e6).alias("time_abs"), F.lit(0).cast("long").alias("frame"), F.lit(1).cast("long").alias("global_frame"), name.alias("name"))
    events = trace.number(rows, "line")
    none = F.array().cast("array<string>")
    commands = events.select(
        "recording", "file", F.col("line").alias("node_id"), F.col("cmd").alias("name"), F.col("cmd").alias("name_lower"), F.lit("").alias("args_text"), F.transform("args", lambda a: F.struct(F.lit("bare").alias("kind"), a.alias("value"))).alias("args"),
        "line", F.col("line").alias("byte_start"), F.col("line").alias("byte_end"), F.when(F.col("cmd") == "message", F.array("name")).otherwise(none).alias("var_refs"), none.alias("env_refs"), F.array().cast("array<struct<kind:string,node_id:bigint,head:string>>").alias("blocks"))
    events = events.drop("name")
    files = events.select("recording", F.col("file").alias("path")).distinct().withColumn("in_source", F.lit(1))
    session.ship(spark)
    # the plan stays whole where no shared checkpoint folder is set
    log = session.cut(sequential.log(events, commands))
    return {"files": files, "commands": commands} | sequential.tables(events, log)


REPLAYED = f"""t AS (SELECT user_id, event_id, event_type, {CENTS} AS v FROM events)"""


@query(f"""WITH {REPLAYED} SELECT r.event_id AS line, 'V' || r.user_id AS name, CASE WHEN w.event_type = 'click' THEN w.event_id END AS write_line, CASE WHEN w.event_type = 'click' THEN w.v::VARCHAR END AS value
FROM (FROM t WHERE event_type = 'view') r ASOF LEFT JOIN (FROM t WHERE event_type IN ('click', 'purchase')) w ON r.user_id = w.user_id AND r.event_id > w.event_id""")
def replayed_reads(spark, sf):
    t = replayed(spark, sf)
    at = t["events"].select("recording", "event_id", "line")
    w = t["var_writes"].join(at, ["recording", "event_id"]).select("recording", F.col("write_id").alias("resolved_write_id"), F.col("line").alias("write_line"), "value")
    return t["var_reads"].join(at, ["recording", "event_id"]).join(w, ["recording", "resolved_write_id"], "left").select("line", "name", "write_line", "value")


@query(f"""WITH {REPLAYED}, w AS (SELECT *, lead(event_id) OVER k AS next_line, lead(v) OVER k AS next_v FROM t WHERE event_type = 'click' WINDOW k AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id AS line, 'V' || user_id AS name, next_line FROM w WHERE v <> next_v AND NOT EXISTS (SELECT 1 FROM t r WHERE r.user_id = w.user_id AND r.event_type = 'view' AND r.event_id > w.event_id AND r.event_id < w.next_line
AND NOT EXISTS (SELECT 1 FROM t u WHERE u.user_id = w.user_id AND u.event_type = 'purchase' AND u.event_id > w.event_id AND u.event_id < r.event_id))""")
def replayed_clobbers(spark, sf):
    f = values.clobbers(Store(replayed(spark, sf)), Config())
    return f.select("line", F.regexp_extract("message", "^'([^']*)'", 1).alias("name"), F.col("related")[0]["line"].alias("next_line"))


@query(f"""WITH {REPLAYED} SELECT 'V' || user_id AS name, min(event_id) AS line FROM t WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM t WHERE event_type = 'view' AND v > 7000) GROUP BY user_id""")
def replayed_dead_variables(spark, sf):
    t = replayed(spark, sf, "event_type = 'view' and round(value * 100) > 7000")
    own = t["commands"].withColumn("var_refs", F.array().cast("array<string>"))
    return dead.variables(Store(t | {"commands": own}), Config()).select(F.regexp_extract("message", "'([^']*)'", 1).alias("name"), "line")


@query("""WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_id, turn % 2 AS deep FROM conversations)
SELECT conv_id, event_id, CASE WHEN deep = 1 THEN 1 + sum(deep) OVER (PARTITION BY conv_id ORDER BY event_id) ELSE 1 END::BIGINT AS scope_id FROM e""")
def replayed_scopes(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("recording"), "conv_id", F.lit("/src/a").alias("file"), F.col("turn").alias("line"), F.col("role").alias("cmd"), F.lower("role").alias("cmd_lower"), F.array().cast("array<string>").alias("args"), F.lit(0.0).alias("time_abs"), F.lit(0).cast("long").alias("frame"), (F.col("turn") % 2 + 1).alias("global_frame"))
    events = trace.number(rows, "line")
    session.ship(spark)
    return sequential.tables(events, sequential.log(events))["events"].select("conv_id", "event_id", "scope_id")


# --- operators on names, places, graphs and recordings whose SQL states the outcome ---


@query("SELECT p_partkey, p_partkey % 10 = 3 AND p_partkey % 6 <> 5 AS same FROM part")
def same_library(spark, sf):
    k = F.col("p_partkey")
    z = F.concat(F.lit("z"), (k % 10).cast("string"))
    forms = [z, F.concat(F.lit("-l"), z), F.concat(F.lit("/usr/lib/lib"), z, F.lit(".so")), F.concat(F.lit("Big::"), F.upper(z)), F.concat(F.lit("out\\"), z, F.lit(".lib")), F.concat(z, F.lit("x"))]
    written = F.get(F.array(*forms), (k % 6).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.same_library(written, F.lit(None).cast("string"), "z3").alias("same"))


HUMAN_US = "CASE event_id % 3 WHEN 0 THEN event_id % 1000 WHEN 1 THEN (event_id % 999 + 1) * 1000 ELSE (event_id % 500 + 100) * 10000 END"


@query(f"""SELECT event_id, CASE WHEN us < 1000 THEN us || ' us' WHEN us < 1000000 THEN printf('%.1f ms', us / 1000) ELSE printf('%.2f s', us / 1000000) END AS shown FROM (SELECT event_id, {HUMAN_US} AS us FROM events)""")
def human_times(spark, sf):
    return table(spark, sf, "events").select("event_id", X.human_time(F.expr(HUMAN_US)).alias("shown"))


@query("""WITH p AS (SELECT doc_id, left(text, (doc_id * 37 % (length(text) + 1))::BIGINT) AS p FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, p, string_split(p, chr(10))[-1] AS last FROM p)
SELECT doc_id, (length(p) - length(replace(p, chr(10), '')))::INT AS line, (length(last) + len(list_filter(string_split(last, ''), lambda c: unicode(c) > 65535)))::INT AS col FROM l""")
def editor_positions(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("n", (F.col("doc_id") * 37 % (F.char_length("text") + 1)).cast("int"))
    at = X.line_and_column(F.col("text"), F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("n"))))
    return d.select("doc_id", at.alias("at")).select("doc_id", "at.line", F.col("at.column").alias("col"))


@query("""SELECT doc_id, nullif(regexp_extract(left(l, c), '[A-Za-z0-9_]*$') || regexp_extract(substr(l, c + 1), '^[A-Za-z0-9_]*'), '') AS word FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l, doc_id % 60 AS c FROM documents WHERE text IS NOT NULL)""")
def word_under_cursor(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.word_at(F.substring_index("text", "\n", 1), (F.col("doc_id") % 60).cast("int")).alias("word"))


CHAIN = 200


@query(f"SELECT a.range::BIGINT AS src, b.range::BIGINT AS dst FROM range({CHAIN + 1}) a, range({CHAIN + 1}) b WHERE a.range < b.range")
def chain_closure(spark, sf):
    n = spark.range(CHAIN)
    return graph.closure(n.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


@query(f"""WITH RECURSIVE {GRAPH}, reach AS (SELECT src, dst, 1 AS hops FROM edges UNION SELECT r.src, e.dst, hops + 1 FROM reach r JOIN edges e ON r.dst = e.src WHERE hops < 25),
first AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT src AS component, min(hops) AS hops FROM reach WHERE src = dst AND src IN (SELECT component FROM first) GROUP BY 1""")
def shortest_cycles(spark, sf):
    return graph.shortest_cycle(links(spark, sf)).select("component", (F.size("path") - 1).alias("hops"))


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS node, c_custkey AS ancestor, 0 AS hops FROM customer UNION ALL SELECT node, ancestor // 2, hops + 1 FROM a WHERE ancestor > 1) SELECT node, ancestor, hops FROM a""")
def scope_ancestors(spark, sf):
    k = F.col("c_custkey")
    return graph.ancestors(table(spark, sf, "customer").select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent_id")))


@query("""SELECT (c_custkey % 8)::VARCHAR AS recording, c_custkey::VARCHAR AS key, coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS value FROM customer""")
def meta_upsert(spark, sf):
    of = lambda df, c, value, *more: df.select((F.col(c) % 8).cast("string").alias("recording"), F.col(c).cast("string").alias("key"), F.col(value).alias("value"), *more)
    return recording.put_meta(of(table(spark, sf, "customer"), "c_custkey", "c_mktsegment"), of(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey").alias("seq")))


@query("""WITH q AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS v, year(o_orderdate) % 2 AS odd FROM orders), qa AS (SELECT DISTINCT k, v FROM q WHERE odd = 0), qb AS (SELECT DISTINCT k, v FROM q WHERE odd = 1),
both_sides AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey NOT IN (3, 4)), lost AS (SELECT * FROM qa EXCEPT SELECT * FROM qb), gained AS (SELECT * FROM qb EXCEPT SELECT * FROM qa)
SELECT 'target disappeared: t' || c_custkey AS problem FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'target appeared: t' || c_custkey FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 't' || k || ': lost define ' || chr(39) || v || chr(39) FROM lost SEMI JOIN both_sides USING (k) UNION ALL SELECT 't' || k || ': gained define ' || chr(39) || v || chr(39) FROM gained SEMI JOIN both_sides USING (k)""")
def graph_isomorphism(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    name = lambda k: F.concat(F.lit("t"), F.col(k).cast("string"))
    side = lambda r, skip: c.where(F.col("c_nationkey") != skip).select(F.lit(r).alias("recording"), name("c_custkey").alias("name"), F.lit(1).alias("in_file_api"))
    req = o.select(F.when(F.year("o_orderdate") % 2 == 0, "a").otherwise("b").alias("recording"), name("o_custkey").alias("target"), F.lit("define").alias("kind"), F.col("o_orderstatus").alias("value"), F.lit("fileapi").alias("source"))
    return questions.isomorphic(Store({"targets": side("a", 3).unionByName(side("b", 4)), "usage_reqs": req}), "a", "b")


RULE_SQL = "SELECT 'events' AS file, user_id AS line, 'has ' || count(*) || ' errors' AS message FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 2"


@query(f"SELECT 'too-many-errors' AS rule, 'warning' AS severity, file, line, message FROM ({RULE_SQL})")
def sql_rule_findings(spark, sf):
    return questions.sql_rule(spark, {"events": table(spark, sf, "events")}, "too-many-errors", RULE_SQL, most=None).select("rule", "severity", "file", "line", "message")


@query(f"""WITH e AS (SELECT user_id % 8 AS r, user_id, event_id, event_type, {CENTS} AS v FROM events WHERE event_type IN ('click', 'purchase', 'view'))
SELECT 'rec' || r AS recording, 'V' || user_id AS name, count(*) AS writes, max(CASE WHEN event_type = 'click' THEN v END)::VARCHAR AS largest, max(n)::BIGINT AS events
FROM e JOIN (SELECT r, count(*) AS n FROM e GROUP BY r) USING (r) WHERE event_type <> 'view' GROUP BY ALL""")
def ingested_recordings(spark, sf):
    """Eight traces as files of JSON lines, ingested, saved, and loaded again."""
    name, kind = F.concat(F.lit("V"), F.col("user_id")), F.col("event_type")
    e = table(spark, sf, "events").where(kind.isin("click", "purchase", "view"))
    cmd = F.when(kind == "click", "set").when(kind == "purchase", "unset").otherwise("message")
    args = F.when(kind == "click", F.array(name, F.round(F.col("value") * 100).cast("long").cast("string"))).when(kind == "purchase", F.array(name)).otherwise(F.array(F.lit("x")))
    event = F.struct(F.lit("/src/a").alias("file"), F.lit(1).alias("line"), cmd.alias("cmd"), args.alias("args"), (F.col("us") / 1e6).alias("time"), F.lit(1).alias("frame"), F.lit(1).alias("global_frame"))
    rows = e.select((F.col("user_id") % 8).cast("int").alias("r"), F.col("event_id").alias("at"), F.to_json(event).alias("value"))
    heads = spark.range(8).select(F.col("id").cast("int").alias("r"), F.lit(-1).cast("long").alias("at"), F.lit('{"version":{"major":1,"minor":2}}').alias("value"))
    folder = f"{session.shared_folder(spark) or 'file://' + tempfile.mkdtemp(prefix='tracemill-')}/traces-{uuid.uuid4().hex}"
    session.delete_at_exit(spark, folder)
    # a trace is one file, so its lines are one task's to write
    lines = rows.unionByName(heads).withColumn("folder", F.concat(F.lit("rec"), F.col("r").cast("string"))).repartition(8, "folder").sortWithinPartitions("folder", "at").select("folder", "value")
    lines.write.partitionBy("folder").text(f"{folder}/raw")
    sources = spark.createDataFrame([(f"folder=rec{i}", "/src/a", "") for i in range(8)], "recording string, path string, content string")
    recording.save(recording.ingest(spark, f"{folder}/raw/*/*.txt", sources, "/src"), f"{folder}/saved")
    t = recording.load(spark, f"{folder}/saved")
    n = t["events"].groupBy("recording").agg(F.count("*").alias("events"))
    w = t["var_writes"].groupBy("recording", "name").agg(F.count("*").alias("writes"), F.max(F.col("value").cast("long")).cast("string").alias("largest"))
    return w.join(n, "recording").select(F.substring_index("recording", "=", -1).alias("recording"), "name", "writes", "largest", "events")


def queries() -> dict[str, Query]:
    return _QUERIES | recorded.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | recorded.oracle_sql()
