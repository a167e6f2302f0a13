"""Registered queries and their SQL: one entry for each operator family of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import arrays, keyed, text
from ..operators import expand, multiset, rows
from ..seq import Seq, fair_cross, interleaved, zipped
from ..sources import generators
from ..streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (table reader, session) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders(read, *columns: str) -> Seq:
    return Seq(read("orders").select("o_orderkey", *columns), ["o_orderkey"])


def by_customer(read, *columns: str) -> Seq:
    return Seq(read("orders").select("o_custkey", "o_orderkey", *columns), ["o_orderkey"], ["o_custkey"])


def events(read, *columns: str) -> Seq:
    return Seq(read("events").select("user_id", "ts", "event_id", *columns), ["ts", "event_id"], ["user_id"])


def cents(c: str):
    """Money as a whole number of cents, so that sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


N = "row_number() over (order by o_orderkey) - 1"
K = "row_number() over (partition by o_custkey order by o_orderkey) - 1"
US = "epoch_us(ts)"

# 2.1 sources


@query("SELECT range AS value FROM range(10, 1001, 3)")
def enumerate_from_then_to(read, spark):
    return generators.enumerate_from_then_to(spark, 10, 13, 1000)


@query("SELECT 1.0::DOUBLE + range * 0.25::DOUBLE AS value FROM range(0, 37)")
def enumerate_fractional(read, spark):
    return generators.enumerate_fractional(spark, 1.0, 1.25, 10.0)


@query("SELECT range AS index, range * range AS value FROM range(0, 500)")
def generate_from_indices(read, spark):
    return generators.generate(spark, 500, lambda i: i * i)


@query("SELECT 7::BIGINT AS value FROM range(0, 100)")
def replicate(read, spark):
    return generators.replicate(spark, 100, F.lit(7).cast("long"))


@query("WITH RECURSIVE t(index, value) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT index + 1, (value * 3 + 1) % 1000 FROM t WHERE index < 49) SELECT * FROM t")
def iterate(read, spark):
    return generators.iterate(spark, 1, "(x * 3 + 1) % 1000", 50)


# 2.2 projections


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) // 7 AS value FROM orders")
def map_values(read, spark):
    return rows.mapped(read("orders"), ["o_orderkey"], value=F.expr("cast(round(o_totalprice * 100) as bigint) div 7"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def map_maybe(read, spark):
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.map_maybe(read("events"), ["event_id"], "k", F.when(k % 2 == 0, k))


@query(f"SELECT o_orderkey, {N} AS index FROM orders")
def indexed(read, spark):
    return orders(read).indexed()


@query("SELECT o_orderkey, row_number() over (order by o_orderkey desc) - 1 AS index FROM orders")
def indexed_reverse(read, spark):
    return orders(read).indexed(reverse=True)


@query("SELECT o_custkey, o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) - lag(CAST(round(o_totalprice*100) AS BIGINT)) over (partition by o_custkey order by o_orderkey) AS diff FROM orders")
def rolling_map(read, spark):
    return by_customer(read, "o_totalprice").rolling("diff", lambda p, x: x - p, cents("o_totalprice")).drop("o_totalprice")


@query("SELECT * FROM (SELECT o_orderkey, o_orderkey - lag(o_orderkey) over (order by o_orderkey) AS step FROM orders) WHERE step IS NOT NULL")
def rolling_map_pairs(read, spark):
    return orders(read).rolling("step", lambda p, x: x - p, F.col("o_orderkey"), pairs_only=True)


# 2.3 filters and trims


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_rows(read, spark):
    return rows.filtered(read("orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) over (partition by user_id order by ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def uniq(read, spark):
    return events(read, "event_type").uniq("event_type").drop("ts")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def delete_first(read, spark):
    return orders(read, "o_orderstatus").delete_first(F.col("o_orderstatus") == "F")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {N} AS i FROM orders) WHERE i >= 3 AND (i - 3) % 10 = 0")
def stride(read, spark):
    return orders(read).stride(3, 10)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def take(read, spark):
    return orders(read).take(100)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {N} AS i FROM orders) WHERE i >= 100")
def drop(read, spark):
    return orders(read).drop(100)


@query(f"SELECT o_custkey, o_orderkey FROM (SELECT *, {K} AS i FROM orders) WHERE i < 2")
def take_per_key(read, spark):
    return by_customer(read).take(2)


_NOT_F = "sum(CASE WHEN o_totalprice < 400000 THEN 0 ELSE 1 END) over (order by o_orderkey rows unbounded preceding)"


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_NOT_F} AS f FROM orders) WHERE f = 0")
def take_while(read, spark):
    return orders(read, "o_totalprice").take_while(F.col("o_totalprice") < 400000).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {_NOT_F} AS f FROM orders) WHERE f > 0")
def drop_while(read, spark):
    return orders(read, "o_totalprice").drop_while(F.col("o_totalprice") < 400000).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) AS f FROM orders) WHERE f = 0")
def take_end_by(read, spark):
    return by_customer(read, "o_orderstatus").take_end_by(F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) over (partition by o_custkey order by o_orderkey rows unbounded preceding) AS f FROM orders) WHERE f = 0")
def take_end_by_dropping(read, spark):
    return by_customer(read, "o_orderstatus").take_end_by(F.col("o_orderstatus") == "F", keep=False).drop("o_orderstatus")


@query(f"SELECT index, o_orderkey FROM (SELECT o_orderkey, o_orderstatus, {N} AS index FROM orders) WHERE o_orderstatus = 'P'")
def find_indices(read, spark):
    return orders(read, "o_orderstatus").find_indices(F.col("o_orderstatus") == "P").select("index", "o_orderkey")


@query(f"SELECT o_orderkey, i < 1000 AS first FROM (SELECT o_orderkey, {N} AS i FROM orders)")
def split_at(read, spark):
    return orders(read).split_at(1000, "first")


@query("SELECT doc_id, md5(replace(text, 'the', '<>')) AS replaced, md5(replace(text, 'the', '')) AS dropped FROM documents")
def replace_and_drop_matches(read, spark):
    return read("documents").select("doc_id", F.md5(text.replace_matches(F.col("text"), "the", "<>")).alias("replaced"), F.md5(text.replace_matches(F.col("text"), "the", "")).alias("dropped"))


# 2.4 and 2.5 joins and sets


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > n_regionkey * 1000")
def inner_join(read, spark):
    on = (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > F.col("n_regionkey") * 1000)
    return multiset.theta_join(read("customer"), read("nation"), on).select("c_custkey", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def left_join(read, spark):
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 300000)
    return multiset.theta_join(read("customer"), read("orders"), on, "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def outer_join(read, spark):
    on = (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))
    return multiset.theta_join(read("supplier"), read("customer"), on, "full").select("s_suppkey", "c_custkey")


_LAST = "(SELECT o_custkey AS k, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)"


@query(f"SELECT c_custkey AS k, c_name, o_orderkey FROM customer JOIN {_LAST} ON c_custkey = k")
def map_join_inner(read, spark):
    return multiset.map_join(read("customer").select(F.col("c_custkey").alias("k"), "c_name"), read("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], ["o_orderkey"])


@query(f"SELECT c_custkey AS k, c_name, o_orderkey FROM customer LEFT JOIN {_LAST} ON c_custkey = k")
def map_join_left(read, spark):
    return multiset.map_join(read("customer").select(F.col("c_custkey").alias("k"), "c_name"), read("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], ["o_orderkey"], "left")


@query(f"SELECT coalesce(a.k, b.k) AS k, a.s_suppkey, b.o_orderkey FROM (SELECT s_nationkey::BIGINT AS k, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) a FULL JOIN {_LAST} b ON a.k = b.k")
def map_join_full(read, spark):
    return multiset.map_join(read("supplier").select(F.col("s_nationkey").cast("long").alias("k"), "s_suppkey"), read("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), ["k"], ["s_suppkey", "o_orderkey"], "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(read, spark):
    some = read("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return multiset.intersect_by(read("customer").select("c_custkey"), some, ["c_custkey"])


@query("SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def distinct_first(read, spark):
    return multiset.first_of_each(read("lineitem").select("l_partkey", "l_orderkey"), ["l_partkey"], ["l_orderkey"])


@query("SELECT n_nationkey, r_regionkey, i + j AS diagonal FROM (SELECT n_nationkey, row_number() over (order by n_nationkey) - 1 AS i FROM nation) CROSS JOIN (SELECT r_regionkey, row_number() over (order by r_regionkey) - 1 AS j FROM region)")
def fair_cross_diagonal(read, spark):
    out = fair_cross(Seq(read("nation").select("n_nationkey"), ["n_nationkey"]), Seq(read("region").select("r_regionkey"), ["r_regionkey"]))
    return out.select("n_nationkey", "r_regionkey", "diagonal")


@query("SELECT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def intersect_by(read, spark):
    rich = read("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return multiset.intersect_by(read("lineitem").select("l_suppkey"), rich, ["l_suppkey"])


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def delete_firsts(read, spark):
    left = read("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return multiset.delete_firsts(left, read("customer").select(F.col("c_custkey").alias("k")), ["k"], ["o_orderkey"]).select("k")


@query("SELECT s_nationkey AS k, 0 AS part FROM supplier UNION ALL SELECT DISTINCT c_nationkey, 1 FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def union_by(read, spark):
    left = read("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("at"))
    right = read("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at"))
    return multiset.union_by(left, right, ["k"], ["at"]).select("k", "part")


@query("SELECT s_suppkey AS k, turn, 0 AS part FROM (SELECT s_suppkey, row_number() over (order by s_suppkey) - 1 AS turn FROM supplier) UNION ALL SELECT c_custkey, row_number() over (order by c_custkey) - 1, 1 FROM customer")
def interleave(read, spark):
    return interleaved([Seq(read("supplier").select(F.col("s_suppkey").alias("k")), ["k"]), Seq(read("customer").select(F.col("c_custkey").alias("k")), ["k"])], ["k"])


@query("SELECT index, s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() over (order by s_suppkey) - 1 AS index FROM supplier) JOIN (SELECT c_custkey, row_number() over (order by c_custkey) - 1 AS index FROM customer) USING (index)")
def zip_rows(read, spark):
    return zipped(Seq(read("supplier").select("s_suppkey"), ["s_suppkey"]), Seq(read("customer").select("c_custkey"), ["c_custkey"]))


# 2.6 expansion


@query("SELECT conv_id, turn, ord - 1 AS inner, w AS word FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS ord FROM conversations)")
def concat_map(read, spark):
    return expand.concat_map(read("conversations").select("conv_id", "turn", "text"), text.words(F.col("text")), "word").select("conv_id", "turn", F.col("inner").cast("long").alias("inner"), "word")


@query("WITH RECURSIVE t(node, level) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT c, level + 1 FROM t JOIN (SELECT range // 2 AS p, range AS c FROM range(2, 1000)) ON node = p) SELECT node, level FROM t")
def iterate_tree(read, spark):
    edges = spark.range(2, 1000).select(F.expr("id div 2").alias("parent"), F.col("id").alias("child"))
    return expand.iterate_tree(edges, spark.range(1, 2).select(F.col("id").alias("child"))).select("node", "level")


# 2.7 groups and segments


@query(f"SELECT i // 100 AS chunk, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT o_orderkey, {N} AS i FROM orders) GROUP BY 1")
def groups_of(read, spark):
    return orders(read).groups_of(100).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT user_id, CAST(g - 1 AS BIGINT) AS \"group\", count(*) AS n, min(event_type) AS event_type FROM (SELECT *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) AS g FROM (SELECT *, CASE WHEN lag(event_type) over (partition by user_id order by ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g")
def groups_rolling_by(read, spark):
    out = events(read, "event_type").groups_rolling_by(lambda p, x: p == x, F.col("event_type"))
    return out.groupBy("user_id", "group").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))


@query("SELECT o_custkey, CAST(segment AS BIGINT) AS segment, count(*) AS n FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) over (partition by o_custkey order by o_orderkey rows unbounded preceding) AS segment FROM orders) WHERE o_orderstatus <> 'F' GROUP BY ALL")
def split_sep_by(read, spark):
    return by_customer(read, "o_orderstatus").split_by(F.col("o_orderstatus") == "F").groupBy("o_custkey", "segment").agg(F.count("*").alias("n"))


@query("SELECT CAST(segment AS BIGINT) AS segment, min(i) AS start, count(*) AS length FROM (SELECT i, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) over (order by i rows between unbounded preceding and 1 preceding), 0) AS segment FROM (SELECT *, row_number() over (order by o_orderkey) - 1 AS i FROM orders)) GROUP BY 1")
def index_end_by(read, spark):
    ends = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).cast("long")
    out = orders(read, "o_orderstatus").running_all(i=(F.lit(1).cast("long"), "sum", True), segment=(ends, "sum", True))
    return out.groupBy("segment").agg(F.min("i").alias("start"), F.count("*").alias("length"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, '. ', '.')) + 1 AS BIGINT) AS parts FROM documents WHERE text <> '' UNION ALL SELECT doc_id, CASE WHEN text = '' THEN 0 END FROM documents WHERE text IS NULL OR text = ''")
def split_sep_by_sequence(read, spark):
    return read("documents").select("doc_id", F.size(text.split_sep_by_seq(F.col("text"), ". ")).cast("long").alias("parts"))


# 2.8 and 2.14 running aggregates

_RUN = "over (partition by user_id order by ts, event_id rows unbounded preceding)"


@query(f"SELECT event_id, CAST(sum(event_id) {_RUN} AS BIGINT) AS total, count(*) {_RUN} AS n, max(value) {_RUN} AS highest, min(value) {_RUN} AS lowest, first_value(event_type) {_RUN} AS first_type FROM events")
def postscan(read, spark):
    seq = events(read, "value", "event_type")
    w = seq.upto()
    return seq.df.select("event_id", F.sum("event_id").over(w).alias("total"), F.count("*").over(w).alias("n"), F.max("value").over(w).alias("highest"), F.min("value").over(w).alias("lowest"), F.first("event_type").over(w).alias("first_type"))


@query("SELECT o_orderkey, CAST(sum(o_custkey) over (order by o_orderkey rows unbounded preceding) AS BIGINT) AS total, CAST(coalesce(sum(o_custkey) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0) AS BIGINT) AS before FROM orders")
def running_total_without_keys(read, spark):
    seq = orders(read, "o_custkey")
    out = seq.running_all(total=(F.col("o_custkey"), "sum", False), before=(F.col("o_custkey"), "sum", True))
    return out.select("o_orderkey", "total", "before")


@query("SELECT event_id, CAST((SELECT count(DISTINCT e.event_type) FROM events e WHERE e.user_id = events.user_id AND (e.ts, e.event_id) <= (events.ts, events.event_id)) AS BIGINT) AS kinds FROM events")
def running_count_distinct(read, spark):
    return events(read, "event_type").running_distinct("kinds", "event_type").select("event_id", "kinds")


# 2.9 and 2.10 folds


@query("SELECT arg_min(o_orderkey, o_orderkey) AS head, max(o_orderkey) AS latest, count(*) AS n, count(*) = 0 AS empty, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 0) AS all_positive, min(o_orderkey) FILTER (o_orderstatus = 'P') AS found, max(o_totalprice) AS highest, min(o_totalprice) AS lowest FROM orders")
def eliminators(read, spark):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return read("orders").agg(agg.first_by(k, k).alias("head"), agg.last_by(k, k).alias("latest"), F.count("*").alias("n"), (F.count("*") == 0).alias("empty"), agg.some(status == "P").alias("any_p"), agg.every(F.col("o_totalprice") > 0).alias("all_positive"), agg.find(k, status == "P", k).alias("found"), F.max("o_totalprice").alias("highest"), F.min("o_totalprice").alias("lowest"))


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation, max(l_quantity) - min(l_quantity) AS span, CAST(sum(l_quantity * l_quantity) AS DOUBLE) AS squares FROM lineitem GROUP BY 1")
def statistics(read, spark):
    x = F.col("l_quantity")
    return read("lineitem").groupBy("l_returnflag").agg(agg.total(cents("l_extendedprice")).alias("total"), F.round(agg.mean(x), 6).alias("mean"), F.round(agg.variance(x), 6).alias("variance"), F.round(agg.std_dev(x), 6).alias("deviation"), (F.max(x) - F.min(x)).alias("span"), agg.power_sum(x, 2.0).alias("squares"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS sum_cents, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def tee_pricing_summary(read, spark):
    shipped = rows.filtered(read("lineitem"), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return keyed.classify(shipped, ["l_returnflag", "l_linestatus"], F.sum("l_quantity").alias("sum_qty"), F.sum(cents("l_extendedprice")).alias("sum_cents"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top(read, spark):
    return agg.top(read("orders").select("o_totalprice", "o_orderkey"), 10, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom(read, spark):
    return agg.top(read("orders").select("o_totalprice", "o_orderkey"), 10, [F.asc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT count(*) FILTER (l_quantity > 25) AS big, count(*) FILTER (NOT l_quantity > 25) AS small, CAST(sum(l_orderkey) FILTER (l_quantity > 25) AS BIGINT) AS big_keys FROM lineitem")
def partition_fold(read, spark):
    big, k = F.col("l_quantity") > 25, F.col("l_orderkey")
    counts, sums = agg.partition(big, F.count, F.count, k), agg.partition(big, F.sum, F.sum, k)
    return read("lineitem").agg(counts["yes"].alias("big"), counts["no"].alias("small"), sums["yes"].alias("big_keys"))


# 2.11 keyed folds


@query("SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1")
def frequency(read, spark):
    return keyed.frequency(read("lineitem").select(F.col("l_partkey").alias("k")), "k")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def count_distinct(read, spark):
    return read("lineitem").agg(agg.count_distinct(F.col("l_partkey")).alias("n"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN count(*) ELSE max(event_id) END AS v FROM events GROUP BY 1")
def demux(read, spark):
    return keyed.demux_or(read("events"), "event_type", {"click": F.count("*")}, F.max("event_id"), "v")


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS nations FROM customer GROUP BY 1")
def to_set(read, spark):
    return keyed.classify(read("customer"), ["c_mktsegment"], F.array_join(keyed.to_set(F.col("c_nationkey")).cast("array<string>"), ",").alias("nations"))


# 2.13 sliding windows

_W5 = "over (partition by o_custkey order by o_orderkey rows between 4 preceding and current row)"
_C = "CAST(round(o_totalprice*100) AS BIGINT)"


@query(f"SELECT o_orderkey, CAST(sum({_C}) {_W5} AS BIGINT) AS total, count(*) {_W5} AS n, min({_C}) {_W5} AS lowest, max({_C}) {_W5} AS highest, round(avg({_C}) {_W5}, 4) AS mean FROM orders")
def sliding_window(read, spark):
    seq = by_customer(read, "o_totalprice")
    w, x = seq.last(5), cents("o_totalprice")
    return seq.df.select("o_orderkey", F.sum(x).over(w).alias("total"), F.count("*").over(w).alias("n"), F.min(x).over(w).alias("lowest"), F.max(x).over(w).alias("highest"), F.round(F.avg(x).over(w), 4).alias("mean"))


@query("SELECT o_orderkey, array_to_string(list(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), ',') AS ring FROM orders")
def rings_of(read, spark):
    seq = by_customer(read)
    return seq.df.select("o_orderkey", F.array_join(F.collect_list("o_orderkey").over(seq.last(3)).cast("array<string>"), ",").alias("ring"))


# 2.16 time

_SESSION = f"sum(CASE WHEN p IS NULL OR {US} - p >= 21600000000 THEN 1 ELSE 0 END) over (partition by user_id order by ts, event_id rows unbounded preceding)"


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, count(DISTINCT event_type) AS kinds, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM (SELECT *, {_SESSION} AS session FROM (SELECT *, lag({US}) over (partition by user_id order by ts, event_id) AS p FROM events)) GROUP BY 1, 2")
def keep_alive_sessions(read, spark):
    """Gap sessions of each user's events, six hours apart or more."""
    out = sessions.keep_alive(events(read, "event_type", "value"), "ts", 6 * 3600)
    order = F.struct("ts", "event_id")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("total"), F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def intervals_of(read, spark):
    return sessions.intervals(read("events"), "ts", "1 hour", F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, time_bucket(INTERVAL 1 day, ts)")
def sample_interval_end(read, spark):
    return sessions.sample_interval(read("events").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["ts", "event_id"], "1 day", end=True).select("user_id", "event_id")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, time_bucket(INTERVAL 1 day, ts)")
def sample_interval_start(read, spark):
    return sessions.sample_interval(read("events").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["ts", "event_id"], "1 day", end=False).select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, lead({US}) over (partition by user_id order by ts, event_id) AS q FROM events) WHERE q IS NULL OR q - {US} >= 3600000000")
def sample_burst_end(read, spark):
    return sessions.sample_burst(events(read), "ts", 3600, end=True).select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, lag({US}) over (partition by user_id order by ts, event_id) AS p FROM events) WHERE p IS NULL OR {US} - p >= 3600000000")
def sample_burst_start(read, spark):
    return sessions.sample_burst(events(read), "ts", 3600, end=False).select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, min({US}) over (partition by user_id) AS f FROM events) WHERE {US} - f < 86400000000")
def take_interval(read, spark):
    return sessions.take_interval(events(read), "ts", 86400).select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, min({US}) over (partition by user_id) AS f FROM events) WHERE {US} - f >= 86400000000")
def drop_interval(read, spark):
    return sessions.take_interval(events(read), "ts", 86400, drop=True).select("user_id", "event_id")


# 2.20 to 2.22 functions


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) END AS lines, strlen(text) AS bytes FROM documents")
def count_lines_words_bytes(read, spark):
    t = F.col("text")
    return read("documents").select("doc_id", text.count_words(t).alias("words"), text.count_lines(t).alias("lines"), F.octet_length(t).cast("long").alias("bytes"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1")
def word_frequency(read, spark):
    return text.word_counts(read("documents"), "text")


@query("SELECT vec_id, embedding[1] AS head, embedding[64] AS latest, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, embedding[33] AS chunk_head FROM embeddings")
def array_access(read, spark):
    a = F.col("embedding")
    return read("embeddings").select("vec_id", arrays.get_index(a, 0).alias("head"), arrays.get_index_rev(a, 0).alias("latest"), F.size(arrays.find_indices(a, lambda x: x > 0)).cast("long").alias("positive"), arrays.get_index(arrays.get_index(arrays.chunks_of(a, 16), 2), 0).alias("chunk_head"))


@query("SELECT o_orderkey, o_orderkey AS decoded, hex(o_orderkey) AS digits FROM orders")
def binary_round_trip(read, spark):
    k = F.col("o_orderkey")
    return read("orders").select("o_orderkey", text.decode_int(text.encode_int(k, 8, big=False), 8, big=False).alias("decoded"), F.regexp_replace(F.hex(text.encode_int(k, 8)), "^0+(?=.)", "").alias("digits"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS file FROM pages")
def path_file(read, spark):
    return read("pages").select("page_id", text.path_file(F.col("url")).alias("file"))


FLAGSHIP = QUERIES["keep_alive_sessions"]
