"""Queries on folds, scans, windows and keyed folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import keyed, windows
from ..seq import Seq
from .registry import by_customer, cents, events, query

_C = "CAST(round(o_totalprice * 100) AS BIGINT)"
_OVER = "over (partition by o_custkey order by o_orderkey"


@query("SELECT r_regionkey, round(product(n_nationkey + 1.0), 3) AS product, arg_max(n_name, (length(n_name), n_name)) AS longest, arg_min(n_name, (length(n_name), n_name)) AS shortest, bool_or(n_name = 'NATION_7') AS has, NOT bool_or(n_name = 'NATION_7') AS has_not, max(n_nationkey) - min(n_nationkey) AS span FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def folds_by_key(read, spark):
    n, name = F.col("n_nationkey"), F.col("n_name")
    key = F.struct(F.length(name), name)
    ends = agg.span(n)
    return read("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.round(agg.product(n + F.lit(1.0)), 3).alias("product"), agg.maximum_by(name, key).alias("longest"), agg.minimum_by(name, key).alias("shortest"), agg.elem(name, F.lit("NATION_7")).alias("has"), agg.not_elem(name, F.lit("NATION_7")).alias("has_not"), (ends["greatest"] - ends["least"]).alias("span"))


@query("SELECT n_regionkey, min(i) FILTER (n_nationkey > 10) AS first_over, max(n_name) FILTER (i = 2) AS third, arg_min(n_name, i) FILTER (n_nationkey % 3 = 0) AS looked_up, min(i) FILTER (n_nationkey % 5 = 4) AS of_value, CASE WHEN count(*) = 1 THEN max(n_name) END AS only FROM (SELECT *, row_number() over (partition by n_regionkey order by n_nationkey) - 1 AS i FROM nation) GROUP BY 1")
def find_index(read, spark):
    rows = Seq(read("nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_nationkey"], ["n_regionkey"]).indexed("i")
    n, name, i = F.col("n_nationkey"), F.col("n_name"), F.col("i")
    return rows.groupBy("n_regionkey").agg(agg.find_index(i, n > 10).alias("first_over"), agg.at_index(name, i, 2).alias("third"), agg.lookup(n % 3, name, F.lit(0), i).alias("looked_up"), agg.elem_index(i, n % 5, F.lit(4)).alias("of_value"), agg.one(name).alias("only"))


@query("SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS listed, string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) AS reversed, string_agg(n_name, '' ORDER BY n_nationkey) AS joined, list_reduce(list(n_nationkey::BIGINT ORDER BY n_nationkey), lambda a, x: a * 2 + x) AS reduced, list_reduce(list_prepend(1, list(n_nationkey::BIGINT ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS folded, list_reduce(list_prepend(1, list(n_nationkey::BIGINT ORDER BY n_nationkey DESC)), lambda a, x: (a * 31 + x) % 1000003) AS folded_right, NULL::BIGINT AS maybe FROM nation GROUP BY 1")
def ordered_folds(read, spark):
    n = F.col("n_nationkey").cast("long")
    step = lambda a, x: (a * 31 + x) % 1000003
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    one = F.lit(1).cast("long")
    gap = F.when(n != F.min(n).over(_regions()), n)
    rows = read("nation").withColumn("gap", gap)
    return rows.groupBy("n_regionkey").agg(text(agg.to_list(n, n)).alias("listed"), text(agg.to_list_reversed(n, n)).alias("reversed"), agg.joined_text(F.col("n_name"), n).alias("joined"), agg.reduced(n, n, lambda a, x: a * 2 + x).alias("reduced"), agg.folded(n, n, one, step).alias("folded"), agg.folded(n, n, one, step, right=True).alias("folded_right"), agg.fold_maybes(F.col("gap"), n, one, step).alias("maybe"))


def _regions():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey")


@query("SELECT l_returnflag, CAST(sum(l_quantity) / count(*) * 1000 AS BIGINT) AS teed, sum(l_quantity) FILTER (l_discount > 0.05) AS yes, count(*) FILTER (NOT l_discount > 0.05) AS no, min(l_orderkey) AS first, max(l_quantity) AS second, min(l_quantity) AS d0, max(l_quantity) AS d1, sum(l_quantity) FILTER (l_tax > 0.04) AS filtered, sum(2 * l_quantity) AS mapped FROM lineitem GROUP BY 1")
def combined_folds(read, spark):
    q = F.col("l_quantity")
    parted, pairs = agg.partition(F.col("l_discount") > 0.05, F.sum, F.count, q), agg.unzip(F.col("l_orderkey"), q, F.min, F.max)
    both = agg.distribute(F.min(q), F.max(q))
    return read("lineitem").groupBy("l_returnflag").agg(agg.tee(F.sum(q), F.count("*"), lambda a, b: F.round(a / b * 1000).cast("long")).alias("teed"), parted["yes"].alias("yes"), parted["no"].alias("no"), pairs["first"].alias("first"), pairs["second"].alias("second"), both[0].alias("d0"), both[1].alias("d1"), agg.filtered(F.sum, q, F.col("l_tax") > 0.04).alias("filtered"), agg.mapped(F.sum, q, lambda x: 2 * x).alias("mapped"))


@query("SELECT user_id, max(n) AS largest, count(*) AS segments, sum(n)::BIGINT AS total FROM (SELECT user_id, i // 10 AS s, count(*) AS n FROM (SELECT user_id, row_number() over (partition by user_id order by ts, event_id) - 1 AS i FROM events) GROUP BY 1, 2) GROUP BY 1")
def many(read, spark):
    rows = events(read).groups_of(10)
    return agg.many(rows, ["chunk"], [F.count("*").alias("n")], ["user_id"], [F.max("n").alias("largest"), F.count("*").alias("segments"), F.sum("n").alias("total")])


_UPTO = "(SELECT min(j) FROM (SELECT user_id, row_number() over (partition by user_id order by ts, event_id) AS j, event_type AS b, lag(event_type) over (partition by user_id order by ts, event_id) AS a FROM events) x WHERE x.user_id = e.user_id AND a = 'click' AND b = 'view')"


@query(f"SELECT user_id, count(*) FILTER (i <= coalesce(k, i)) AS with_it, count(*) FILTER (i <= coalesce(k - 2, i)) AS without FROM (SELECT user_id, row_number() over (partition by user_id order by ts, event_id) AS i, {_UPTO} AS k FROM events e) GROUP BY 1")
def take_end_by_seq(read, spark):
    rows, items = events(read, "event_type"), [F.lit("click"), F.lit("view")]
    rows = rows.like(rows.matched_by_seq("matched", F.col("event_type"), items)).indexed("i")
    matched = F.col("matched") & F.col("user_id").isNotNull()  # no user, no end: the SQL looks it up by =
    each = lambda keep: agg.count_end_by_seq(F.col("i"), matched, len(items), keep)
    return rows.groupBy("user_id").agg(each(True).alias("with_it"), each(False).alias("without"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def nub(read, spark):
    return read("events").groupBy("user_id").agg(F.array_join(agg.nub(F.col("event_type"), F.struct("ts", "event_id")), ",").alias("kinds"))


@query("SELECT event_id FROM (SELECT event_id, row_number() over (partition by user_id, event_type order by ts, event_id) AS i FROM events) WHERE i = 1")
def nub_scan(read, spark):
    return keyed.nub_scan(events(read, "event_type"), "event_type").select("event_id")


# scans


@query(f"SELECT o_orderkey, coalesce(sum({_C}) {_OVER} rows between unbounded preceding and 1 preceding), 0)::BIGINT AS pre, sum({_C}) {_OVER} rows between current row and unbounded following)::BIGINT AS from_right, CASE WHEN o_orderstatus = 'F' THEN (sum(CASE WHEN o_orderstatus = 'F' THEN {_C} END) {_OVER} rows unbounded preceding))::BIGINT END AS some, {_C} - lag({_C}, 3) {_OVER}) AS lag3, max({_C}) {_OVER} rows unbounded preceding) AS highest FROM orders")
def scans(read, spark):
    seq = by_customer(read, "o_totalprice", "o_orderstatus")
    x = cents("o_totalprice")
    return seq.df.select("o_orderkey", windows.prescan(seq, F.sum, x, F.lit(0).cast("long")).alias("pre"), windows.scan_right(seq, F.sum, x).alias("from_right"), windows.scan_maybe(seq, F.sum, x, F.col("o_orderstatus") == "F").alias("some"), windows.rolling(seq, 3, lambda a, b: b - a, x).alias("lag3"), windows.cumulative(seq, F.max, x).alias("highest"))


@query("SELECT o_orderkey, CAST(sum(o_custkey) over (order by o_orderkey desc rows unbounded preceding) AS BIGINT) AS total FROM orders")
def scan_right_without_keys(read, spark):
    return Seq(read("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).running("total", F.col("o_custkey"), reverse=True).drop("o_custkey")


_W4 = f"{_OVER} rows between 3 preceding and current row)"


@query(f"SELECT o_orderkey, sum({_C}) {_W4}::BIGINT AS total, round(sum(pow(o_custkey, 2)) {_W4}, 2) AS squares, round(sum(sqrt(o_custkey)) {_W4}, 4) AS roots, min({_C}) {_W4} AS least, max({_C}) {_W4} AS greatest, CASE WHEN count(*) {_W4} = 4 THEN (sum({_C}) {_W4})::BIGINT END AS whole, list_reduce(list_prepend(7, list({_C}) {_W4}), lambda a, x: (a * 31 + x) % 1000003) AS folded FROM orders")
def incremental_windows(read, spark):
    seq = by_customer(read, "o_totalprice")
    x, k = cents("o_totalprice"), F.col("o_custkey").cast("double")
    ends = windows.span(seq, 4, x)
    return seq.df.select("o_orderkey", windows.incremental(seq, 4, x).alias("total"), F.round(windows.power_sum(seq, 4, 2.0, k), 2).alias("squares"), F.round(windows.power_sum(seq, 4, 0.5, k), 4).alias("roots"), ends["least"].alias("least"), ends["greatest"].alias("greatest"), windows.full(seq, 4, windows.sliding(seq, 4, F.sum, x)).alias("whole"), windows.folded_ring(seq, 4, x, F.lit(7).cast("long"), lambda a, y: (a * 31 + y) % 1000003).alias("folded"))


@query(f"SELECT o_orderkey, {_C} AS entered, lag({_C}, 3) {_OVER}) AS gone FROM orders")
def incremental_insertions(read, spark):
    seq = by_customer(read, "o_totalprice")
    entered, left = windows.insertions(seq, 3, cents("o_totalprice"))
    return seq.df.select("o_orderkey", entered.alias("entered"), left.alias("gone"))


# keyed


@query("SELECT event_id, count(*) over (partition by event_type order by ts, event_id rows unbounded preceding) AS so_far FROM events")
def classify_scan(read, spark):
    seq = Seq(read("events").select("event_type", "ts", "event_id"), ["ts", "event_id"], ["event_type"])
    return keyed.classify_scan(seq, "so_far", F.count, F.lit(1)).select("event_id", "so_far")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN count(*) ELSE max(event_id) END AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def demux_keyed(read, spark):
    return keyed.demux(read("events"), "event_type", {"click": F.count("*"), "view": F.max("event_id")}, "v")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN count(*) over (partition by event_type order by ts, event_id rows unbounded preceding) ELSE max(event_id) over (partition by event_type order by ts, event_id rows unbounded preceding) END AS v FROM events WHERE event_type IN ('click', 'view')")
def demux_scan(read, spark):
    seq = Seq(read("events").select("event_type", "ts", "event_id"), ["ts", "event_id"], ["event_type"])
    return keyed.demux_scan(seq, "event_type", {"click": F.count(F.lit(1)), "view": F.max("event_id")}, "v").select("event_id", "v")


@query("SELECT string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS entries FROM (SELECT event_type, CASE event_type WHEN 'click' THEN count(*) ELSE max(event_id) END AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)")
def demux_to_map(read, spark):
    out = keyed.demux_to_map(read("events"), "event_type", {"click": F.count("*"), "view": F.max("event_id")})
    return out.select(F.array_join(F.transform(F.map_entries("map"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


@query("SELECT c_nationkey, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM (SELECT c_nationkey, c_mktsegment AS k, arg_max(c_custkey, c_custkey) AS v FROM customer GROUP BY 1, 2) GROUP BY 1")
def kv_to_map(read, spark):
    out = keyed.kv_to_map(read("customer"), "c_mktsegment", "c_custkey", F.col("c_custkey"), ["c_nationkey"])
    return out.select("c_nationkey", F.array_join(F.transform(F.array_sort(F.map_entries("map")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


@query("SELECT n_nationkey, n_nationkey % 3 = 1 AS had, n_nationkey AS inserted, CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 2 END AS size_after, n_nationkey * 10 AS traversed, 5 AS united, false AS empty FROM nation")
def map_functions(read, spark):
    n = F.col("n_nationkey")
    m = F.create_map(n % 3, n)
    grown = keyed.insert(m, F.lit(1), n)
    gone = keyed.alter(grown, F.lit(9), lambda v: v)
    united = keyed.union(F.create_map(F.lit(1), F.lit(5)), grown)
    return read("nation").select("n_nationkey", F.map_contains_key(m, 1).alias("had"), F.element_at(gone, F.lit(1)).alias("inserted"), F.size(grown).alias("size_after"), F.element_at(keyed.traverse(grown, lambda k, v: v * 10), F.lit(1)).alias("traversed"), F.element_at(united, F.lit(1)).alias("united"), keyed.is_empty(keyed.delete(united, F.lit(7))).alias("empty"))
