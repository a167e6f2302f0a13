"""Queries on whole ordered sequences: order, separators, comparison, turns, sources, time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import expand, multiset, ordered, stateful
from ..seq import Seq, appended, merged
from ..sources import generators
from ..streaming import sessions
from .registry import K, N, US, by_customer, cents, events, orders, query


def nations(read, *columns: str) -> Seq:
    return Seq(read("nation").select("n_nationkey", *columns), ["n_nationkey"])


def regions(read, *columns: str) -> Seq:
    return Seq(read("region").select("r_regionkey", *columns), ["r_regionkey"])


def named(df, old: str, new: str = "k") -> Seq:
    return Seq(df.select(F.col(old).cast("long").alias(new)), [new])


_C = "CAST(round(o_totalprice * 100) AS BIGINT)"

# sources


@query("SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, 'c'), (1, 1, 'a'), (2, 2, NULL)) t(index, x, y)")
def from_list(read, spark):
    return generators.from_list(spark, [(3, "c"), (1, "a"), (2, None)], "x long, y string")


@query("SELECT 'one' AS value")
def from_pure(read, spark):
    return generators.from_list(spark, [("one",)], "value string").drop("index")


@query("SELECT 1::BIGINT AS value WHERE false")
def nil(read, spark):
    return generators.nil(spark, "value long")


@query("WITH RECURSIVE t(index, value, rest) AS (SELECT 0::BIGINT, 1000003::BIGINT % 10, 1000003::BIGINT // 10 UNION ALL SELECT index + 1, rest % 10, rest // 10 FROM t WHERE rest > 0) SELECT index, value FROM t")
def unfoldr(read, spark):
    return generators.unfoldr(spark, 1000003, "s > 0", "s % 10", "s div 10")


@query("SELECT 'step' AS kind, 5 + 3 * range AS value FROM range(0, 10) UNION ALL SELECT 'then', 100 - 7 * range FROM range(0, 10) UNION ALL SELECT 'one', 250 + range FROM range(0, 10)")
def enumerate_counted(read, spark):
    step, then, one = generators.enumerate_step(spark, 5, 3, 10), generators.enumerate_from_then(spark, 100, 93, 10), generators.enumerate_from(spark, 250, 10)
    return step.select(F.lit("step").alias("kind"), "value").union(then.select(F.lit("then"), "value")).union(one.select(F.lit("one"), "value"))


@query("SELECT 'tinyint' AS kind, 120 + range AS value FROM range(0, 8) UNION ALL SELECT 'boolean', range FROM range(0, 2)")
def enumerate_bounded(read, spark):
    return generators.enumerate_bounded(spark, 120, "tinyint").select(F.lit("tinyint").alias("kind"), "value").union(generators.enumerate_bounded(spark, 0, "boolean").select(F.lit("boolean"), "value"))


@query("SELECT 0.5::DOUBLE + 0.25::DOUBLE * range AS value FROM range(0, 20)")
def enumerate_fractional_counted(read, spark):
    return generators.enumerate_fractional_step(spark, 0.5, 0.25, 20)


# order, insertion, separators


@query("SELECT o_orderkey, row_number() over (order by o_orderkey desc) - 1 AS turn FROM orders")
def reverse(read, spark):
    return ordered.reversed_rows(orders(read))


@query("SELECT o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 AS place FROM orders")
def sort_by(read, spark):
    return ordered.ranked_rows(read("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("SELECT x, row_number() over (order by x, new desc) - 1 AS turn FROM (SELECT s_suppkey AS x, 0 AS new FROM supplier UNION ALL SELECT 7, 1)")
def insert_by(read, spark):
    new = spark.range(7, 8).select(F.col("id").alias("x"))
    return ordered.inserted(Seq(read("supplier").select(F.col("s_suppkey").alias("x")), ["x"]), new, "x")


_I = "SELECT n_nationkey::BIGINT AS k, row_number() over (order by n_nationkey) - 1 AS i, count(*) over () AS n FROM nation"


def _separated(read, every, where):
    return ordered.separated_rows(named(read("nation"), "n_nationkey"), every, where)


@query(f"SELECT k, 2 * i AS turn, false AS separator FROM ({_I}) UNION ALL SELECT NULL, 2 * i - 1, true FROM ({_I}) WHERE i > 0")
def intersperse(read, spark):
    return _separated(read, 1, "between")


@query(f"SELECT k, 2 * i AS turn, false AS separator FROM ({_I}) UNION ALL SELECT NULL, 2 * i + 1, true FROM ({_I})")
def intersperse_end_by(read, spark):
    return _separated(read, 1, "after")


@query(f"SELECT k, i + i // 4 AS turn, false AS separator FROM ({_I}) UNION ALL SELECT NULL, i + i // 4 + 1, true FROM ({_I}) WHERE i % 4 = 3 OR i = n - 1")
def intersperse_end_by_every(read, spark):
    return _separated(read, 4, "after")


@query(f"SELECT k, i + i // 4 + 1 AS turn, false AS separator FROM ({_I}) UNION ALL SELECT NULL, i + i // 4, true FROM ({_I}) WHERE i % 4 = 0")
def intersperse_begin_by(read, spark):
    return _separated(read, 4, "before")


# trims and single rows


@query("SELECT 'init' AS kind, o_orderkey FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'tail', o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def init_and_tail(read, spark):
    seq = orders(read)
    return seq.drop_last(1).select(F.lit("init").alias("kind"), "o_orderkey").union(seq.drop(1).select(F.lit("tail"), "o_orderkey"))


@query("SELECT * FROM (SELECT 'last' AS kind, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20) UNION ALL SELECT 'at', o_orderkey FROM (SELECT o_orderkey, row_number() over (order by o_orderkey) AS i FROM orders) WHERE i = 43 UNION ALL SELECT 'final', max(o_orderkey) FROM orders UNION ALL SELECT 'found', min(o_orderkey) FROM orders WHERE o_orderstatus = 'P'")
def take_last_and_lookups(read, spark):
    seq = orders(read, "o_orderstatus")
    parts = {"last": seq.take_last(20), "at": seq.at(42), "final": seq.final(), "found": seq.first_where(F.col("o_orderstatus") == "P")}
    out = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("kind"), "o_orderkey")
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) over (partition by o_custkey order by o_orderkey rows unbounded preceding) AS a, sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) over (partition by o_custkey order by o_orderkey desc rows unbounded preceding) AS b FROM orders) WHERE a > 0 AND b > 0")
def drop_while_around(read, spark):
    return by_customer(read, "o_orderstatus").drop_while_around(F.col("o_orderstatus") == "O").drop("o_orderstatus")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, sum(CASE WHEN o_totalprice < 300000 THEN 0 ELSE 1 END) over (order by o_orderkey desc rows unbounded preceding) AS f FROM orders) WHERE f > 0")
def drop_while_last(read, spark):
    return orders(read, "o_totalprice").drop_while_last(F.col("o_totalprice") < 300000).select("o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT max(n_nationkey) FROM nation) THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def modify_last(read, spark):
    return nations(read, "n_name").modify_last("n_name", F.concat(F.upper("n_name"), F.lit("!")))


@query("SELECT event_id, event_type FROM events")
def tap(read, spark):
    return ordered.tapped(read("events").select("event_id", "event_type"), "events_read", F.count("*").alias("n"))


@query("SELECT * FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS clicked FROM events) WHERE clicked IS NOT NULL")
def cat_maybes(read, spark):
    return read("events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("clicked")).filter("clicked IS NOT NULL")


@query("SELECT event_id, 'left' AS side, NULL::DOUBLE AS r, event_type AS l FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, 'right', value, NULL FROM events WHERE event_type = 'click'")
def cat_eithers(read, spark):
    click = F.col("event_type") == "click"
    return read("events").select("event_id", F.when(click, "right").otherwise("left").alias("side"), F.when(click, F.col("value")).alias("r"), F.when(~click, F.col("event_type")).alias("l"))


# comparison


_SAME = "(SELECT n_nationkey::BIGINT AS k FROM nation), (SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey <> 12)"


@query("SELECT true AS same, false AS other, 0 AS order_same, -1 AS order_other, -1 AS order_prefix, 1 AS order_longer")
def eq_by_and_cmp_by(read, spark):
    n = read("nation")
    whole, gap, front = named(n, "n_nationkey"), named(n.filter("n_nationkey <> 12"), "n_nationkey"), named(n.filter("n_nationkey < 5"), "n_nationkey")
    out = ordered.equal(whole, whole, "k").select(F.col("equal").alias("same"))
    out = out.crossJoin(ordered.equal(whole, gap, "k").select(F.col("equal").alias("other")))
    for name, (a, b) in {"order_same": (whole, whole), "order_other": (whole, gap), "order_prefix": (front, whole), "order_longer": (whole, front)}.items():
        out = out.crossJoin(ordered.compared(a, b, "k").select(F.col("order").alias(name)))
    return out


@query("SELECT 'kept' AS part, range AS k FROM range(0, 12) UNION ALL SELECT 'dropped', range FROM range(12, 25)")
def common_prefix(read, spark):
    n = read("nation")
    a, b = named(n, "n_nationkey"), named(n.filter("n_nationkey <> 12"), "n_nationkey")
    kept, rest = ordered.common_prefix(a, b, "k"), ordered.common_prefix(a, b, "k", drop=True)
    return kept.select(F.lit("kept").alias("part"), "k").union(rest.select(F.lit("dropped"), "k"))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def sorted_intersect_by(read, spark):
    return ordered.sorted_intersect(read("customer").select(F.col("c_custkey").alias("k")), read("orders").select(F.col("o_custkey").alias("k")), ["k"])


# turns


_LEFT = "SELECT n_nationkey::BIGINT AS k, row_number() over (order by n_nationkey) - 1 AS turn, 0 AS part FROM nation"
_RIGHT = "SELECT r_regionkey::BIGINT AS k, row_number() over (order by r_regionkey) - 1 AS turn, 1 AS part FROM region"


def _both(read):
    return named(read("nation"), "n_nationkey"), named(read("region"), "r_regionkey")


@query(f"SELECT * FROM ({_LEFT}) WHERE turn <= 5 UNION ALL SELECT * FROM ({_RIGHT}) WHERE turn < 25")
def interleave_min(read, spark):
    return ordered.interleaved_shortest(*_both(read), ["k"])


@query(f"SELECT * FROM ({_LEFT}) UNION ALL SELECT * FROM ({_RIGHT}) WHERE turn < 25")
def interleave_end_by(read, spark):
    return ordered.ended_by(*_both(read), ["k"])


@query(f"SELECT * FROM ({_LEFT}) WHERE turn < 5 UNION ALL SELECT * FROM ({_RIGHT}) WHERE turn < 25")
def interleave_end_by_both(read, spark):
    return ordered.ended_by(*_both(read), ["k"], both=True)


@query(f"SELECT k, turn, 0 AS part FROM ({_RIGHT}) UNION ALL SELECT k, turn, 1 FROM ({_LEFT}) WHERE turn < 4")
def interleave_sep_by(read, spark):
    content, separators = reversed(_both(read))
    return ordered.separated_by(content, separators, ["k"])


@query(f"SELECT * FROM ({_LEFT}) WHERE turn <= 5 UNION ALL SELECT * FROM ({_RIGHT}) WHERE turn < 24")
def interleave_sep_by_both(read, spark):
    return ordered.separated_by(*_both(read), ["k"], both=True)


@query(f"SELECT * FROM ({_LEFT}) WHERE k % 2 = 1 UNION ALL SELECT * FROM ({_RIGHT})")
def round_robin(read, spark):
    return ordered.round_robin(_both(read), [F.col("k") % 2 == 1, None], ["k"])


@query(f"SELECT * FROM ({_LEFT}) UNION ALL SELECT * FROM ({_RIGHT})")
def append(read, spark):
    return appended(_both(read), ["k"])


@query("SELECT v, row_number() over (order by v, part, turn) - 1 AS place FROM (SELECT CAST(round(s_acctbal * 100) AS BIGINT) AS v, row_number() over (order by s_acctbal, s_suppkey) AS turn, 0 AS part FROM supplier UNION ALL SELECT CAST(round(c_acctbal * 100) AS BIGINT), row_number() over (order by c_acctbal, c_custkey), 1 FROM customer)")
def merge_by(read, spark):
    left = Seq(read("supplier").select(cents("s_acctbal").alias("v"), "s_acctbal", F.col("s_suppkey").alias("id")), ["s_acctbal", "id"])
    right = Seq(read("customer").select(cents("c_acctbal").alias("v"), "c_acctbal", F.col("c_custkey").alias("id")), ["c_acctbal", "id"])
    return Seq(merged(left, right, ["v"], "v"), ["v", "part", "turn"]).indexed("place").select("v", "place")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT 'none' WHERE false")
def append_if_empty(read, spark):
    n = read("nation").select(F.col("n_name").alias("name"))
    none = n.filter("name IS NULL")
    return ordered.or_else(none, ordered.or_else(n, n.limit(1)))


@query("SELECT * FROM (SELECT r_regionkey::BIGINT AS value, row_number() over (order by r_regionkey) - 1 AS turn, 0 AS part, 0 AS inner FROM region UNION ALL SELECT range, (SELECT count(*) - 1 FROM region), 1, range FROM range(0, (SELECT max(r_regionkey)::BIGINT FROM region)))")
def append_unfold_last(read, spark):
    seq = named(read("region"), "r_regionkey")
    return ordered.appended_unfold_last(seq, F.sequence(F.lit(0).cast("long"), F.col("k") - 1), "k")


# expansion orders


_EACH = "SELECT n_nationkey, j AS i FROM nation, LATERAL (SELECT unnest(range(0, n_nationkey % 4)) AS j)"


@query(f"SELECT n_nationkey, i AS \"inner\", i AS breadth, n_nationkey + i AS diagonal, CASE WHEN i % 2 = 0 THEN n_nationkey ELSE -n_nationkey END AS alternate FROM ({_EACH})")
def nested_orders(read, spark):
    return expand.nested_orders(read("nation").select("n_nationkey"), F.sequence(F.lit(0), F.col("n_nationkey") % 4 - 1), "n_nationkey", F.col("n_nationkey") % 4 > 0).select("n_nationkey", F.col("inner").cast("long").alias("inner"), F.col("breadth").cast("long").alias("breadth"), F.col("diagonal").cast("long").alias("diagonal"), F.col("alternate").cast("long").alias("alternate"))


@query("SELECT conv_id, turn, i - 1 AS inner, w AS piece FROM (SELECT conv_id, turn, unnest(list_concat(string_split(role, 's'), ['|'])) AS w, generate_subscripts(list_concat(string_split(role, 's'), ['|']), 1) AS i FROM conversations)")
def unfold_each_end_by_seq(read, spark):
    out = expand.ended(read("conversations").select("conv_id", "turn", "role"), F.split("role", "s", -1), F.lit("|"), "piece")
    return out.select("conv_id", "turn", F.col("inner").cast("long").alias("inner"), "piece")


@query("SELECT conv_id, turn, i - 1 AS inner, w AS piece FROM (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(flatten(list_transform(string_split(role, 's'), lambda x: ['|', x])), lambda x, i: i > 1) AS l FROM conversations))")
def unfold_each_sep_by_seq(read, spark):
    out = expand.separated(read("conversations").select("conv_id", "turn", "role"), F.split("role", "s", -1), F.lit("|"), value="piece")
    return out.select("conv_id", "turn", F.col("inner").cast("long").alias("inner"), "piece")


@query("SELECT count(*) * (count(*) - 1) // 2 AS k FROM nation")
def reduce_iterate(read, spark):
    return ordered.reduced_by_levels(named(read("nation"), "n_nationkey"), "k", lambda a, b: a + b)


@query("WITH RECURSIVE t(node, level, path) AS (SELECT 1::BIGINT, 0, [1::BIGINT] UNION ALL SELECT c, level + 1, list_append(path, c) FROM t JOIN (SELECT range // 3 AS p, range AS c FROM range(3, 400)) ON node = p) SELECT node, level, row_number() over (order by path) - 1 AS depth_first, row_number() over (order by level, path) - 1 AS breadth_first, row_number() over (order by level, path desc) - 1 AS breadth_reversed FROM t")
def iterate_tree_orders(read, spark):
    edges = spark.range(3, 400).select(F.expr("id div 3").alias("parent"), F.col("id").alias("child"))
    tree = expand.iterate_tree(edges, spark.range(1, 2).select(F.col("id").alias("child")))
    return expand.tree_orders(tree).select("node", "level", "depth_first", "breadth_first", "breadth_reversed")


# segments, groups, sessions


@query("SELECT user_id, event_id, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding)::BIGINT AS \"group\" FROM (SELECT *, 0 AS s FROM events WHERE false) UNION ALL SELECT user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 7 FROM events")
def fold_many(read, spark):
    return events(read).groups_of(7, "group").drop("ts")


_FIXED = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {US} AS us FROM events),
s(user_id, session, anchor) AS (SELECT user_id, 0::BIGINT, min(us) FROM e GROUP BY 1
 UNION ALL SELECT s.user_id, s.session + 1, min(e.us) FROM s JOIN e ON e.user_id = s.user_id AND e.us >= s.anchor + 21600000000 GROUP BY s.user_id, s.session)
SELECT e.user_id, event_id, max(session) AS session FROM e JOIN s ON e.user_id = s.user_id AND s.anchor <= e.us GROUP BY 1, 2"""


@query(_FIXED)
def fixed_sessions(read, spark):
    """Sessions of six hours, each from its first event."""
    return sessions.fixed_sessions(read("events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 6 * 3600).drop("ts")


_TIMED = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {US} AS us, row_number() over (partition by user_id order by ts, event_id) AS i FROM events),
s(user_id, "group", i, us) AS (SELECT user_id, 0::BIGINT, i, us FROM e WHERE i = 1
 UNION ALL SELECT s.user_id, s."group" + 1, min(e.i), arg_min(e.us, e.i) FROM s JOIN e ON e.user_id = s.user_id AND e.i > s.i AND (e.us >= s.us + 86400000000 OR e.i >= s.i + 4) GROUP BY s.user_id, s."group")
SELECT e.user_id, event_id, max("group") AS "group" FROM e JOIN s ON e.user_id = s.user_id AND s.i <= e.i GROUP BY 1, 2"""


@query(_TIMED)
def timed_groups_of(read, spark):
    return sessions.timed_groups(events(read), "ts", 4, 86400).drop("ts")


_WITHIN = f"""WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, {_C} AS x, {K} AS i FROM orders),
s(o_custkey, i, x, "group") AS (SELECT o_custkey, i, x, 0::BIGINT FROM e WHERE i = 0
 UNION ALL SELECT s.o_custkey, e.i, CASE WHEN e.x - s.x >= 0 AND e.x - s.x < 10000000 THEN s.x ELSE e.x END, CASE WHEN e.x - s.x >= 0 AND e.x - s.x < 10000000 THEN s."group" ELSE s."group" + 1 END FROM s JOIN e ON e.o_custkey = s.o_custkey AND e.i = s.i + 1)
SELECT o_custkey, o_orderkey, "group" FROM s JOIN e USING (o_custkey, i)"""


@query(_WITHIN)
def groups_by(read, spark):
    seq = Seq(read("orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("x")), ["o_orderkey"], ["o_custkey"])
    return ordered.grouped_by_first(seq, "x", 10_000_000).drop("x")


def _balance(state, columns):
    """A balance that never falls below zero: what is not covered is left out."""
    held, out = state or 0, []
    for x in columns["x"].to_pylist():
        held = max(0, held + x)
        out.append(held)
    return held, {"balance": out}


_BALANCE = f"""WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -{_C} ELSE {_C} END AS x, {K} AS i FROM orders),
s(o_custkey, i, balance) AS (SELECT o_custkey, i, greatest(0, x) FROM e WHERE i = 0 UNION ALL SELECT s.o_custkey, e.i, greatest(0, s.balance + e.x) FROM s JOIN e ON e.o_custkey = s.o_custkey AND e.i = s.i + 1)
SELECT o_orderkey, balance::BIGINT AS balance FROM s JOIN e USING (o_custkey, i)"""


@query(_BALANCE)
def map_accum(read, spark):
    x = F.when(F.col("o_orderstatus") == "F", -cents("o_totalprice")).otherwise(cents("o_totalprice"))
    rows = read("orders").select("o_custkey", "o_orderkey", x.alias("x"))
    return stateful.scan_sorted(rows, ["o_custkey"], ["o_orderkey"], _balance, {"balance": T.LongType()}).select("o_orderkey", "balance")


@query("SELECT range AS n, TIMESTAMP '2024-01-01' + INTERVAL 15 minutes * range AS ts FROM range(0, 97)")
def ticks(read, spark):
    t = sessions.ticks(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "15 minutes")
    return Seq(t, ["ts"]).indexed("n")


@query("SELECT ts, event_id, false AS mark FROM events UNION ALL SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 day * range, NULL, true FROM range(0, 31)")
def interject(read, spark):
    return sessions.interjected(read("events").select("ts", "event_id"), "ts", sessions.ticks(spark, "2024-01-01 00:00:00", "2024-01-31 00:00:00", "1 day"))


@query(f"SELECT o_orderkey, (i // 100) AS part, i % 100 AS at FROM (SELECT o_orderkey, {N} AS i FROM orders)")
def indexed_in_chunks(read, spark):
    rows = Seq(orders(read).indexed("__i"), ["o_orderkey"])
    return rows.df.select("o_orderkey", F.floor(F.col("__i") / 100).cast("long").alias("part"), (F.col("__i") % 100).alias("at"))


@query("SELECT a.n_name AS l, b.r_name AS r FROM nation a CROSS JOIN region b")
def cross(read, spark):
    return multiset.cross(read("nation").select(F.col("n_name").alias("l")), read("region").select(F.col("r_name").alias("r")))
