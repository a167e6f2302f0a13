import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import aggregates, arrays, codecs, parsers, text
from tideline.operators import expand, multiset, parallel, stateful
from tideline.plans import registry
from tideline.seq import Seq
from tideline.sources import files
from tideline.streaming import sessions


def ints(spark, values, name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"ord long, {name} long")


def listed(df, order="ord", value="x"):
    return [r[value] for r in df.orderBy(order).collect()]


def test_trims_of_empty_and_short(spark):
    empty = Seq(ints(spark, []), ["ord"])
    assert listed(empty.take(3)) == listed(empty.drop(3)) == listed(empty.take_while(F.col("x") > 0)) == []
    seq = Seq(ints(spark, [1, 2, 3, 1, 2]), ["ord"])
    assert listed(seq.take(9)) == [1, 2, 3, 1, 2]
    assert listed(seq.take_while(F.col("x") < 3)) == [1, 2]
    assert listed(seq.drop_while(F.col("x") < 3)) == [3, 1, 2]
    assert listed(seq.take_end_by(F.col("x") == 3)) == [1, 2, 3]
    assert listed(seq.take_end_by(F.col("x") == 3, keep=False)) == [1, 2]
    assert listed(seq.delete_first(F.col("x") == 1)) == [2, 3, 1, 2]
    assert listed(seq.at(2)) == [3] and listed(seq.final()) == [2]


def test_uniq_keeps_separate_runs_and_nulls(spark):
    seq = Seq(ints(spark, [1, 1, None, None, 1, 2, 2]), ["ord"])
    assert listed(seq.uniq("x")) == [1, None, 1, 2]


def test_multiset_rules(spark):
    """Against plain list operations, on random sequences with repeats."""
    rng = random.Random(12)
    left, right = ([rng.randint(0, 9) for _ in range(n)] for n in (30, 17))
    kept = list(left)
    for x in right:
        if x in kept:
            kept.remove(x)
    a, b = ints(spark, left), ints(spark, right)
    assert listed(multiset.delete_firsts(a, b, ["x"], ["ord"])) == kept
    assert [r["x"] for r in multiset.union_by(a, b, ["x"], ["ord"]).orderBy("part", "ord").collect()] == left + [x for x in dict.fromkeys(right) if x not in left]
    assert listed(multiset.first_of_each(a, ["x"], ["ord"])) == list(dict.fromkeys(left))


def test_tree_orders(spark):
    """Against a recursive walk of a random tree."""
    rng = random.Random(13)
    below = {}
    for child in range(1, 25):
        below.setdefault(rng.randrange(child), []).append(child)
    edges = spark.createDataFrame([(p, c) for p, cs in below.items() for c in cs], "parent long, child long")

    def walk(node, level=0):
        yield node, level
        for c in below.get(node, ()):
            yield from walk(c, level + 1)

    deep = list(walk(0))
    out = expand.tree_orders(expand.iterate_tree(edges, spark.createDataFrame([(0,)], "child long")))
    rows = out.collect()
    assert [r["node"] for r in sorted(rows, key=lambda r: r["depth_first"])] == [n for n, _ in deep]
    broad = sorted(deep, key=lambda x: x[1])
    assert [r["node"] for r in sorted(rows, key=lambda r: r["breadth_first"])] == [n for n, _ in broad]
    reversed_levels = sorted(deep[::-1], key=lambda x: x[1])
    assert [r["node"] for r in sorted(rows, key=lambda r: r["breadth_reversed"])] == [n for n, _ in reversed_levels]


def test_tree_of_many_levels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(104)], "parent long, child long")
    root = spark.createDataFrame([(0,)], "child long")
    assert sorted((r["node"], r["level"]) for r in expand.iterate_tree(edges, root).collect()) == [(i, i) for i in range(105)]
    with pytest.raises(ValueError, match="deeper"):
        expand.iterate_tree(edges, root, depth=3)
    assert expand.iterate_tree(edges.filter("child <= 3"), root, depth=3).count() == 4
    with pytest.raises(ValueError, match="below itself"):
        expand.iterate_tree(edges.filter("child <= 3").union(spark.createDataFrame([(3, 0)], edges.schema)), root)


def test_splits(spark):
    """Against str.split and its like, on every short text of three letters."""
    texts = ["".join(t) for n in range(5) for t in itertools.product("x;y", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    for r in df.select("s", text.split_sep_by_seq(s, ";").alias("i"), text.split_end_by_seq(s, ";").alias("e"), text.split_sep_by_seq(s, ";y").alias("two")).collect():
        t = r["s"]
        assert r["i"] == (t.split(";") if t else []) and r["two"] == (t.split(";y") if t else [])
        parts = t.split(";")
        assert r["e"] == (parts[:-1] if not parts[-1] else parts)


def test_lines_and_words(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product("a \n", repeat=n)] + ["a\r\n\n", "\t a\u00a0b ", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    for r in df.select("s", text.lines(s).alias("lines"), text.count_lines(s).alias("n"), text.count_words(s).alias("w"), text.unlines(text.lines(s)).alias("u")).collect():
        t = r["s"]
        if t is None:
            assert r["lines"] is r["n"] is r["w"] is None
            continue
        want = t.split("\n")[:-1] if t.endswith("\n") or not t else t.split("\n")
        assert r["lines"] == want and r["n"] == len(want) and r["u"] == "".join(x + "\n" for x in want), repr(t)
        assert r["w"] == len(re.findall(r"[^ \t\n\r\f\v]+", t)), repr(t)


def test_numbers_that_do_not_fit(spark):
    digits = ["", "g", "0", "ff", "7fffffffffffffff", "ffffffffffffffff", "1" + "0" * 40, "0000000000000000000000001"]
    out = spark.createDataFrame([(d,) for d in digits], "s string").select(text.hexadecimal(F.col("s")).alias("h")).collect()
    assert [r["h"] for r in out] == [None, None, 0, 255, 2**63 - 1, None, None, 1]


def test_null_rows_in_segments(spark):
    """A null comparison is not true: nothing is lost, and a null is the same as a null only if the rule says so."""
    seq = Seq(ints(spark, [None, None, 3, None, None, 4]), ["ord"])
    assert listed(seq.split_by(F.col("x") == 3)) == [None, None, None, None, 4]
    assert listed(seq.split_by(F.col("x") == 3), value="segment") == [0, 0, 1, 1, 1]
    assert listed(seq.groups_rolling_by(lambda p, x: p.eqNullSafe(x), F.col("x")), value="group") == [0, 0, 1, 2, 2, 3]
    assert listed(seq.groups_rolling_by(lambda p, x: p == x, F.col("x")), value="group") == [0, 1, 2, 3, 4, 5]
    keyed = Seq(ints(spark, [None, 1, 1, None, 2]).withColumn("k", F.lit(1)), ["ord"], ["k"])
    assert listed(keyed.running_distinct("n", "x"), value="n") == [0, 1, 1, 1, 2]
    assert listed(Seq(keyed.df, ["ord"]).running_distinct("n", "x"), value="n") == [0, 1, 1, 1, 2]


def test_state_across_batches(spark):
    """A key's rows over many Arrow batches, null keys among them, against plain Python."""
    rng = random.Random(14)
    rows = [(k, i, rng.randint(-5, 5)) for k in (None, 1, 2, 3) for i in range(rng.randint(50, 90))]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(7)

    def running_maximum(state, columns):
        out = []
        for x in columns["x"].to_pylist():
            state = x if state is None else max(state, x)
            out.append(state)
        return state, {"m": out}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        out = stateful.scan_sorted(df, ["k"], ["i"], running_maximum, {"m": T.LongType()}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, i, _ in rows:
        want[k, i] = max(x for a, b, x in rows if a == k and b <= i)
    assert {(r["k"], r["i"]): r["m"] for r in out} == want and len(out) == len(rows)


def test_parsers_of_text(spark):
    df = spark.createDataFrame([("say \"a b\"  'it is' x\\ y",), ("",), ("\"open",)], "s string")
    words = [r["w"] for r in df.select(parsers.words_with_quotes(F.col("s")).alias("w")).collect()]
    assert words == [["say", "a b", "it is", "x y"], [], []]
    # a part never gives back what it has taken
    greedy = parsers.chars_in("ab").many() + parsers.char("b")
    assert not df.select(greedy.parse(F.lit("aab"))["ok"].alias("ok")).first()["ok"]


def test_directories(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, data in (("a.bin", bytes(range(100))), ("d/b.txt", b"x;y;z;"), ("d/e/c", b"")):
        (tmp_path / name).write_bytes(data)
    names = lambda **how: sorted(r["name"] for r in files.list_directory(spark, str(tmp_path), **how).collect())
    assert names() == ["a.bin", "b.txt", "c", "d", "e"] and names(recursive=False) == ["a.bin", "d"]
    assert names(only="dirs") == ["d", "e"] and names(only="files") == ["a.bin", "b.txt", "c"]
    assert files.list_directory(spark, str(tmp_path / "none"), ignore_missing=True).count() == 0
    part = files.read_range(spark, str(tmp_path / "a.bin"), 10, 42, 9).orderBy("at").collect()
    assert b"".join(bytes(r["chunk"]) for r in part) == bytes(range(10, 43)) and part[-1]["at"] == 37
    assert [r["byte"] for r in files.read_bytes(spark, str(tmp_path / "a.bin")).orderBy("at").collect()] == list(range(100))
    assert [r["value"] for r in files.read_records(spark, str(tmp_path / "d" / "b.txt"), ";").collect()] == ["x", "y", "z"]


def test_jobs_side_by_side(spark):
    """Results in order, as they come, and the first one; the others' Spark jobs are cancelled."""
    jobs = [lambda k=k: spark.range(1000).filter(f"id % 7 = {k}").count() for k in range(5)]
    want = [len(range(k, 1000, 7)) for k in range(5)]
    assert parallel.run(jobs, 3) == want and dict(parallel.run_as_completed(jobs, 3)) == dict(enumerate(want))

    def slow():
        return spark.range(4, numPartitions=4).select(F.sum(F.expr("java_method('java.lang.Thread', 'activeCount')").cast("long") + F.expr("aggregate(sequence(1L, 20000000L), 0L, (a, x) -> a + x)"))).collect()

    assert parallel.run_first(spark, [slow, lambda: spark.range(10).count()]) == (1, 10)


def test_bytes_written(spark, tmp_path):
    chunks = spark.createDataFrame([(i, bytes([i] * i)) for i in range(20)], "i long, chunk binary").repartition(5)
    path = str(tmp_path / "out.bin")
    assert files.write_bytes(chunks, "chunk", ["i"], path) == 190
    assert (tmp_path / "out.bin").read_bytes() == b"".join(bytes([i] * i) for i in range(20))


def test_streaming_fixed_sessions(spark, tmp_path):
    """Sessions come out as the watermark passes their end, over several batches of input."""
    batches = [[(1, 0), (1, 5), (2, 3)], [(1, 12), (2, 9), (1, 30)], [(1, 100), (2, 100)], [(3, 200)]]
    source = tmp_path / "in"
    stream = spark.readStream.schema("k long, s long, ts timestamp").parquet(str(source / "*"))
    source.mkdir()
    out = sessions.fixed_sessions_stream(stream, ["k"], "ts", 10, "1 second")
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)).write.parquet(str(source / str(i)))
        query = query or out.writeStream.format("memory").queryName("fixed").outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT k, unix_seconds(start) - 1000 AS s, unix_seconds(end) - 1000 AS e, n FROM fixed").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 10, 2), (1, 12, 22, 1), (1, 30, 40, 1), (1, 100, 110, 1), (2, 3, 13, 2), (2, 100, 110, 1)]


def test_tick_stream(spark):
    assert sessions.tick_stream(spark).isStreaming and set(sessions.tick_stream(spark).columns) == {"timestamp", "value"}


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    a = F.col("a")
    row = df.select(arrays.chunks_of(a, 2).alias("c"), arrays.last_n(a, 2).alias("l"), arrays.get_index(a, 9).alias("none"), arrays.drop_while(a, lambda x: x < 3).alias("d"), arrays.is_subsequence(F.array(F.lit(2), F.lit(5)), a).alias("s"), arrays.find_indices(a, lambda x: x % 2 == 0).alias("f")).first()
    assert row["c"] == [[1, 2], [3, 4], [5]] and row["l"] == [4, 5] and row["none"] is None
    assert row["d"] == [3, 4, 5] and row["s"] and row["f"] == [1, 3]


def test_integers_round_trip(spark):
    values = [-(2**31), -1, 0, 1, 2**31 - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for big in (True, False):
        out = df.select("x", text.decode_int(text.encode_int(F.col("x"), 4, big), 4, big).alias("y")).collect()
        assert all(r["x"] == r["y"] for r in out)


def test_rolling_hash_depends_on_order(spark):
    row = spark.range(1).select(aggregates.rolling_hash(F.array(F.lit(1), F.lit(2))).alias("a"), aggregates.rolling_hash(F.array(F.lit(2), F.lit(1))).alias("b")).first()
    assert row["a"] == 1_000_003 + 2 and row["b"] == 2_000_007


def test_fixed_sessions(spark):
    """Against a plain loop, with ties and rows without a time."""
    rng = random.Random(15)
    rows = [(k, i, rng.choice([None, *range(40)])) for k in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["k"], r["i"]): r["session"] for r in sessions.fixed_sessions(df, ["k"], "ts", "i", 7).collect()}
    for k in (1, 2, 3):
        anchor, number = None, -1
        for s, i in sorted((s, i) for a, i, s in rows if a == k and s is not None):
            if anchor is None or s - anchor >= 7:
                anchor, number = s, number + 1
            assert got[k, i] == number
        assert all(got[k, i] is None for a, i, s in rows if a == k and s is None)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("one",), ("two",)], "s string")
    files.write_lines(df.coalesce(1), "s", str(tmp_path / "t"))
    assert [r["value"] for r in files.read_lines(spark, str(tmp_path / "t")).orderBy("value").collect()] == ["one", "two"]
    chunks = files.read_chunks(spark, str(tmp_path / "t" / "part*"), 3).orderBy("at").collect()
    assert b"".join(bytes(c["chunk"]) for c in chunks) == b"one\ntwo\n"


def test_streaming_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 10), (1, 100), (2, 5)]
    spark.createDataFrame(rows, "k long, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, s long, ts timestamp").parquet(str(tmp_path / "in"))
    out = sessions.keep_alive_windows(stream, ["k"], "ts", "30 seconds", F.count("*").alias("n"), watermark="1 second")
    query = out.writeStream.format("memory").queryName("sess").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("sess").collect()) == [(1, 1), (1, 2), (2, 1)]


def taken(values, items, keep):
    n = len(items)
    ends = [e for e in range(n, len(values) + 1) if values[e - n : e] == items]
    return values[: ends[0] - (0 if keep else n)] if ends else values


@pytest.mark.parametrize("items", [[], [1], [1, 2], [1, 1, None], [None, 2]])
def test_take_end_by_seq(spark, items):
    """Rows and lists against plain slices; a list is made once, not again for each of its places."""
    rng = random.Random(14)
    lists = [[rng.choice([1, 2, None]) for _ in range(n)] for n in (1, 2, 3, 9, 30)] + [[2] * 5]
    df = spark.createDataFrame([(k, i, x) for k, values in enumerate(lists) for i, x in enumerate(values)], "k long, ord long, x long")
    column = F.array(*map(F.lit, items)).cast("array<long>")
    for keep in (True, False):
        rows = Seq(df, ["ord"], ["k"]).take_end_by_seq(F.col("x"), [F.lit(x) for x in items], keep).collect()
        expected = [taken(values, items, keep) for values in lists]
        assert [[r["x"] for r in sorted(rows, key=lambda r: r["ord"]) if r["k"] == k] for k in range(len(lists))] == expected
        folded = df.groupBy("k").agg(aggregates.take_end_by_seq(F.col("x"), F.col("ord"), column, keep).alias("a"))
        assert [r["a"] for r in folded.orderBy("k").collect()] == expected
        assert folded._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
        whole = Seq(df.filter("k = 4").drop("k"), ["ord"])
        assert listed(whole.take_end_by_seq(F.col("x"), [F.lit(x) for x in items], keep)) == expected[4]


def test_take_end_by_seq_streams_rows_and_users_without_id_have_no_end(spark, tmp_path):
    events = [(i, i // 2, user, kind) for user in (1, 2, None) for i, kind in enumerate(["view", "click", "view", "view", "click", "view"])] + [(0, 0, 3, "click"), (1, 0, 3, "view"), (0, 0, 4, "click")]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["take_end_by_seq"](spark, str(tmp_path))
    assert {tuple(r) for r in out.select("user_id", "with_it", "without").collect()} == {(1, 3, 1), (2, 3, 1), (3, 2, 0), (4, 1, 1), (None, 6, 6)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms_go_through_python_a_few_rows_at_a_time(spark, form):
    texts = ["", "plain", "é", "ẹ́ ﬁ", "가", "\U0001d15e\U00011099\U000110ba", "nul\0é", "\U0001f600" * 3, None, "é" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    out = df.select("i", codecs.normalize(F.col("t"), form).alias("n"), codecs.normalize(codecs.normalize(F.col("t"), "NFD"), form).alias("twice"))
    expected = [None if t is None else unicodedata.normalize(form, t) for t in texts]
    assert [(r["n"], r["twice"]) for r in out.orderBy("i").collect()] == [(t, t) for t in expected]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
