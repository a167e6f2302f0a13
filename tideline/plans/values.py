"""Queries on array, byte, text and path functions, and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import arrays, codecs, paths, text, times, unfolds
from ..operators import expand, ordered, parallel
from ..seq import Seq
from .registry import US, query

_W = "SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM conversations"


def _words(read):
    return read("conversations").select("conv_id", "turn", text.words(F.col("text")).alias("a"))


def _j(a):
    return F.array_join(a, " ")


@query(f"SELECT conv_id, turn, a[1] AS head, a[len(a)] AS last, array_to_string(a[2:], ' ') AS tail, array_to_string(a[:len(a) - 1], ' ') AS init, array_to_string(a[4:6], ' ') AS sliced, CASE WHEN len(a) > 2 THEN array_to_string(a[3:], ' ') ELSE '' END AS after, array_to_string(a[1:2], ' ') AS before, array_to_string(list_filter([a[2], a[4], a[6]], lambda x: x IS NOT NULL), ' ') AS stepped FROM ({_W}) WHERE len(a) > 0")
def array_parts(read, spark):
    a = F.col("a")
    both = arrays.split_at(a, 2)
    return _words(read).filter(F.size("a") > 0).select("conv_id", "turn", arrays.uncons(a)["head"].alias("head"), arrays.unsnoc(a)["last"].alias("last"), _j(arrays.tail(a)).alias("tail"), _j(arrays.init(a)).alias("init"), _j(arrays.slice_of(a, 3, 3)).alias("sliced"), _j(both["after"]).alias("after"), _j(both["before"]).alias("before"), _j(arrays.indices_from_then_to(a, 1, 3, 5)).alias("stepped"))


_E = "list_position(list_transform(a, lambda x: suffix(x, '.')), true)"
_L = "len(a) + 1 - list_position(list_transform(list_reverse(a), lambda x: suffix(x, '.')), true)"


@query(f"SELECT conv_id, turn, array_to_string(a[:coalesce({_E}, len(a))], ' ') AS front, array_to_string(a[coalesce({_E}, len(a)) + 1:], ' ') AS back, array_to_string(a[:coalesce({_E} - 1, len(a))], ' ') AS without, array_to_string(a[coalesce({_L}, 0) + 1:], ' ') AS behind, len(list_filter(a, lambda x: suffix(x, '.'))) + CASE WHEN len(a) = 0 OR suffix(a[len(a)], '.') THEN 0 ELSE 1 END AS sentences, len(list_filter(a, lambda x: suffix(x, '.'))) + 1 AS pieces FROM ({_W})")
def array_breaks(read, spark):
    a, dot = F.col("a"), lambda x: x.endswith(".")
    whole, without, behind = arrays.break_end_by(a, dot), arrays.break_end_by(a, dot, keep=False), arrays.break_end_by_last(a, dot)
    return _words(read).select("conv_id", "turn", _j(whole["before"]).alias("front"), _j(whole["after"]).alias("back"), _j(without["before"]).alias("without"), _j(behind["after"]).alias("behind"), F.size(arrays.split_end_by(a, dot)).cast("long").alias("sentences"), F.size(arrays.split_on(a, dot)).cast("long").alias("pieces"))


_C = "list_transform(range(0, (len(a) + 2) // 3), lambda i: a[3 * i + 1:3 * i + 3])"


@query(f"SELECT conv_id, turn, array_to_string(flatten(list_transform({_C}, lambda c: list_append(c, '|'))), ' ') AS ended, array_to_string(list_transform({_C}, lambda c: array_to_string(c, ' ')), ' | ') AS separated, len(list_transform(range(0, (len(a) + 5) // 6), lambda i: i)) AS packed FROM ({_W}) WHERE len(a) > 0")
def array_concats(read, spark):
    chunks = arrays.chunks_of(F.col("a"), 3)
    return _words(read).filter(F.size("a") > 0).select("conv_id", "turn", _j(arrays.concat_end_by(chunks, F.lit("|"))).alias("ended"), _j(arrays.concat_sep_by(chunks, F.lit("|"))).alias("separated"), F.size(arrays.compact_max(chunks, 6)).cast("long").alias("packed"))


@query(f"SELECT conv_id, turn, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 2 THEN 'new' ELSE x END), ' ') AS put, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 3 THEN reverse(x) ELSE x END), ' ') AS modified, array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 THEN a[2] WHEN i = 2 THEN a[1] ELSE x END), ' ') AS swapped, array_to_string(list_append(a[-2:], 'end'), ' ') AS ring, array_to_string(list_concat(a[3:], a[1:2]), ' ') AS rotated FROM ({_W}) WHERE len(a) > 2")
def array_updates(read, spark):
    a = F.col("a")
    return _words(read).filter(F.size("a") > 2).select("conv_id", "turn", _j(arrays.put_index(a, 1, F.lit("new"))).alias("put"), _j(arrays.modify_index(a, 2, F.reverse)).alias("modified"), _j(arrays.swap_indices(a, 0, 1)).alias("swapped"), _j(arrays.insert_last_of(a, F.lit("end"), 3)).alias("ring"), _j(arrays.rotated(a, 2)).alias("rotated"))


@query("SELECT vec_id, list_min(embedding) AS least, list_max(embedding) AS greatest, len(list_filter(embedding, lambda x: x < 0)) AS low, embedding[1:3] < embedding[2:4] AS smaller, list_position(list_sort(embedding), embedding[5]) - 1 AS place, len(embedding) + 2 AS merged FROM embeddings")
def array_orders(read, spark):
    a = F.col("embedding")
    ends, three = arrays.range_of(a), lambda k: F.slice(a, k, 3)
    divided = arrays.divide_by(a, lambda x: x >= 0)
    low = arrays.find_indices(divided, lambda x: x >= 0)[0]
    return read("embeddings").select("vec_id", ends["least"].alias("least"), ends["greatest"].alias("greatest"), low.cast("long").alias("low"), (arrays.compare(three(1), three(2)) < 0).alias("smaller"), arrays.binary_search(F.array_sort(a), arrays.get_index(a, 4)).alias("place"), F.size(arrays.merge_by(a, F.slice(a, 1, 2))).cast("long").alias("merged"))


@query(f"SELECT conv_id, turn, CASE WHEN a[1:1] = ['The'] THEN array_to_string(a[2:], ' ') END AS stripped, coalesce(list_position(a, 'the') > 0, false) AS has, list_reduce(list_prepend(0, list_transform(a, lambda x: length(x))), lambda s, x: (s * 3 + x) % 1009) AS folded FROM ({_W})")
def array_prefixes(read, spark):
    a = F.col("a")
    step = lambda s, x: ((s * 3 + x) % 1009).cast("long")
    return _words(read).select("conv_id", "turn", _j(arrays.strip_prefix(a, F.array(F.lit("The")))).alias("stripped"), arrays.is_infix(F.array(F.lit("the")), a).alias("has"), arrays.fold(F.transform(a, lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), step).alias("folded"))


# bytes and text


@query("SELECT doc_id, md5(text) AS utf16, md5(text) AS swapped, NOT regexp_matches(text, '[^\\x{00}-\\x{ff}]') AS latin1, md5(regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g')) AS lax, md5(nfc_normalize(text)) AS nfc, md5(text) AS again FROM documents WHERE text IS NOT NULL")
def codecs_round_trip(read, spark):
    t = F.col("text")
    swapped = codecs.decode_utf16(codecs.swap_bytes(codecs.encode_utf16(t)), big=True)
    return read("documents").filter(t.isNotNull()).select("doc_id", F.md5(codecs.decode_utf16(codecs.encode_utf16(t))).alias("utf16"), F.md5(swapped).alias("swapped"), codecs.encode_latin1(t).isNotNull().alias("latin1"), F.md5(codecs.decode_latin1(codecs.encode_latin1_lax(t))).alias("lax"), F.md5(codecs.normalize(t)).alias("nfc"), F.md5(codecs.normalize(codecs.normalize(t, "NFD"), "NFC")).alias("again"))


@query("SELECT o_orderkey, o_totalprice AS double_back, o_totalprice::FLOAT::DOUBLE AS float_back, o_orderstatus = 'F' AS bool_back, CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END AS bool_bytes, (o_orderkey % 3 - 1)::INT AS ordering_back, 8 AS size, o_orderpriority AS listed FROM orders")
def binary_values(read, spark):
    x, b = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    ordering = (F.col("o_orderkey") % 3 - 1).cast("int")
    items = F.array(F.encode("o_orderstatus", "UTF-8"), F.encode("o_orderpriority", "UTF-8"))
    return read("orders").select("o_orderkey", codecs.decode_float(codecs.encode_float(x)).alias("double_back"), codecs.decode_float(codecs.encode_float(x, 4, big=False), 4, big=False).alias("float_back"), codecs.decode_bool(codecs.encode_bool(b)).alias("bool_back"), F.hex(codecs.encode_bool(b)).alias("bool_bytes"), codecs.decode_ordering(codecs.encode_ordering(ordering)).alias("ordering_back"), F.octet_length(codecs.encode_float(x)).alias("size"), F.decode(codecs.decode_list(codecs.encode_list(items))[1], "UTF-8").alias("listed"))


@query("SELECT n_nationkey, n_name AS packed, length(n_name) AS chars, 'x  y ' AS stripped, 'nation ' || n_name || ' in #{other}' AS filled, regexp_matches(n_name, '^[A-Za-z]+$') AS alpha FROM nation")
def text_values(read, spark):
    name = F.col("n_name")
    return read("nation").select("n_nationkey", codecs.pack(codecs.unpack(name)).alias("packed"), F.size(codecs.unpack(name)).cast("long").alias("chars"), codecs.strip_head(F.lit(" \t x  y ")).alias("stripped"), codecs.interpolated(F.lit("nation #{name} in #{other}"), {"name": name}).alias("filled"), codecs.is_ascii_alpha(name).alias("alpha"))


@query("SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS file, regexp_replace(p, '[^/]*$', '') AS dir, regexp_extract(p, '[^/](\\.[^./]+)$', 1) AS extension, len(list_filter(string_split(p, '/'), lambda x: x <> '')) + CASE WHEN p[1] = '/' THEN 1 ELSE 0 END AS parts, p[1] = '/' AS rooted, rtrim(p, '/') || '/a.txt' AS joined, rtrim(p, '/') || '/' AS ended, rtrim(p, '/') AS bare, true AS same, NULL::VARCHAR AS refused, 'a/b.html' AS replaced FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS p FROM pages) WHERE length(p) > 1")
def path_functions(read, spark):
    p = F.col("p")
    rows = read("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("p")).filter(F.length("p") > 1)
    bare = paths.drop_trailing_separators(p)
    return rows.select("page_id", paths.take_file_name(p).alias("file"), paths.take_directory(p).alias("dir"), paths.take_extension(p).alias("extension"), F.size(paths.split_path(p)).cast("long").alias("parts"), paths.is_rooted(p).alias("rooted"), paths.join(bare, F.lit("a.txt")).alias("joined"), paths.add_trailing_separator(bare).alias("ended"), bare.alias("bare"), paths.equal(p, F.concat(F.lit("/."), p, F.lit("//"))).alias("same"), paths.join(p, F.lit("/x")).alias("refused"), paths.replace_extension(F.lit("a/b.txt"), "html").alias("replaced"))


# items of a row


_U = "SELECT n_nationkey AS n FROM nation"


@query(f"SELECT n, array_to_string(list_transform(range(0, n), lambda i: i * i), ',') AS indices, array_to_string(range(2, n + 1), ',') AS enumerated, array_to_string(range(20, n - 1, -3), ',') AS downward, repeat('x', n) AS replicated, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS optional, array_to_string([3, 7, 15, 31, 63], ',') AS iterated, array_to_string(list_reverse(list_transform(string_split(n::VARCHAR, ''), lambda x: x::BIGINT)), ',') AS unfolded FROM ({_U})")
def unfold_items(read, spark):
    n, t = F.col("n_nationkey").cast("long"), lambda a: F.coalesce(F.array_join(a.cast("array<string>"), ","), F.lit(""))
    zero = F.lit(0).cast("long")
    digits = unfolds.unfolded(F.struct(n.alias("v"), F.lit(True).alias("first")), 9, lambda s: s["first"] | (s["v"] > 0), lambda s: s["v"] % 10, lambda s: F.struct(F.floor(s["v"] / 10).cast("long").alias("v"), F.lit(False).alias("first")))
    return read("nation").select(F.col("n_nationkey").alias("n"), t(unfolds.from_indices(n, lambda i: i * i)).alias("indices"), t(unfolds.enumerated(F.lit(2).cast("long"), n)).alias("enumerated"), t(unfolds.enumerated_then(F.lit(20).cast("long"), F.lit(17).cast("long"), n)).alias("downward"), F.array_join(unfolds.replicated(F.lit("x"), F.col("n_nationkey")), "").alias("replicated"), F.size(unfolds.optional(F.when(n % 2 == zero, n))).alias("optional"), t(unfolds.iterated(F.lit(3).cast("long"), 5, lambda x: x * 2 + 1)).alias("iterated"), t(digits).alias("unfolded"))


@query(f"SELECT n, array_to_string(flatten(list_transform(range(0, 3), lambda x: list_transform(range(0, n % 4), lambda y: x * 10 + y))), ',') AS crossed, CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN '0,10,20' WHEN 2 THEN '0,1,10,11,20,21' ELSE '0,1,10,2,11,20,12,21,22' END AS fair, array_to_string(list_transform(range(0, least(3, n % 4)), lambda x: x * 11), ',') AS zipped, array_to_string(flatten([[0], [0, 1], [0, 1, 2]]), ',') AS nested, '0,0,0,1,1,2' AS interleaved, '0,1,3,6' AS scanned, n AS first, 4 AS with_input, '0,1' AS taken FROM ({_U})")
def unfold_combined(read, spark):
    n = F.col("n_nationkey").cast("long")
    three = F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))
    some = F.coalesce(unfolds.from_indices(n % 4, lambda i: i), unfolds.none("bigint"))
    t = lambda a: F.array_join(a.cast("array<string>"), ",")
    upto = lambda x: F.sequence(F.lit(0).cast("long"), x)
    return read("nation").select(F.col("n_nationkey").alias("n"), t(unfolds.crossed(three, some, lambda x, y: x * 10 + y)).alias("crossed"), t(unfolds.fairly_crossed(three, some, lambda x, y: x * 10 + y)).alias("fair"), t(unfolds.zipped(three, some, lambda x, y: x * 10 + y)).alias("zipped"), t(unfolds.each(three, upto)).alias("nested"), t(unfolds.each_interleaved(three, upto)).alias("interleaved"), t(unfolds.scanned(F.transform(three, lambda x: x + 1), F.lit(0).cast("long"), lambda s, x: s + x)).alias("scanned"), unfolds.cons_input(three, n)[0].cast("int").alias("first"), F.size(F.concat(unfolds.with_input(three, n), unfolds.with_input(unfolds.one(n), n))).alias("with_input"), t(unfolds.take_while(three, lambda x: x < 2)).alias("taken"))


# more text, times, jobs


@query("SELECT o_orderkey, len(string_split_regex(o_orderpriority, '-| ')) AS parts, replace(o_orderpriority, '-', '') || '!' AS filled, CASE WHEN suffix(o_orderpriority, 'H') THEN o_orderpriority[:-2] END AS stripped, CASE WHEN contains(o_orderpriority, '-') THEN o_orderpriority[:strpos(o_orderpriority, '-')] ELSE o_orderpriority END AS until FROM orders")
def text_splits(read, spark):
    p = F.col("o_orderpriority")
    values = F.create_map(F.lit("p"), F.replace(p, F.lit("-"), F.lit("")))
    return read("orders").select("o_orderkey", F.size(text.split_by_one_of(p, ["-", " "])).cast("long").alias("parts"), text.expand_vars(F.lit("${p}!$none"), values).alias("filled"), text.strip_suffix(p, "H").alias("stripped"), text.take_until(p, "-").alias("until"))


@query("SELECT conv_id, i - 1 AS at, record FROM (SELECT conv_id, unnest(l) AS record, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, CASE WHEN suffix(t, '. ') THEN list_slice(string_split(t, '. '), 1, -2) ELSE string_split(t, '. ') END AS l FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1) WHERE t <> ''))")
def split_inner_by(read, spark):
    return text.rejoined(read("conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", ". ").select("conv_id", F.col("at").cast("long").alias("at"), "record")


@query(f"SELECT event_id, {US} * 1000 AS nanos, ts + INTERVAL 90 seconds AS shifted, {US} - min({US}) over (partition by user_id order by ts, event_id) AS since, {US} - epoch_us(TIMESTAMP '2024-01-01') AS apart, '1.500 m' AS shown FROM events")
def time_functions(read, spark):
    seq = Seq(read("events").select("user_id", "ts", "event_id"), ["ts", "event_id"], ["user_id"])
    ts = F.col("ts")
    back = times.from_nanos(times.to_nanos(ts))
    return ordered.time_indexed(seq, "ts").select("event_id", times.to_nanos(ts).alias("nanos"), times.shifted(back, 90_000_000).alias("shifted"), "since", times.difference(ts, F.lit("2024-01-01").cast("timestamp")).alias("apart"), times.shown(F.lit(90_000_000)).alias("shown"))


@query("SELECT o_orderkey, o_custkey * 2 AS doubled FROM orders UNION ALL SELECT c_custkey, c_nationkey * 2 FROM customer")
def par_concat_map(read, spark):
    left = parallel.mapped(read("orders").select("o_orderkey", "o_custkey"), 4, doubled=F.col("o_custkey") * 2).select("o_orderkey", "doubled")
    right = parallel.counted(read("customer"), "customers").select(F.col("c_custkey").alias("o_orderkey"), (F.col("c_nationkey") * 2).cast("long").alias("doubled"))
    return parallel.concatenated([parallel.evaluated(left, 3, ["o_orderkey"]), right])


@query("SELECT range AS k FROM range(0, 0) UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey >= 4")
def strip_prefix_rows(read, spark):
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return ordered.stripped_prefix(Seq(n, ["k"]), Seq(n.filter("k < 4"), ["k"]), "k")


@query("SELECT n_regionkey, string_agg(upper(n_name), '' ORDER BY n_nationkey) AS mapped, count(*) AS n FROM nation GROUP BY 1")
def fold_map(read, spark):
    return read("nation").groupBy("n_regionkey").agg(agg.folded_map(F.col("n_name"), F.col("n_nationkey"), F.upper, lambda a, b: F.concat(a, b)).alias("mapped"), F.count("*").alias("n"))


@query("SELECT n_nationkey, len(a) AS n, a[1] AS first FROM (SELECT n_nationkey, range(0, n_nationkey % 3 + 1) AS a FROM nation)")
def concat_map_optional(read, spark):
    out = expand.concat_map(read("nation").select("n_nationkey"), F.sequence(F.lit(0).cast("long"), (F.col("n_nationkey") % 3).cast("long")), "item")
    return out.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("item").alias("first"))
