"""Queries on parsers, over arrays and over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers as ps
from ..functions.parsers import P
from .registry import query

_A = "SELECT n_nationkey, list_transform(range(0, n_nationkey), lambda i: (i * 7 + n_nationkey) % 10) AS a FROM nation"


def _arrays(read):
    n = F.col("n_nationkey").cast("long")
    a = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: (i * 7 + n) % 10)).otherwise(F.array().cast("array<bigint>"))
    return read("nation").select("n_nationkey", a.alias("a"))


def _text(a):
    return F.array_join(a.cast("array<string>"), ",")


def _both(name, parsed):
    return [_text(parsed["value"]).alias(f"{name}_value"), _text(parsed["rest"]).alias(f"{name}_rest")]


def _sql(name, ok, n):
    """Value and rest of an array parser that takes n items if ok."""
    return f"CASE WHEN {ok} THEN array_to_string(a[1:{n}], ',') END AS {name}_value, CASE WHEN {ok} THEN array_to_string(a[({n}) + 1:], ',') ELSE array_to_string(a, ',') END AS {name}_rest"


def _run(p):
    """Length of the run at the front in which p (over x) holds."""
    return f"coalesce(list_position(list_transform(a, lambda x: {p}), false) - 1, len(a))"


@query(f"SELECT n_nationkey, {_sql('between', 'len(a) >= 3', 'least(len(a), 6)')}, {_sql('eq', 'len(a) >= 4', '4')}, {_sql('ge', 'len(a) >= 5', 'len(a)')}, {_sql('upto', 'true', 'least(len(a), 7)')} FROM ({_A})")
def parse_take(read, spark):
    a = F.col("a")
    parts = {"between": ps.take_between(a, 3, 6), "eq": ps.take_eq(a, 4), "ge": ps.take_ge(a, 5), "upto": ps.take_up_to(a, 7)}
    return _arrays(read).select("n_nationkey", *(c for name, p in parts.items() for c in _both(name, p)))


@query(f"SELECT n_nationkey, {_sql('run', 'true', _run('x <> 3'))}, {_sql('some', _run('x > 4') + ' > 0', _run('x > 4'))}, array_to_string(a[{_run('x <> 3')} + 1:], ',') AS dropped, {_sql('ended', 'true', 'least(' + _run('x <> 3') + ' + 1, len(a))')}, {_sql('begun', 'len(a) = 0 OR a[1] > 4', 'least(len(a), 1 + coalesce(list_position(list_transform(a[2:], lambda x: x <= 4), false) - 1, len(a[2:])))')} FROM ({_A})")
def parse_take_while(read, spark):
    a = F.col("a")
    parts = {"run": ps.take_while(a, lambda x: x != 3), "some": ps.take_while(a, lambda x: x > 4, least=1), "ended": ps.take_end_by(a, lambda x: x == 3), "begun": ps.take_begin_by(a, lambda x: x > 4)}
    return _arrays(read).select("n_nationkey", _text(ps.drop_while(a, lambda x: x != 3)).alias("dropped"), *(c for name, p in parts.items() for c in _both(name, p)))


_ROLL = "coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: i = 1 OR a[i] >= a[i - 1]), false) - 1, len(a))"


@query(f"SELECT n_nationkey, {_sql('grouped', 'len(a) > 0', _run('x <= a[1] + 3 AND x >= a[1] - 3'))}, {_sql('rolling', 'len(a) > 0', _ROLL)}, array_to_string(a[1:{_run('x <> 0')}], ',') AS yes, array_to_string(a[{_run('x <> 0')} + 1:], ',') AS no FROM ({_A})")
def parse_group_by(read, spark):
    a = F.col("a")
    span = ps.span(a, lambda x: x != 0)
    return _arrays(read).select("n_nationkey", *_both("grouped", ps.group_by(a, lambda f, x: F.abs(x - f) <= 3)), *_both("rolling", ps.group_by_rolling(a, lambda p, x: x >= p)), _text(span["yes"]).alias("yes"), _text(span["no"]).alias("no"))


@query(f"SELECT n_nationkey, {_sql('list', 'len(a) > 1 AND a[1:2] = [5, 2]', '2')}, {_sql('one_eq', 'len(a) > 0 AND a[1] = 5', '1')}, {_sql('not_eq', 'len(a) > 0 AND a[1] <> 5', '1')}, {_sql('one_of', 'len(a) > 0 AND a[1] IN (1, 2, 3)', '1')}, {_sql('none_of', 'len(a) > 0 AND a[1] NOT IN (1, 2, 3)', '1')}, {_sql('one', 'len(a) > 0', '1')}, len(a) = 0 AS at_end, CASE WHEN len(a) > 0 THEN a[1] END AS peeked, {_sql('alt', 'len(a) > 0 AND (a[1] = 5 OR len(a) >= 9)', 'CASE WHEN a[1] = 5 THEN 1 ELSE 9 END')} FROM ({_A})")
def parse_items(read, spark):
    a = F.col("a")
    three = F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))
    parts = {"list": ps.list_eq(a, F.array(F.lit(5).cast("long"), F.lit(2).cast("long"))), "one_eq": ps.one_eq(a, F.lit(5)), "not_eq": ps.one_not_eq(a, F.lit(5)), "one_of": ps.one_of(a, three), "none_of": ps.none_of(a, three), "one": ps.one(a), "alt": ps.alt(ps.one_eq(a, F.lit(5)), ps.take_eq(a, 9))}
    return _arrays(read).select("n_nationkey", ps.eof(a)["ok"].alias("at_end"), F.get(ps.peek(a)["value"], F.lit(0)).alias("peeked"), *(c for name, p in parts.items() for c in _both(name, p)))


@query(f"SELECT n_nationkey, CASE WHEN len(a) >= 5 THEN array_to_string(a[1:2], ',') END AS first, CASE WHEN len(a) >= 5 THEN array_to_string(a[3:5], ',') END AS second, array_to_string(CASE WHEN len(a) >= 5 THEN a[6:] ELSE a END, ',') AS rest, array_to_string(a, ',') AS ahead FROM ({_A})")
def parse_split_with(read, spark):
    a = F.col("a")
    both = ps.split_with(ps.take_eq(a, 2), lambda r: ps.take_eq(r, 3), a)
    return _arrays(read).select("n_nationkey", _text(both["first"]).alias("first"), _text(both["second"]).alias("second"), _text(both["rest"]).alias("rest"), _text(ps.look_ahead(ps.take_eq(a, 2), a)["rest"]).alias("ahead"))


@query(f"SELECT n_nationkey, len(list_filter(a, lambda x: x = 3)) + 1 AS contents, len(list_filter(a, lambda x: x = 3)) AS separators, string_split(array_to_string(list_transform(a, lambda x: CASE WHEN x = 3 THEN '|' ELSE x::VARCHAR END), ''), '|')[1] AS first FROM ({_A})")
def parse_deintercalate(read, spark):
    both = ps.deintercalate(F.col("a"), lambda x: x == 3)
    return _arrays(read).select("n_nationkey", F.size(both["contents"]).cast("long").alias("contents"), F.size(both["separators"]).cast("long").alias("separators"), F.array_join(both["contents"][0].cast("array<string>"), "").alias("first"))


@query("SELECT n_nationkey, n_nationkey >= 11 AS ok, CASE WHEN n_nationkey >= 11 THEN 11 END AS taken FROM nation")
def parse_subsequence(read, spark):
    a = F.transform(F.sequence(F.lit(0), F.col("n_nationkey")), lambda i: i % 10)
    found = ps.subsequence(F.slice(a, F.lit(1), F.col("n_nationkey")), F.array(F.lit(2), F.lit(7), F.lit(0)))
    return read("nation").select("n_nationkey", found["ok"].alias("ok"), F.size(found["value"]).alias("taken"))


# text


@query("SELECT event_id, CAST(regexp_extract(props, '^\\{\"k\": *([0-9]+)\\}', 1) AS BIGINT) AS k, regexp_extract(event_type, '^[a-m]*', 0) AS front, regexp_replace(event_type, '^[a-m]*', '') AS rest FROM events")
def parse_text(read, spark):
    number = P("[0-9]++").value()
    field = ps.string('{"k":') + ps.SPACES + number + ps.char("}")
    front = P("[a-m]").many().parse(F.col("event_type"))
    return read("events").select("event_id", field.parse(F.col("props"))["value"].cast("long").alias("k"), front["value"].alias("front"), front["rest"].alias("rest"))


@query("SELECT page_id, regexp_matches(url, '^(?i:HTTPS?)://') AS ok, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(url, '[^/]+')) AS parts FROM pages")
def parse_urls(read, spark):
    scheme = (ps.string_ignore_case("HTTPS") | ps.string_ignore_case("HTTP")) + ps.string("://")
    host = P("[a-z]").some() + ps.string("://") + ps.chars_not_in("/").some().value()
    parts = ps.char("/").many() + ps.chars_not_in("/").some().value()
    u = F.col("url")
    return read("pages").select("page_id", scheme.parse(u)["ok"].alias("ok"), host.parse(u)["value"].alias("host"), F.size(parts.parse_many(u)).cast("long").alias("parts"))


@query("SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS till, len(string_split(o_orderpriority || '-', '-')) - 1 AS fields, CASE WHEN regexp_matches(o_orderpriority, '^[0-9]') THEN o_orderpriority[1:1] END AS digit, regexp_extract(o_orderpriority, '^[0-9A-Z]{1,2}', 0) AS counted FROM orders")
def parse_repeated(read, spark):
    s = F.col("o_orderpriority")
    till = ps.any_char().many_till(ps.char("-") | ps.end())
    fields = ps.chars_not_in("-").many().value() + (ps.char("-") | ps.end())
    return read("orders").select("o_orderkey", F.regexp_replace(till.parse(s)["value"], "-$", "").alias("till"), F.size(fields.parse_many(F.concat(s, F.lit("-")))).cast("long").alias("fields"), P("[0-9]").count(1).parse(s)["value"].alias("digit"), P("[0-9A-Z]").between(1, 2).parse(s)["value"].alias("counted"))


@query("SELECT n_nationkey, '(a(b' || n_nationkey || ')c)' AS block, 'x' || n_nationkey || 'y' AS escaped, 'q' || n_nationkey || ' w' AS quoted, 'say ''q' || n_nationkey || ' w'' x' AS kept, n_nationkey + 2 AS words FROM nation")
def parse_framed(read, spark):
    n = F.col("n_nationkey").cast("string")
    block = ps.nested_block("(", ")").parse(F.concat(F.lit("(a(b"), n, F.lit(")c)d)")))
    escaped = ps.framed("[", "]", "\\").parse(F.concat(F.lit("[x"), n, F.lit("y]z")))
    line = F.concat(F.lit("say 'q"), n, F.lit(" w' x"))
    words = ps.words_with_quotes(line)
    kept = ps.words_with_quotes(line, keep=True)
    many = ps.words_by(" ").parse_many(F.concat(F.lit(" a b"), F.repeat(F.lit(" c"), F.col("n_nationkey"))))
    return read("nation").select("n_nationkey", block["value"].alias("block"), escaped["value"].alias("escaped"), words[1].alias("quoted"), F.array_join(kept, " ").alias("kept"), F.size(many).alias("words"))


@query("SELECT n_nationkey, 'a' || n_nationkey || ';' || '\"b,c\";d' AS spaced, 'a\\,b' || n_nationkey AS field FROM nation")
def parse_quoted_separators(read, spark):
    n = F.col("n_nationkey").cast("string")
    spaced = ps.spaced_outside_quotes(F.concat(F.lit("a"), n, F.lit(',"b,c",d')), ",", ";")
    field = ps.take_end_by_escaped("\\", ",").parse(F.concat(F.lit("a\\,b"), n, F.lit(",c")))
    return read("nation").select("n_nationkey", spaced.alias("spaced"), field["value"].alias("field"))


@query("SELECT n_nationkey, (((n_nationkey - 3) * 2) + 7)::BIGINT AS chained, (n_nationkey - (3 - 2))::BIGINT AS from_right, NULL::BIGINT AS wrong, n_nationkey::VARCHAR || '=a;b=' AS rest FROM nation")
def parse_chains(read, spark):
    n = F.col("n_nationkey").cast("string")
    ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}
    pairs = ps.chars_in("xyz").some() + ps.char("=") + ps.DIGITS + ps.char(";").optional()
    return read("nation").select("n_nationkey", ps.chain_left(F.concat(n, F.lit(" - 3 * 2 + 7")), ops).alias("chained"), ps.chain_right(F.concat(n, F.lit("-3-2")), "-", lambda a, b: a - b).alias("from_right"), ps.chain_left(F.concat(n, F.lit(" - x")), ops).alias("wrong"), pairs.parse_many_rest(F.concat(F.lit("x=1;zz=22;"), n, F.lit("=a;b="))).alias("rest"))


@query("SELECT n_nationkey, 'k,kk,kkk'[1:1 + 3 * (n_nationkey % 2)] AS listed, n_nationkey % 2 = 1 AS two, true AS none FROM nation")
def parse_sep_by(read, spark):
    s = F.when(F.col("n_nationkey") % 2 == 1, "k,kk;").otherwise("k;")
    listed = ps.chars_in("k").some().sep_by1(ps.char(","))
    two = ps.chars_in("k").some() + ps.char(",") + ps.chars_in("k").some().ahead()
    return read("nation").select("n_nationkey", listed.parse(s)["value"].alias("listed"), two.parse(s)["ok"].alias("two"), ps.chars_in("z").some().sep_by(ps.char(",")).parse(s)["ok"].alias("none"))
