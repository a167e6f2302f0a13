"""The registered queries, column by column: against SQL where there is some, else against plain code on the smallest tables."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from tideline.llm import bpe, main_text, queries

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def read_texts(spark, folder=DATA):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return read_texts(spark)


def result(spark, name, key="doc_id", folder=DATA):
    rows = queries.QUERIES[name](spark, folder).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want.select(*columns).fetchall())


def test_op1(spark, texts):
    reference = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = result(spark, "op1_byte_bpe")
    assert set(out) == set(texts)
    for i, t in texts.items():
        ids = reference.encode_ordinary(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def spans_of(text, patterns):
    """(kind, start, end) of the patterns' matches that pass, by kind."""
    return [(kind, *m.span()) for kind, pattern, good in patterns for m in re.finditer(pattern, text) if good(m)]


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_op2(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table has no secrets
    texts = read_texts(spark, folder)
    name = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    patterns = [
        ("assign", rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    kinds = [k for k, *_ in patterns]
    out, added = result(spark, "op2_secret_scan", folder=folder), 0
    assert set(out) == set(texts)
    for i, t in texts.items():
        base = sorted(spans_of(t, patterns), key=lambda x: (x[1], kinds.index(x[0])))
        assert [out[i][f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        assert out[i]["base_sha256"] == sha(written(base))
        spans = [x for x in out[i]["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("random:")] == [x for x in written(base).split(",") if x]
        added += len(spans) - len(base)
    assert added > 0


def test_op5(spark, texts):
    out, size, slots, shard_of = result(spark, "op5_sharding"), collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    assert set(out) == set(texts)
    for i, t in texts.items():
        r = out[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard_of[t].add(r["shard"])
    assert set(size) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / 24
    whole = max(sum(len(t.encode()) + 8 for x in texts.values() if x == t) for t, s in shard_of.items() if len(s) == 1)
    assert all(len(s) == 1 for t, s in shard_of.items() if (len(t.encode()) + 8) * sum(x == t for x in texts.values()) <= share)
    # a heavy text may be larger than a share by itself; nothing else may stand out
    assert max(size.values()) <= max(1.01 * share, whole + 8)


def test_op6(spark, texts):
    out = result(spark, "op6_language_id")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = []
    for i, t in texts.items():
        r = out[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t)) and r["lang_pred"] in {"und", *langs.values()}
        if r["held_out"] and langs[i] and len(t) > 200:
            held.append(r["lang_pred"] == langs[i])
    assert len(held) > 20 and sum(held) >= 0.95 * len(held)


def test_op7(spark):
    out = result(spark, "op7_main_text", "page_id")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        r = out[p["page_id"]]
        assert (r["url"], r["n_chars"], r["text"]) == (p["url"], len(r["text"]), main_text.main_text(p["html"]))
        # what is kept stands in the page, in this order, and holds no markup
        seen = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p["html"] or "")))
        at = 0
        for block in filter(None, r["text"].split("\n\n")):
            assert block == re.sub(r"\s+", " ", block).strip() and (at := seen.find(block.split(" ")[0], at)) >= 0
            at += 1


def test_op8(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    counts = collections.Counter(hash(b[k : k + 200]) for b in data.values() for k in range(len(b) - 199))
    out = result(spark, "op8_suffix_dedup")
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if counts[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept_sha256"]) == (len(b), sum(gone), runs, sha(kept))


def luhn(digits):
    twice = lambda d: d * 2 - 9 * (d > 4)
    return sum(twice(int(d)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_op10(spark, texts):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    out = result(spark, "op10_pii")
    assert set(out) == set(texts)
    for i, t in texts.items():
        base = spans_of(t, patterns)
        assert [out[i][f"n_{k}"] for k, *_ in patterns] == [sum(x[0] == k for x in base) for k, *_ in patterns]
        assert out[i]["base_sha256"] == sha(written(base))
        assert [x for x in out[i]["spans"].split(",") if x and not x.startswith("other:")] == [x for x in written(base).split(",") if x]
