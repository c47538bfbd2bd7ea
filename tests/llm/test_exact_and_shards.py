"""Exact groups, sharding and URL rules against plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelog.llm import exact_dedup, queries, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE[name])


def test_exact_groups_edge_cases(spark):
    rows = docs(spark, (1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200_000), (None, "a"), (6, "c"), (6, "c"))
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows).collect()}
    assert got == {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 2, True)}
    assert exact_dedup.exact_groups(rows.limit(0)).isEmpty()


def test_colliding_hashes_stay_apart(spark):
    rows = docs(spark, (1, "aa"), (2, "ab"), (3, "aa"), (4, "ac"))
    weak = lambda text: F.substring(text, 1, 1).cast("binary")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(rows, "largest", weak).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_dedup_keeps_one_row_and_its_columns(spark):
    rows = docs(spark, (1, "a"), (2, "a"), (3, None), (4, ""), (None, "z"), (None, "z")).withColumn("_h", F.lit(7))
    for keep, want in (("smallest", {1, 3, None}), ("largest", {2, 4, None})):
        out = exact_dedup.exact_dedup(rows, keep)
        assert out.columns == rows.columns and {r["doc_id"] for r in out.collect()} == want and out.count() == 3
    assert exact_dedup.exact_dedup(rows).filter("doc_id = 3").first()["text"] is None
    clash = ["doc_id", "text", "h", "__null", "a.b", "row", "c0"]
    odd = docs(spark, (1, "a"), (1, "a"), (2, "b"), (3, "a")).select("doc_id", "text", *[F.lit(k) for k in range(5)]).toDF(*clash)
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == clash and sorted(map(tuple, out.collect())) == [(1, "a", 0, 1, 2, 3, 4), (2, "b", 0, 1, 2, 3, 4)]
    assert exact_dedup.exact_dedup(odd.limit(0)).isEmpty()


def _feistel(x, n, seed):
    import struct

    import xxhash

    def h(v, key):
        first = xxhash.xxh64(struct.pack("<q", v), seed=42).intdigest()
        return xxhash.xxh64(struct.pack("<i", key), seed=first).intdigest()

    def signed(u):
        return u - 2**64 if u >= 2**63 else u

    a, b = sharding.sides(n)
    left, right = x % a, x // a
    for i in range(sharding.ROUNDS):
        key = seed * sharding.ROUNDS + i
        if i % 2 == 0:
            left = (left + signed(h(right, key)) % a) % a
        else:
            right = (right + signed(h(left, key)) % b) % b
    return left + right * a


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 4097])
def test_permutation(spark, n):
    got = [r["p"] for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 17).alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    want = []
    for x in range(n):
        x = _feistel(x, n, 17)
        while x >= n:
            x = _feistel(x, n, 17)
        want.append(x)
    assert got == want


def test_shards(spark):
    rows = docs(spark, *[(i, f"text {i % 40}" * (i % 7)) for i in range(203)], (None, None), (5, "x"), (5, "x"))
    out = sharding.shard_documents(rows).collect()
    assert len(out) == 206 and {r["law"] for r in out} == {"rows"}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None} == {(1, 0)}
    one = next(r for r in out if r["doc_id"] == 13)
    assert (one["size"], one["text_crc32"]) == (len("text 13" * 6) + 1, zlib.crc32(b"text 13" * 6))
    again = sharding.shard_documents(rows.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))  # the shuffle does not depend on how rows lie
    assert sharding.shard_documents(rows.limit(0)).isEmpty()


def test_url_edge_cases(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.COM/en/x?y"), (5, "x://a.example.com/en/"), (6, "x://example.com/enx"), (7, "x://notexample.com/en/"), (8, "x://net/es/"),
         (9, "x://com"), (10, "x://com./"), (11, "x://example.com/en/a#b://c"), (None, "x://com/"), (4, "HTTP://WWW.Example.COM/en/x?y"), (12, "x://É.com/ü?q")], "page_id long, url string",
    )
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, cells=3).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2:] == ("example.com/en/", "block") and got[6][2] == "com/" == got[7][2]
    assert got[8][2] == "net/es/" and got[9] == ("com", "", None, "allow") and got[10][2] is None and got[11][1:3] == ("/en/a", "example.com/en/")
    assert got[None][2] == "com/" and got[12][:2] == ("É.com", "/ü")
    clash = url_filter.filter_urls(pages.select("page_id", "url", *[F.lit(1)] * 6).toDF("page_id", "url", "cell", "key", "host", "path", "rule", "a.b"), rules, cells=3)
    assert {tuple(r)[:1] + tuple(r)[3:] for r in clash.collect()} == {(k, *v[2:]) for k, v in got.items()}
    assert url_filter.filter_urls(pages.limit(0), rules).isEmpty() and url_filter.filter_urls(pages, rules.limit(0)).filter("rule IS NOT NULL").isEmpty()


def test_many_nested_rules(spark):
    import random

    rng = random.Random(2)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(["/", "/a/", "/a/b/", "/b"])): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    pages = [(i, f"h://{host()}{rng.choice(['/', '/a/', '/a/b/c', '/b', ''])}") for i in range(400)] + [(1000 + i, "h://a.b/a/b/") for i in range(300)]
    df = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), df, "none", cells=9).collect()
    assert len(out) == len(pages)
    for r in out:
        fit = [((len(h) + len(p), len(h)), h + p, v) for (h, p), v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fit)[1:] if fit else (None, "none"))
