"""URL rules as a sort-merge range join of canonical keys."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [  # host, path, verdict
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels from the last to the first, each closed by NUL: a host's subdomains are an interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0"))


class _Open:
    """The rules of one host that is open in the sweep: their paths, by how long they are."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.sizes = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        self.paths[path] = verdict
        if len(path) not in self.sizes:
            self.sizes = sorted([*self.sizes, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        """The longest of the paths that ``path`` starts with; as many look-ups as they have lengths."""
        return next((path[:n] for n in self.sizes if path[:n] in self.paths), None)


def _sweep(default: str):
    """Match rows sorted by (cell, key, kind): kind 0 is a rule, at its host's key; kind 1 a URL.

    Hosts that are open form a stack, as their intervals nest. It changes only
    between keys; URLs of one host that also have one path are matched once.
    """

    def run(batches):
        cell, stack = None, []
        for b in batches:
            cells, keys, kinds, hosts, paths, verdicts = (b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            rule, verdict, before, found = [], [], None, (None, default)
            for c, key, kind, host, path, says in zip(cells, keys, kinds, hosts, paths, verdicts, strict=True):
                if c != cell:
                    cell, stack, before = c, [], None
                if key != before or not kind:
                    while stack and not key.startswith(stack[-1].key):
                        stack.pop()
                    before = key
                    if not kind:
                        if not stack or stack[-1].key != key:
                            stack.append(_Open(key, host))
                        stack[-1].add(path, says)
                        before = None
                    else:
                        fits = [(len(o.host) + len(p), len(o.host), o, p) for o in stack if (host == o.host or host.endswith("." + o.host)) and (p := o.longest(path)) is not None]
                        best = max(fits, key=lambda x: x[:2], default=None)
                        found = (best[2].host + best[3], best[2].paths[best[3]]) if best else (None, default)
                rule.append(found[0])
                verdict.append(found[1])
            urls = pa.array(kinds, pa.int32()).to_numpy() == 1
            out = pa.RecordBatch.from_arrays([b.column(3), b.column(4), b.column(5), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])
            yield out.filter(pa.array(urls))

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", cells: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains
    where the URL's path starts with the rule's path. The longest rule (host
    and path together, then the host) wins, else ``default`` holds. Of rules
    equal in host and path one verdict holds, the greatest by name.

    A host's reversed labels are a prefix of those of its subdomains, so a
    rule covers an interval of keys. URLs are cut into cells of the key order
    (ties cut by a hash of the row, so that one hot URL fills many cells), a
    rule, one row each, is sent to the cells that its interval meets, and one
    sorted sweep of each cell keeps the stack of hosts that are open. Intervals nest, so a
    cell receives few rules besides those that begin in it. The cuts come from
    a sample; they balance the work and do not change results.

    Null URLs and those without ``://`` have an empty host and path and match
    no rule; so does an empty path, as rules' paths begin with a slash. Null
    page_ids and repeated rows are kept. Empty tables give no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
    ).withColumn("key", F.concat(host_key(F.col("host")), F.lit("\1"), "path")).withColumn("salt", F.xxhash64("page_id", "key"))
    n = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(urls, n)

    @F.pandas_udf("int")
    def cell_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, (k, s)) for k, s in zip(key, salt, strict=True)], dtype="int32")

    single = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
        .withColumn("first", cell_of("key", F.lit(-(2**63)).cast("long")))
        .withColumn("last", cell_of(F.concat("key", F.lit("\U0010ffff")), F.lit(2**63 - 1)))
    )
    opened = single.select(F.explode(F.sequence("first", "last")).alias("cell"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    both = urls.select(cell_of("key", "salt").alias("cell"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(opened)
    return (
        both.repartition(n, "cell").sortWithinPartitions("cell", "key", "kind")
        .mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
    )


def _cuts(urls: DataFrame, n: int) -> list[tuple[str, int]]:
    """n - 1 cuts of the (key, salt) order from about 40 sampled rows a cell."""
    rows = urls.count()
    share = min(1.0, 40 * n / max(rows, 1))
    found = sorted((r["key"], r["salt"]) for r in urls.select("key", "salt").sample(share, seed=7).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


SQL = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
