"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import materialize, read, shielded, text_of


def content_hash(text: Column) -> Column:
    """128 bits of MD5 as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _repeated(hashes: DataFrame) -> DataFrame:
    """The hashes h that several rows have. Only hashes are shuffled, one a task each; the table's size is known to later joins."""
    return materialize(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "hashes")


def exact_groups(docs: DataFrame, keep: str = "smallest", hasher=content_hash) -> DataFrame:
    """One row per document with the group of byte-equal texts that it belongs to.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. ``keep`` names
    which doc_id of a group stays: ``smallest`` or ``largest``.

    A first pass counts hashes; a text whose hash no other row has is alone.
    Texts themselves are compared only among rows that share a hash, grouped
    by (hash, bytes), so that colliding texts stay apart. That grouping is
    combined on the map side: a group of copies, however large, sends one row
    per task. The way back to the documents is a join on two hashes whose
    group side has one row per text, which Spark splits when one hash is hot.

    A null text counts as empty; empty texts are one group. Rows that repeat a
    doc_id with one text count each in group_size, and all of them are kept
    where that doc_id stays. A null doc_id never wins against another; a group
    of null doc_ids keeps them all. Very long texts are compared whole. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    best = F.max if keep == "largest" else F.min
    base = text_of(docs).withColumn("h", hasher(F.col("text")))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    groups = (
        base.join(_repeated(base.select("h")), "h", "left_semi").groupBy("h", "text")
        .agg(best("doc_id").alias("best"), F.count(F.lit(1)).alias("size"))
        .select("h", sha, "best", "size")
    )
    joined = base.select("doc_id", "h", sha).join(groups, ["h", "text_sha256"], "left")
    own = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return joined.select(
        "doc_id", own.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns: one row per distinct text.

    The row with the smallest doc_id stays, or that with the ``largest``; a
    null doc_id only where no row of the text has one. Of rows that repeat the
    kept doc_id and text one stays, that whose other columns hash lowest. Null
    texts count as empty in the comparison and stay null in the result. Very
    long texts are compared whole; columns may have any names; an empty table
    gives no rows.
    """
    names = docs.columns
    plain = shielded(docs)
    doc_id, at = F.col(f"c{names.index('doc_id')}").cast("long"), names.index("text")
    text = F.coalesce(f"c{at}", F.lit(""))
    rest = [f"c{i}" for i, t in enumerate(t for _, t in docs.dtypes) if i != at]
    hashed = plain.withColumn("h", content_hash(text))
    many = _repeated(hashed.select("h"))
    alone = hashed.join(many, "h", "left_anti").select(*plain.columns)
    row = F.struct(F.col(f"c{at}").isNull().alias("none"), *rest)
    mixed = F.xxhash64(*[f"c{i}" for i, t in enumerate(t for _, t in docs.dtypes) if i != at and "map<" not in t], F.col(f"c{at}").isNull())
    best, order = (F.max_by, F.struct(doc_id.isNotNull().alias("a"), doc_id.alias("b"), mixed.alias("c"))) if keep == "largest" else (F.min_by, F.struct(doc_id.isNull().alias("a"), doc_id.alias("b"), mixed.alias("c")))
    kept = (
        hashed.join(many, "h", "left_semi").select("h", text.alias("text"), row.alias("row"), order.alias("order"))
        .groupBy("h", "text").agg(best("row", "order").alias("row"))
        .select(*[F.when(~F.col("row.none"), F.col("text")).alias(c) if i == at else F.col("row")[c].alias(c) for i, c in enumerate(plain.columns)])
    )
    return alone.unionByName(kept).toDF(*names)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
