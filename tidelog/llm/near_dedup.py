"""MinHash near-deduplication: bottom-k sketches, inverted lists, exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidelog.llm._base import binary_texts, lean, materialize, read, release, shielded, shingle_hashes, slices, text_of

WIDTH = 5
SIMILARITY = 0.75
K = 64  # values of one hash function that a sketch retains
#: Retained values that two texts with SIMILARITY share at least: of K draws that each hit with
#: probability 0.75, fewer than 28 do with probability 1e-8.
SHARED = 28
FEW = 8  # members of an inverted list that a plain join may pair
BLOCK_BYTES = 6 << 20  # of sets of a longer list that are compared with as many others in one piece
ROW_BYTES = 200  # of a member besides its set


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        h, at = shingle_hashes(texts[a:b], width)
        out += [np.unique(h[at[i] : at[i + 1]]) for i in range(b - a)]
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits over a whole set; equal sets have equal ones."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), sig, sketch (the K smallest hashes, as signed longs in unsigned order)."""

    def run(batches):
        for b in batches:
            texts = binary_texts(b.column(1))
            for i in range(0, len(texts), 500):
                sets = shingle_sets(texts[i : i + 500])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signature, sets), pa.binary()),
                        pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "sig", "sketch"],
                )

    return text_of(docs).mapInArrow(lean(run), "doc_id long, n long, sig binary, sketch array<long>")


def _similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= 75 * (a + b - shared)


def _sketch_filter(batches):
    """Pairs whose union sketch allows for SIMILARITY: columns a, b, na, nb, sa, sb.

    The K smallest values of the union are known from both sketches; those in
    both sketches estimate the similarity. Whole small sets are compared exactly.
    """
    for t in batches:
        c = [t.column(i).to_pylist() for i in range(4)]
        keep = []
        for na, nb, sa, sb in zip(c[2], c[3], t.column(4).to_numpy(zero_copy_only=False), t.column(5).to_numpy(zero_copy_only=False), strict=True):
            sa, sb = np.asarray(sa).view(np.uint64), np.asarray(sb).view(np.uint64)
            both = np.intersect1d(sa, sb, assume_unique=True)
            if na <= K and nb <= K:
                keep.append(_similar(len(both), na, nb))
                continue
            union = np.union1d(sa, sb)[:K]
            keep.append(4 * min(na, nb) >= 3 * max(na, nb) and int(np.isin(both, union, assume_unique=True).sum()) >= SHARED)
        yield t.filter(pa.array(keep, pa.bool_())).select(["a", "b", "na", "nb"])


def _verify(batches):
    """Pairs that are similar by their whole sets: columns a, b, set_a, set_b."""
    for t in batches:
        keep = []
        for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield t.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """nid, comp (the smallest nid reachable) of every node of ``links`` (a, b)."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("nid"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("nid", "b"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "nid").select("nid", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("nid").alias("comp"), F.col("comp").alias("far"))
        new = materialize(low.join(jump, "comp").select("nid", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = new.select("nid", "comp")
        if new.filter("was <> comp").isEmpty():
            return labels


class _Linker:
    """Components of nodes (distinct shingle sets) from the links found so far. New links are between components
    alone, so each round works on what is still apart and not on all links again."""

    def __init__(self, nodes: DataFrame, sets: DataFrame):
        self.nodes, self.sets, self.comps = nodes, sets, None

    def add(self, pairs: DataFrame) -> None:
        """Filter candidate pairs (a, b) by sketches, verify them on whole sets and update the components."""
        n = self.nodes.select("nid", "n", "sketch")
        joined = pairs.join(n.toDF("a", "na", "sa"), "a").join(n.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
        likely = joined.mapInArrow(lean(_sketch_filter), "a long, b long, na long, nb long").select("a", "b")
        whole = likely.join(self.sets.toDF("a", "set_a"), "a").join(self.sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        self.take(materialize(whole.mapInArrow(lean(_verify), "a long, b long"), "links"))

    def take(self, found: DataFrame) -> None:
        """Take up confirmed links."""
        if self.comps is None:
            self.comps = components(found)
            return
        own = self.comps.select(F.col("nid").alias("a"), F.col("comp").alias("ca"))
        other = self.comps.select(F.col("nid").alias("b"), F.col("comp").alias("cb"))
        between = found.join(own, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
        between = materialize(between, "between")
        if between.isEmpty():
            return
        merged = components(between)
        moved = self.comps.join(merged.select(F.col("nid").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("nid", F.coalesce("to", "comp").alias("comp"))
        fresh = merged.join(self.comps.select("nid"), "nid", "left_anti").select("nid", "comp")
        self.comps = materialize(moved.unionByName(fresh), "comps")

    def with_comp(self, entries: DataFrame) -> DataFrame:
        return entries.join(self.comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))

    def open_lists(self, entries: DataFrame) -> DataFrame:
        """Entries (v, nid, n, comp, members, bytes) of the lists whose members are in several components."""
        have = self.with_comp(entries)
        size = F.sum(F.col("n") * 8 + ROW_BYTES)
        several = have.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), size.alias("bytes")).filter("lo < hi").select("v", "members", "bytes")
        return materialize(have.join(several, "v").select("v", "nid", "n", "comp", "members", "bytes"), "open")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(v, nid): for each node the rarest retained values that any partner must share one of.

    Two similar texts share at least ``o`` retained values, so in one order of
    all values each has a shared one among all but its last o - 1. In the
    order by frequency those are seldom the values of widespread passages.
    Values that one node alone retains lead that order and link nothing.
    """
    entries = nodes.select("nid", "n", F.explode("sketch").alias("v"))
    common = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    kept = entries.join(common, "v")
    o = F.when(F.col("n") > K, F.lit(SHARED)).otherwise(F.least(F.ceil(F.col("n") * 3 / 4), K - F.floor(F.col("n") / 3)))
    size = F.least("n", F.lit(K))
    w = Window.partitionBy("nid")
    ranked = kept.withColumn("alone", size - F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("df", "v")))
    return ranked.filter(F.col("rank") + F.col("alone") <= size - o + 1).select("v", "nid", "n")


class _Codes:
    """Rows of values as codes of the values that occur among them, to mark one row and look up the others at once."""

    def __init__(self, rows: list[np.ndarray]):
        values, code = np.unique(np.concatenate(rows), return_inverse=True)
        self.code, self.at = code.reshape(-1), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        self.mark = np.zeros(len(values), dtype=np.int64)

    def shared(self, k: int, rows: np.ndarray) -> np.ndarray:
        """How many values row ``k`` shares with each of ``rows``."""
        own = self.code[self.at[k] : self.at[k + 1]]
        self.mark[own] = 1
        size = self.at[rows + 1] - self.at[rows]
        edge = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(self.at[rows] - edge[:-1], size) + np.arange(edge[-1])
        sums = np.concatenate(([0], np.cumsum(self.mark[self.code[place]])))
        self.mark[own] = 0
        return sums[edge[1:]] - sums[edge[:-1]]


def _block_links(table: pa.Table) -> pa.Table:
    """Links between components from one block of a list's members to one block of those outside its largest component.

    Each of the latter is held against all the members at once: by what their
    sketches share, then by whole sets. A pair that meets in several long
    lists is looked at in the first of them alone. Components grow as links are
    found and what is joined already is passed over, so a block gives fewer
    links than it has rows.
    """
    found: list[tuple[int, int]] = []
    ids, n, comp, asks = (table.column(c).to_numpy() for c in ("nid", "n", "comp", "asks"))
    order = np.lexsort((ids, ~asks))
    ids, n, comp, asks = ids[order], n[order], comp[order], asks[order]
    raw, lists = table.column("set").to_pylist(), table.column("lists").to_pylist()
    sets = [np.frombuffer(raw[k], np.uint64) for k in order]
    here, outside = table.column("v")[0].as_py(), table.column("apart").to_numpy()[order]
    lists = [np.array([v for v in lists[k] if v < here], dtype=np.int64) for k in order]
    members = np.flatnonzero(~asks)
    if len(members) and asks.any():
        _, group = np.unique(comp, return_inverse=True)
        up = list(range(int(group.max()) + 1))

        def top(g: int) -> int:
            while up[g] != g:
                up[g] = up[up[g]]
                g = up[g]
            return g

        sketch, before, whole = _Codes([s[:K] for s in sets]), _Codes(lists), None
        for k in np.flatnonzero(asks).tolist():
            # two members outside meet in both roles, and the smaller one asks
            cand = members[(group[members] != group[k]) & (~outside[members] | (ids[members] > ids[k]))]
            cand = cand[4 * np.minimum(n[cand], n[k]) >= 3 * np.maximum(n[cand], n[k])]
            both = sketch.shared(k, cand)
            small = (n[cand] <= K) & (n[k] <= K)
            cand = cand[np.where(small, 100 * both >= 75 * (n[cand] + n[k] - both), both >= SHARED)]
            if len(cand):
                cand = cand[before.shared(k, cand) == 0]
            cand = cand[[top(g) != top(int(group[k])) for g in group[cand].tolist()]] if len(cand) else cand
            if not len(cand):
                continue
            whole = whole or _Codes(sets)
            both = whole.shared(k, cand)
            for m in cand[100 * both >= 75 * (n[cand] + n[k] - both)].tolist():
                a, b = top(int(group[k])), top(int(group[m]))
                if a != b:
                    up[a] = b
                    found.append((min(int(ids[k]), int(ids[m])), max(int(ids[k]), int(ids[m]))))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _short_pairs(opened: DataFrame) -> DataFrame:
    """All pairs of different components of the lists of up to FEW members."""
    few = opened.filter(F.col("members") <= FEW)
    x, y = few.select("v", F.col("nid").alias("a"), F.col("comp").alias("ca")), few.select("v", F.col("nid").alias("b"), F.col("comp").alias("cb"))
    return x.join(y, "v").filter("a < b AND ca <> cb").select("a", "b").distinct()


def _long_links(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of different components of the longer lists.

    Only pairs with a member outside the list's largest component can link
    components, so those ask, in blocks, and all members answer, in blocks.
    Where a few are outside, a list costs its length and not its square.
    Blocks are cut by the bytes of the sets, so a task holds two blocks at most.
    """
    many = opened.filter(F.col("members") > FEW)
    each = many.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = each.groupBy("v").agg(F.max("k").alias("k")).join(each, ["v", "k"]).groupBy("v").agg(F.min("comp").alias("giant"))
    held = many.join(largest, "v").withColumn("apart", F.col("comp") != F.col("giant"))
    blocks = held.groupBy("v").agg(F.sum(F.when(F.col("apart"), F.col("n") * 8 + ROW_BYTES)).alias("out"))
    held = held.join(blocks, "v").withColumn("mb", F.ceil(F.col("bytes") / BLOCK_BYTES)).withColumn("qb", F.ceil(F.col("out") / BLOCK_BYTES))
    lists = many.groupBy("nid").agg(F.collect_list("v").alias("lists"))  # at most K of them
    h = F.xxhash64("nid", "v")
    up_to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    role = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    answers = F.transform(up_to("qb"), lambda q: role(False, q, F.pmod(h, F.col("mb"))))
    questions = F.transform(up_to("mb"), lambda m: role(True, F.pmod(h, F.col("qb")), m))
    roles = F.when(F.col("apart"), F.concat(answers, questions)).otherwise(answers)
    spread = held.select("v", "nid", "n", "comp", "apart", F.explode(roles).alias("r")).select("v", "nid", "n", "comp", "apart", "r.*")
    full = spread.join(lists.join(sets, "nid"), "nid").select("v", "i", "j", "nid", "n", "comp", "apart", "asks", "set", "lists")
    return full.groupBy("v", "i", "j").applyInArrow(_block_links, "a long, b long")


def _stars(entries: DataFrame, last: bool = False) -> DataFrame:
    """Pairs of each list's smallest node, or its last one, with its members of other components."""
    centre = entries.groupBy("v").agg((F.max if last else F.min)("nid").alias("c"))
    comp = entries.select(F.col("nid").alias("c"), F.col("comp").alias("cc")).distinct()
    near = entries.join(centre.join(comp, "c"), "v").filter("comp <> cc")
    return near.select(F.least("nid", "c").alias("a"), F.greatest("nid", "c").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are linked where their sets of five-word shingles (A-Z lower-cased)
    have a Jaccard similarity of at least 0.75; component_id is the smallest
    doc_id that links reach.

    Documents with one and the same set are one node. A node's sketch is the K
    smallest values of one hash over its set; inverted lists of the rarest
    retained values hold all nodes that a text can be similar to (see
    ``_prefixes``). Lists are worked off by stars: all members against one
    centre, then once more with another one, so that a group of near copies is joined
    in steps linear in its size. What then remains apart within a list is
    compared in blocks. Candidates pass an estimate from the
    union sketch and are confirmed on whole sets. The documents' own sets are
    computed anew at the end, which is cheaper than keeping their sketches.

    A null, empty or blank text has no shingles and is linked with nothing; a
    text of fewer than five words has its word sequence as its one shingle.
    Repeated rows belong together like other copies. A null doc_id is never a
    component's id unless no other is there, and is then kept. An empty table
    gives no rows; other columns are ignored. Very long texts are read whole.
    """
    out = _named(docs, sketches(docs).select("doc_id", "n", "sig"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"))


def _named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n, sig and others) with id, that of the component which each one's set belongs to among ``docs``."""
    spark = docs.sparkSession
    nodes = materialize(
        sketches(docs).filter("n > 0").groupBy("sig", "n", "sketch").agg(F.min("doc_id").alias("first_id")).withColumn("nid", F.monotonically_increasing_id()), "nodes"
    )
    release(spark)
    entries = materialize(_prefixes(nodes), "entries")
    release(spark)
    listed = entries.join(entries.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("v"), "v").select("v", "nid", "n")
    listed = materialize(listed, "listed")
    wanted = nodes.join(listed.select("nid").distinct(), "nid").select("nid", "sig", "first_id")
    linker = _Linker(nodes, materialize(_whole_sets(docs, wanted), "sets"))
    release(spark)
    linker.add(_stars(listed.withColumn("comp", F.col("nid"))))
    linker.add(_stars(linker.open_lists(listed), last=True))
    linker.add(_short_pairs(linker.open_lists(listed)))
    linker.take(materialize(_long_links(linker.open_lists(listed), linker.sets), "links"))
    least = linker.comps.join(nodes.select("nid", "first_id"), "nid").groupBy("comp").agg(F.min("first_id").alias("least"))
    named = nodes.join(linker.comps, "nid", "left").join(least, "comp", "left").select(F.col("sig").alias("node"), F.coalesce("least", "first_id").alias("component"))
    named = materialize(named, "named")
    release(spark)
    shingled = F.when(F.col("n") > 0, F.col("sig"))
    return rows.join(named, shingled == F.col("node"), "left").withColumn("id", F.coalesce("component", "doc_id")).drop("node", "component")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid and the whole shingle set of each wanted node, from the text of one of its documents."""
    texts = text_of(docs)
    some = texts.join(wanted.select(F.col("first_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches):
        for b in batches:
            raw = binary_texts(b.column(0))
            for i in range(0, len(raw), 500):
                sets = shingle_sets(raw[i : i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(map(signature, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "set"])

    sets = some.select("text").mapInArrow(lean(run), "sig binary, set binary").dropDuplicates(["sig"])
    return sets.join(wanted.select("nid", "sig"), "sig").select("nid", "set")


def _signed(docs: DataFrame, at: int) -> DataFrame:
    """``docs`` with n and sig, the size and signature of each row's set; the text is its column ``at``."""
    names = [*docs.columns, "n", "sig"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                sets = shingle_sets(binary_texts(some.column(at)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signature, sets), pa.binary())], names=names)

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("n", LongType()), StructField("sig", BinaryType())]))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each component that with the smallest doc_id.

    Each row is judged by its own doc_id and shingle set, so where several rows
    carry one doc_id, or none, a copy among them does not take the others away.
    Where several rows of a component carry the kept doc_id all of them stay,
    and so do all of a component without any doc_id. Null, empty and blank
    texts stay. Very long texts are read whole; columns may have any names; an
    empty table gives no rows.
    """
    names = docs.columns
    plain = shielded(docs)
    signed = _signed(plain, names.index("text")).withColumn("doc_id", F.col(f"c{names.index('doc_id')}").cast("long"))
    judged = _named(docs.select("doc_id", "text"), signed)
    return judged.filter((F.col("n") == 0) | F.col("doc_id").eqNullSafe(F.col("id"))).select(*plain.columns).toDF(*names)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
