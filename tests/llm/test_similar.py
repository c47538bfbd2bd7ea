"""Fingerprints, near duplicates, repeated passages and the pipeline against brute force."""

import hashlib
import random
import re
import subprocess
import sys
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import ROOT, SF, SF_LARGER
from tidelog.llm import _base, fingerprints, near_dedup, repeats

SIMPLE = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_shingle_hashes():
    texts = ["", " ", "One", "one TWO", "a b c d e", "A  b\tc d\ne f", "É é a b c d", "a b c d e a b c d e"]
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(a) & shingles(b)), (a, b)


def test_fingerprints(spark):
    rows = {r["doc_id"]: r["text"] for r in _base.read(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, SF).collect()}
    ids = sorted(rows, reverse=True)
    assert sorted(got, reverse=True) == ids
    errors = []
    for i, d in enumerate(ids):
        t, n, r = rows[d], rows[ids[(i + 1) % len(ids)]], got[d]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        errors.append(r["near_edited"] - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_documents(_base.read(spark, SF, "documents")).collect()}
    assert all(alone[d] == got[d]["fingerprint"] for d in ids)


def test_fingerprint_edge_cases(spark):
    rows = spark.createDataFrame([(1, None), (None, "x"), (None, "x"), (2, "a b"), (2, "")], SIMPLE)
    out = fingerprints.neighbours(rows, cells=3).collect()
    assert len(out) == 5 and {r["fingerprint"] for r in out if r["n_chars"] == 0} == {""}
    one = fingerprints.neighbours(rows.limit(1)).first()
    assert one["near_next"] == 1.0
    assert fingerprints.neighbours(rows.limit(0)).isEmpty()
    many = spark.createDataFrame([(i, f"w{i % 5} " * 40) for i in range(300)], SIMPLE)
    assert fingerprints.neighbours(many, cells=40).select("doc_id").distinct().count() == 300


@pytest.mark.parametrize("cuts", [[], [5], [-3, 0, 7], [-(2**63), -1, 0, 1, 2**63 - 1], list(range(-50, 51, 5))])
def test_cells_are_found_by_search(spark, cuts):
    keys = sorted({-(2**63), 2**63 - 1, *range(-60, 60), *(c + d for c in cuts for d in (-1, 0, 1) if -(2**63) <= c + d < 2**63)})
    rows = spark.createDataFrame([(k,) for k in keys], "key long").withColumn("cell", fingerprints.cell_of("key", cuts))
    assert {r["key"]: r["cell"] for r in rows.collect()} == {k: int(np.searchsorted(np.array(cuts, dtype=np.int64), np.int64(k), side="right")) for k in keys}


def test_texts_are_dealt_without_python(spark):
    plan = fingerprints.neighbours(_base.read(spark, SF, "documents"), cells=5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def peak_mb(work):
    work()  # what is kept for later calls does not count
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fingerprints_of_many_texts_in_little_memory():
    texts = [" ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(800)) for i in range(900)]  # 4 MB
    assert peak_mb(lambda: fingerprints._pairs(list(enumerate(texts)))) < 40


def test_sets_of_many_texts_in_little_memory():
    texts = [" ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(800)).encode() for i in range(900)]  # 4 MB
    assert peak_mb(lambda: near_dedup.shingle_sets(texts)) < 40


def test_a_task_gives_its_memory_back():
    """In a process of its own: what is freed lies below a block that stays."""
    code = """if True:
        from tidelog.llm import _base
        def resident():
            return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
        kept = []
        def run(batches):
            blocks = [bytearray(100_000) for _ in range(1000)]
            kept.append(blocks[-1])
            yield from batches
        _base.give_back()
        before = resident()
        assert list(_base.lean(run)([1, 2])) == [1, 2]
        assert resident() - before < 20, (before, resident())
    """
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=60)


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def test_near_groups_of_the_table(spark):
    want = brute_components([(r["doc_id"], r["text"]) for r in _base.read(spark, SF_LARGER, "documents").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.op7_near_dedup(spark, SF_LARGER).collect()}
    assert got == want


def test_near_groups_of_edited_families(spark):
    """Families of edited copies around the threshold, long lists, chains and texts of a few words."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        for _ in range(rng.choice([2, 5, 25])):
            new = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else w for w in base]
            rows.append((len(rows), " ".join(new)))
    common = " ".join(rng.choice(vocabulary) for _ in range(90))
    rows += [(len(rows) + i, common + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(30)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b c", "A b  c", "", None, "x", "a b c d"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(spark.createDataFrame(rows, SIMPLE)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("large", [0, 12])
def test_long_lists_in_blocks(spark, large, monkeypatch):
    """Members outside the largest component reach all that they are similar to, by fewer links than there are members in a block."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(30):
        new = list(base)
        for k in rng.sample(range(200), rng.choice([2, 2, 7])):
            new[k] = f"e{rng.random()}"
        texts.append(" ".join(new))
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    comp = lambda i: 0 if i < large else i
    rows = [(int(v), i, len(s), comp(i), 30, 30 * 8 * 200) for i, s in enumerate(sets) for v in s[:12].view(np.int64)]
    opened = spark.createDataFrame(rows, "v long, nid long, n long, comp long, members long, bytes long")
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "nid long, set binary")
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 11_000)
    got = {(r["a"], r["b"]) for r in near_dedup._long_links(opened, table).collect()}
    similar = lambda i, j: near_dedup._similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if set(sets[i][:12]) & set(sets[j][:12]) and comp(i) != comp(j) and similar(i, j)}

    def joined(pairs):
        up = [comp(i) for i in range(30)]
        for i, j in pairs:
            up = [up[i] if x == up[j] else x for x in up]
        return [[k for k in range(30) if up[k] == x] for x in up]

    assert want and got <= want and joined(got) == joined(want)


def test_components_of_a_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101)], "a long, b long")
    got = {r["nid"]: r["comp"] for r in near_dedup.components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100}


def test_near_dedup_rows(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(3, t, 1), (1, t + " x", 2), (2, None, 3), (None, t, 4), (None, "other words here", 5), (7, "", 6), (7, "", 6)], "doc_id long, text string, sig long")
    out = near_dedup.near_dedup(rows)
    assert out.columns == rows.columns
    clash = ["doc_id", "text", "n", "id", "comp.a", "__gone", "node", "c0"]
    odd = near_dedup.near_dedup(rows.select("doc_id", "text", *["sig"] * 6).toDF(*clash))
    assert odd.columns == clash and {r["doc_id"] for r in odd.collect()} == {r["doc_id"] for r in out.collect()} == {1, 2, 7, None}
    assert near_dedup.near_dedup(rows.limit(0)).isEmpty()
    groups = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_groups(rows).collect()}
    assert groups[(3, 46)] == (1, False) and groups[(1, 47)] == (1, True) and groups[(2, 0)] == (2, True) and groups[(None, 46)] == (1, False) and groups[(None, 1)] == (None, True)
    assert near_dedup.near_groups(rows.limit(0)).isEmpty()


def test_near_dedup_keeps_rows_that_share_a_removed_doc_id(spark):
    t = " ".join(f"w{i}" for i in range(50))
    stay = [(1, t + " x", 2), (2, None, 3), (None, "other words here", 5), (7, "", 6), (7, "", 6), (8, "one text that nobody else has", 8), (None, None, 10), (1, "the kept number again on another text", 11)]
    gone = [(3, t, 1), (None, t, 4), (8, t, 7), (None, t + " y", 9)]
    out = near_dedup.near_dedup(spark.createDataFrame(stay + gone, "doc_id long, text string, sig long"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(stay, key=repr)


# --- repeated passages


def brute_repeats(rows, length=50):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = {}
    for d, t in rows:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d] = (len(t), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(t, mark, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform(seed):
    rng = random.Random(seed)
    for _ in range(15):
        length = rng.choice([3, 5, 8])
        some = [bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(2, 12))]
        docs = np.array([rng.randint(0, 5) for _ in some])
        for k, got in enumerate(repeats.repeated(some, docs, length)):
            x = some[k]
            assert list(got) == [i for i in range(len(x) - length + 1) if any(docs[q] < docs[k] and x[i : i + length] in some[q] for q in range(len(some)))]


def check_repeats(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digest(spark.createDataFrame(rows, SIMPLE)).collect()}
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows])


def test_repeats_of_the_table(spark):
    check_repeats(spark, [(r["doc_id"], r["text"]) for r in _base.read(spark, SF, "documents").collect()])


def test_repeats_at_borders(spark):
    rng = random.Random(6)
    abc = "abcdefghij é"
    make = lambda n: "".join(rng.choice(abc) for _ in range(n))
    p49, p50, p51, long = make(49), make(50), make(51), make(700)
    rows = [(1, p49 + p50 + p51), (2, make(30) + p50), (3, p49 + "#" + p51 + p51), (4, p49), (5, "to " * 400), (6, "to " * 90), (7, long), (8, long[100:400] + make(9) + long[350:]), (9, None), (10, ""), (11, long), (12, "aaaa" * 50), (13, "aaaa" * 300), (14, p50)]
    check_repeats(spark, rows)


def test_random_edits(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef ") for _ in range(600)) for _ in range(4)]
    rows = []
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        a = rng.randrange(200)
        rows.append((i, "".join(t)[a : a + rng.randint(20, 500)]))
    check_repeats(spark, rows)


def test_large_groups_are_halved(spark, monkeypatch):
    """Groups above the transform's size give the same result, down to single windows; and so do many small buckets."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(120)
    rows = [(i, make(rng.randint(0, 40)) + passage[rng.choice([0, 0, 20, 55]) : rng.choice([120, 120, 90, 71])] + make(rng.randint(0, 40))) for i in range(60)]
    rows += [(60 + i, passage[:80] + rng.choice("xyz") + passage[81:]) for i in range(10)]
    for chunk in (200, 900, 4000):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        data = [t.encode() for _, t in rows]
        _, starts, doc, h, at, first, last, _ = repeats.anchors(data)
        joined = np.frombuffer(b"".join(data), np.uint8)
        size, anchor = last - first + 50, at - first
        removed = [bytearray(len(t)) for t in data]
        for row, lo, hi in repeats._windows(joined, first, size, anchor, np.arange(len(h)), h, doc, 50):
            begin = int(first[row] - starts[doc[row]])
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                removed[doc[row]][begin + a : begin + b + 50] = b"\1" * (b - a + 50)
        want = brute_repeats([(d, t.encode()) for d, t in rows])
        assert [sum(r) for r in removed] == [want[d][1] for d, _ in rows]
    monkeypatch.setattr(repeats, "CHUNK", 600)
    monkeypatch.setattr(repeats, "BUCKET", 500)
    check_repeats(spark, rows)


def test_equal_hashes_do_not_make_equal_snippets():
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    fresh = np.array([True, False, False, False])
    repeats._tell_apart(fresh, np.array([0, 2, 1, 3]), data, np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2]), np.array([1, 1, 1, 1]))
    assert fresh.tolist() == [True, False, True, True]


def test_anchor_runs_of_long_texts():
    """Minima are the same however a long run of hashes is cut."""
    h = np.random.default_rng(2).integers(0, 2**40, 5000, dtype=np.uint64) << np.uint64(24)
    got = repeats._leftmost_least(h, 31)
    assert got.tolist() == [i + int(np.argmin(h[i : i + 31])) for i in range(5000 - 30)]


def test_remove_repeats_rows(spark):
    passage = "é" * 40 + "A passage of more than fifty bytes that both of them have."
    rows = spark.createDataFrame([(1, "x " + passage, "p"), (2, passage + " y", "q"), (2, "z" + passage, "r"), (3, None, "s"), (None, passage, "t")], "doc_id long, text string, spans string")
    out = repeats.remove_repeats(rows)
    assert out.columns == [*rows.columns, "removed_spans"]
    got = {r["spans"]: r["text"] for r in out.collect()}
    assert got["p"] == "x " + passage and got["q"] == " y" and got["r"] == "z" and got["s"] is None and got["t"] == ""
    assert repeats.remove_repeats(rows.limit(0)).isEmpty()
    clash = ["doc_id", "text", "id", "tie", "removed_spans", "a.b", "__id", "c0"]
    odd = repeats.remove_repeats(rows.select("doc_id", "text", *["spans"] * 6).toDF(*clash))
    assert odd.columns == [*clash, "removed_spans_"] and sorted(tuple(r)[:-1] for r in odd.select("id", "c0", "tie", "text", "removed_spans_").collect() if r["text"] is not None) == sorted((k, k, k, t) for k, t in got.items() if t is not None)


def test_repeats_are_told_before_the_last_job(spark):
    """The steps have run and given their memory back when texts are cut; one Python step is left."""
    passage = "A passage of more than fifty bytes that two of them have."
    out = repeats.digest(spark.createDataFrame([(1, passage), (2, "x" + passage)], SIMPLE))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


# --- pipeline


def _collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_stages_begin_with_little_memory(spark):
    """Executors collect their heaps as well as the driver before each stage; here all are one process."""
    import corpus_pipeline

    empty = spark.createDataFrame([], _base.read(spark, SF, "documents").schema)
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = _collections(spark)
        stage(spark, empty, SF)
        assert _collections(spark) >= before + 2, name


def test_pipeline_stages(spark):
    import corpus_pipeline

    source = _base.read(spark, SF, "documents")
    planted = spark.createDataFrame([(90_001, "123 456 !!", None, "s", 10), (90_002, None, None, "s", 0)], source.schema)
    docs, kept = source.unionByName(planted), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, _base.materialize(stage(spark, docs, SF), name)
        assert docs.columns == source.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert {d for d, _ in rows} - set(kept[name]) == {90_001, 90_002}
        elif name == "exact_dedup":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(t, d)
            assert set(kept[name]) == set(first.values())
        elif name == "near_dedup":
            assert set(kept[name]) == {d for d, (_, c) in brute_components(rows).items() if d == c}
        else:
            want = brute_repeats([(d, (t or "").encode()) for d, t in rows])
            clean = [d for d in want if want[d][1] == 0]
            assert set(kept[name]) == set(want) and all(kept[name][d] == dict(rows)[d] for d in clean)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_has_its_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "repeats", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_words_cut_at_ascii_white_space_only(spark):
    rows = spark.createDataFrame([(1, "a\u00a0b c"), (2, "a b c")], SIMPLE)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(rows).collect()}
    assert got == {1: 1, 2: 2}
