"""Removal of repeated passages: common substrings from a Burrows-Wheeler transform.

The corpus is cut into small independent problems by content: among the grams
of any LENGTH bytes the one with the smallest hash, the anchor, depends on
those bytes alone, so two equal windows lie around equal anchors. Anchors that
occur in one document only are dropped; around the others short snippets are
collected by anchor. Of snippets with the same bytes the smallest document's
is kept; those that differ are solved by breadth-first backward extension of
intervals on their Burrows-Wheeler transform. Buckets of anchors are as many
as the input's bytes ask for, and a worker holds one of them at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm._base import BYTE_CODE, binary_texts, free_name, frugal, labels, lean, materialize, mix, powers, read, release, shielded, slices

LENGTH = 50
GRAM = 20
CHUNK = 1 << 19  # bytes of snippets in one transform
SEGMENT = 1 << 17  # bytes of text whose windows are looked at together
PARTITION = 16 << 20  # bytes of text for each partition, where the session has fewer partitions
BUCKET = 3 << 20  # bytes of text for each bucket; a partition takes its buckets one after the other
LATE = 2**63 - 1  # the place of a null doc_id: after all others

BLOB = "bucket int, kind int, doc_id long, tie long, blob binary, sub int"


# --- Burrows-Wheeler transform and its intervals


def suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of snippets joined by zero bytes, each ended by one.

    Ends are ordered by place and lie below all bytes, so no suffix equals
    another; ranks of 8, 16, 32 ... bytes are doubled until all differ.
    """
    n = len(text)
    end = np.flatnonzero(text == 0)
    snippet = np.searchsorted(end, np.arange(n))
    left = end[snippet] - np.arange(n)  # bytes before the end
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, dtype=np.uint64)))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(i < left, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    width = 8
    while int(rank.max(initial=0)) < n - 1:
        nxt = np.where(left < width, snippet, len(end) + rank[np.minimum(np.arange(n) + width, n - 1)])
        pair = rank * (n + len(end) + 1) + nxt
        order = np.argsort(pair, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        width *= 2
    return order


class Transform:
    """The transform of a text as a wavelet matrix, which splits intervals by the byte before them."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.n = len(text)
        before = text[order - 1]  # the byte before the whole text is its last, an end
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=256))))
        self.planes = []
        row = before
        for bit in range(7, -1, -1):
            one = (row >> bit) & 1
            rank = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(one, out=rank[1:])
            zeros = self.n - int(rank[-1])
            self.planes.append((rank, zeros))
            row = np.concatenate((row[one == 0], row[one == 1]))
        self.at = np.full(256, -1, dtype=np.int64)
        change = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if self.n else np.empty(0, dtype=np.int64)
        self.at[row[change]] = change

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All non-empty intervals of a byte followed by the given intervals' prefixes, ends left out."""
        code = np.zeros(len(lo), dtype=np.int64)
        for rank, zeros in self.planes:
            a, b = rank[lo], rank[hi]
            lo0, hi0, lo1, hi1 = lo - a, hi - b, zeros + a, zeros + b
            z, o = lo0 < hi0, lo1 < hi1
            code = np.concatenate((code[z] << 1, (code[o] << 1) | 1))
            lo, hi = np.concatenate((lo0[z], lo1[o])), np.concatenate((hi0[z], hi1[o]))
        real = code > 0
        code, lo, hi = code[real], lo[real], hi[real]
        begin = self.first[code] + lo - self.at[code]
        return begin, begin + hi - lo


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order whether it shares fewer than ``length`` bytes with the one before it.

    Intervals of one-byte prefixes, two-byte prefixes and so on are reached
    breadth-first by extending backwards; the border after an interval of
    prefixes of l + 1 bytes that no shorter one reached has l bytes in common.
    Borders that are not reached below ``length`` lie within a common prefix.
    """
    t = Transform(text, order)
    ends = int((text == 0).sum())
    known = np.zeros(t.n + 1, dtype=bool)
    known[[0, t.n]] = True
    known[1 : ends + 1] = True  # ends differ from each other
    lo, hi = np.array([0]), np.array([t.n])
    for level in range(length):
        lo, hi = t.extend(lo, hi)
        new = ~known[hi]
        # intervals that end at a known border have been reached by a shorter prefix and need no extension
        lo, hi = lo[new], hi[new]
        known[hi] = True
        if level == 0:  # prefixes that are an end and what stands before it
            lo, hi = np.concatenate((lo, np.arange(ends))), np.concatenate((hi, np.arange(1, ends + 1)))
        if not len(lo):
            break
    return known[:-1]


def _runs(x: np.ndarray):
    """(begin, end) of the runs of equal values."""
    if len(x):
        cut = [*np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist(), len(x)]
        yield from zip(cut, cut[1:], strict=False)


def repeated(snippets: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each snippet the starts of its ``length``-byte windows that also lie in a snippet of a smaller document."""
    out = [np.empty(0, dtype=np.int64)] * len(snippets)
    if len(snippets) < 2:
        return out
    raw = np.frombuffer(b"\xff".join(snippets) + b"\xff", dtype=np.uint8)  # FF is no byte of UTF-8
    text = raw + np.uint8(1)  # so ends are 0 and bytes lie above
    order = suffixes(text)
    border = common_prefixes(text, order, length)
    end = np.flatnonzero(text == 0)
    owner = np.searchsorted(end, order)
    group = np.flatnonzero(border)
    least = np.minimum.reduceat(docs[owner], group)
    size = np.diff(np.concatenate((group, [len(order)])))
    low = np.repeat(least, size) < docs[owner]
    low &= end[owner] - order >= length
    begin = np.concatenate(([0], end[:-1] + 1))
    hit, who = order[low], owner[low]
    by = np.lexsort((hit, who))
    hit, who = hit[by], who[by]
    for a, b in _runs(who):
        out[who[a]] = hit[a:b] - begin[who[a]]
    return out


# --- anchors


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Anchors of a run of texts: (doc, 48 bits of hash, place, first window, last window, hash of all their bytes).

    Places count from the start of the joined texts, which is returned with
    each text's own start. A window's anchor is its leftmost gram of smallest
    hash; windows in a row with one anchor are one entry. The texts are worked
    through in segments, as each byte needs some hundred bytes meanwhile.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    parts = [x for at in range(0, max(1, len(data) - length + 1), SEGMENT) if (x := _segment(data[at : at + SEGMENT + length - 1], at, starts, length, gram)) is not None]
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return data, starts, none, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    return data, starts, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment(data: np.ndarray, at: int, starts: np.ndarray, length: int, gram: int):
    """The anchors of the windows that lie in one segment of the joined texts, which begins at ``at``."""
    if len(data) < length:
        return None
    inverse = powers(len(data), inverse=True)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    least = _leftmost_least(h, length - gram + 1)
    window = np.arange(len(least), dtype=np.int64)
    a, b = np.searchsorted(starts, [at, at + len(window) - 1], side="right") - 1
    cut = np.minimum(np.maximum(starts[a : b + 2] - at, 0), len(window))
    doc = np.repeat(np.arange(a, b + 1), np.diff(cut))
    inside = np.ones(len(window), dtype=bool)
    for e in (starts[a + 1 : b + 2] - at).tolist():  # windows that begin in a text's last bytes would leave it
        inside[max(0, e - length + 1) : max(0, e)] = False
    if not inside.all():
        window, least, doc = window[inside], least[inside], doc[inside]
    if not len(window):
        return None
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
    first, last = window[new], window[np.concatenate((new[1:], [len(window)])) - 1]
    place = least[new]
    whole = mix((sums[last + length] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return doc[new], h[place] >> np.uint64(16), place + at, first + at, last + at, whole


def _leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the index of its smallest, the leftmost where the upper 40 bits tie."""
    out, piece = [], (1 << 24) - span
    for at in range(0, len(h) - span + 1, piece):
        some = h[at : at + piece + span - 1]
        low = ((some >> np.uint64(24)) << np.uint64(24)) | np.arange(len(some), dtype=np.uint64)
        have = 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        out.append((low & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def _pack(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Arrays of one length with how many low bytes of each value to keep; bytes of one place lie together, for compression."""
    import zstandard

    parts = [len(arrays[0][0]).to_bytes(4, "little")]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T).tobytes() for a, width in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *types: tuple[str, int]) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t, width in types:
        planes = np.zeros((n, np.dtype(t).itemsize), dtype=np.uint8)
        planes[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(planes.reshape(-1).view(t))
        at += n * width
    return out


class _Deal:
    """How ``size`` buckets are dealt to partitions: bucket b goes to partition b % n, as its part b // n."""

    def __init__(self, labels: list[int], size: int):
        self.labels, self.size = labels, max(len(labels), size)

    def place(self, bucket: int) -> tuple[int, int]:
        return self.labels[bucket % len(self.labels)], bucket // len(self.labels)


class _Rows:
    """Collects rows of BLOB."""

    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("blob", pa.binary()), ("sub", pa.int32())])

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, place: tuple[int, int], kind: int, doc: int, tie: int, blob: bytes) -> None:
        self.rows.append((place[0], kind, doc, tie, blob, place[1]))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys (the first counts most), and where runs of equal keys begin in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _by_doc(*keys: np.ndarray):
    order, new = _groups(*keys)
    for a, b in zip(new, [*new[1:], len(order)] if len(new) else [], strict=True):
        yield order[a:b]


def _to_documents(rows: _Rows, deal: _Deal, kind: int, ids: np.ndarray, *values: tuple[np.ndarray, int]) -> None:
    """Add values of documents, one blob for each bucket of documents."""
    bucket = (mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(deal.size)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    for a, z in _runs(bucket[by]):
        k = by[a:z]
        rows.add(deal.place(int(bucket[k[0]])), kind, 0, 0, _pack((ids[k], 8), *((v[k], w) for v, w in values)))


def _dealt(blobs: DataFrame, deal: _Deal) -> DataFrame:
    """Blobs in the partitions of their buckets, one bucket after the other."""
    return blobs.repartition(len(deal.labels), "bucket").sortWithinPartitions("sub")


def _one_by_one(batches):
    """The batches of each bucket of a partition, cut where one ends and the next begins."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        for i, j in _runs(b.column(5).to_numpy()):
            sub = b.column(5)[i].as_py()
            if held and sub != now:
                yield held
                held = []
            now = sub
            held.append(b.slice(i, j - i))
    if held:
        yield held


def _blobs(held: list[pa.RecordBatch], kind: int):
    for b in held:
        yield from b.column(4).filter(pa.array(b.column(1).to_numpy() == kind)).to_pylist()


def _of_documents(held: list[pa.RecordBatch], kind: int, *types: tuple[str, int]) -> list[np.ndarray] | None:
    """The values of all blobs of one kind in a bucket, or none."""
    parts = [_unpack(blob, ("i8", 8), *types) for blob in _blobs(held, kind)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


# --- step 1: which anchors occur in several documents

SHARED, ALONE, SEEN, SPAN = 0, 1, 2, 3


def _anchor_blobs(deal: _Deal, length: int):
    """Documents to blobs of anchor hashes by bucket. One row a hash and run of documents goes out, so that an
    anchor in a third of all documents sends no more than any other; what is shared within the run is told at once."""

    def run(batches):
        for b in batches:
            docs, texts = b.column("id").to_numpy(), binary_texts(b.column("text"))
            for i, j in slices(texts, 8 << 20):
                rows = _Rows()
                _, _, doc, h, *_ = anchors(texts[i:j], length)
                order, new = _groups(h, doc)
                h, ids = h[order][new], docs[i:j][doc[order][new]]  # once for each hash and text
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, dtype=np.int64)
                count = np.diff(np.concatenate((start, [len(h)])))
                shared = np.flatnonzero(np.repeat(count > 1, count))
                _to_documents(rows, deal, SHARED, ids[shared], (h[shared], 6))
                bucket = (h[start] % np.uint64(deal.size)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                for a, z in _runs(bucket[by]):
                    k = start[by[a:z]]
                    rows.add(deal.place(int(bucket[by[a]])), ALONE, 0, 0, _pack((h[k], 6), (ids[k], 8), ((count[by[a:z]] > 1).astype(np.uint8), 1)))
                yield rows.batch()

    return run


def _shared_anchors(deal: _Deal):
    """Blobs of buckets of anchors to those that documents share with another one (kind SHARED), by bucket of documents."""

    def run(batches):
        for held in _one_by_one(batches):
            for b in held:
                yield b.filter(pa.array(b.column(1).to_numpy() == SHARED))
            parts = [_unpack(blob, ("u8", 6), ("i8", 8), ("u1", 1)) for blob in _blobs(held, ALONE)]
            if not parts:
                continue
            h, ids, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, new = _groups(h)
            count = np.diff(np.concatenate((new, [len(order)])))
            take = order[np.repeat(count > 1, count)]  # a hash comes once from each run of documents
            take = take[seen[take] == 0]  # the others were told in step one
            rows = _Rows()
            _to_documents(rows, deal, SHARED, ids[take], (h[take], 6))
            yield rows.batch()

    return run


def _flags(batches):
    """One row for each document that shares anchors, with their hashes."""
    for held in _one_by_one(batches):
        got = _of_documents(held, SHARED, ("u8", 6))
        rows = _Rows()
        if got is not None:
            ids, h = got
            for k in _by_doc(ids):
                rows.add((0, 0), SHARED, int(ids[k[0]]), 0, h[k].tobytes())
        yield rows.batch()


# --- step 2: snippets around shared anchors


def _snippet_blobs(deal: _Deal, length: int):
    """Documents with their shared anchors to blobs of snippets by bucket; equal snippets of a run go out once,
    with the smallest document, and the others' repeats are told at once."""

    def run(batches):
        import zstandard

        for b in batches:
            docs, ties = b.column("id").to_numpy(), b.column("tie").to_numpy()
            texts, flags = binary_texts(b.column("text")), b.column("flags").to_pylist()
            for i, j in slices(texts, 8 << 20):
                rows = _Rows()
                data, starts, doc, h, at, first, last, whole = anchors(texts[i:j], length)
                told = [np.frombuffer(b"".join(f), np.uint64) for f in flags[i:j]]
                mark = np.concatenate([mix(t ^ np.uint64(k * 0x9E3779B1 + 1)) for k, t in enumerate(told)]) if told else np.empty(0, np.uint64)
                keep = np.isin(mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(1))), mark)
                doc, h, at, first, last, whole = (x[keep] for x in (doc, h, at, first, last, whole))
                ids, tie = docs[i:j][doc], ties[i:j][doc]
                base = starts[doc]
                order, _ = _groups(h, whole, ids)
                # within equal snippets: rows of the smallest document lead
                s_h, s_w, s_id = h[order], whole[order], ids[order]
                fresh = np.concatenate(([True], (s_h[1:] != s_h[:-1]) | (s_w[1:] != s_w[:-1]))) if len(order) else np.empty(0, dtype=bool)
                _tell_apart(fresh, order, data, first, last - first + length, at - first)
                lead = np.flatnonzero(fresh)
                least = np.repeat(s_id[lead], np.diff(np.concatenate((lead, [len(order)]))))
                later = order[s_id > least]
                _to_documents(rows, deal, SPAN, ids[later], (tie[later], 4), ((first - base)[later], 4), ((last - base)[later] + length, 4))
                out = order[s_id == least]  # every place of the smallest document
                bucket = (h[out] % np.uint64(deal.size)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                for a, z in _runs(bucket[by]):
                    r = out[by[a:z]]
                    size = (last[r] - first[r] + length).astype(np.int64)
                    pos = np.repeat(first[r], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    head = _pack((h[r], 6), (ids[r], 8), (tie[r], 4), (first[r] - base[r], 4), (size, 2), (at[r] - first[r], 1))
                    raw = zstandard.ZstdCompressor(level=3).compress(data[pos].tobytes())
                    rows.add(deal.place(int(bucket[by[a]])), SEEN, 0, 0, len(head).to_bytes(4, "little") + head + raw)
                yield rows.batch()

    return run


def _tell_apart(fresh: np.ndarray, order: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> None:
    """Set ``fresh`` where a snippet has the hashes but not the bytes of the one before it in ``order``.

    Snippets are ``size`` bytes of ``data`` from ``at``, with their anchor ``anchor`` bytes in.
    """
    same = np.flatnonzero(~fresh)
    for k in range(0, len(same), 20_000):
        some = same[k : k + 20_000]
        x, y = order[some - 1], order[some]
        n = np.where((size[x] == size[y]) & (anchor[x] == anchor[y]), size[x], 0)
        edge = np.concatenate(([0], np.cumsum(n)))
        step = np.arange(edge[-1]) - np.repeat(edge[:-1], n)
        wrong = np.concatenate(([0], np.cumsum(data[np.repeat(at[x], n) + step] != data[np.repeat(at[y], n) + step])))
        fresh[some[(n == 0) | (wrong[edge[1:]] != wrong[edge[:-1]])]] = True


def _solve(deal: _Deal, length: int):
    """Blobs of buckets of anchors to removed ranges (kind SPAN), by bucket of documents."""

    def run(batches):
        for held in _one_by_one(batches):
            for b in held:
                yield b.filter(pa.array(b.column(1).to_numpy() == SPAN))
            blobs = list(_blobs(held, SEEN))
            if blobs:
                yield _solved(blobs, deal, length)

    return run


def _solved(blobs: list[bytes], deal: _Deal, length: int) -> pa.RecordBatch:
    """What is to be removed by the snippets of one bucket."""
    import zstandard

    parts, raws = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        parts.append(_unpack(blob[4 : 4 + n], ("u8", 6), ("i8", 8), ("i8", 4), ("i8", 4), ("i8", 2), ("i8", 1)))
        raws.append(zstandard.ZstdDecompressor().decompress(blob[4 + n :]))
    h, ids, tie, first, size, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    parts.clear()
    raws.clear()
    at = np.concatenate(([0], np.cumsum(size)))[:-1]
    whole = _whole(data, at, size, anchor)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (row, first window, last window) within the snippet
    # equal snippets: whatever is not of the smallest document is repeated throughout
    order, _ = _groups(h, whole, ids)
    variant = np.ones(len(order), dtype=bool)
    variant[1:] = (h[order][1:] != h[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    _tell_apart(variant, order, data, at, size, anchor)
    lead = np.flatnonzero(variant)
    count = np.diff(np.concatenate((lead, [len(order)])))
    least = np.repeat(ids[order][lead], count)
    later = order[ids[order] > least]
    found.append((later, np.zeros(len(later), dtype=np.int64), size[later] - length))
    # one snippet of each variant, where its anchor has several
    rep = order[lead]
    hs = h[rep]
    many = np.zeros(len(rep), dtype=bool)
    many[1:] |= hs[1:] == hs[:-1]
    many[:-1] |= hs[1:] == hs[:-1]
    group = np.flatnonzero(many)
    alive = group[_plausible(data, at, size, anchor, hs[group], rep[group], length)]
    place = {int(rep[v]): int(v) for v in alive}
    for row, lo, hi in _windows(data, at, size, anchor, rep[alive], hs[alive], ids, length):
        v = place[row]
        own = order[lead[v] : lead[v] + count[v]]
        own = own[ids[own] == ids[row]]
        found.append((np.repeat(own, len(lo)), np.tile(lo, len(own)), np.tile(hi, len(own))))
    row, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = _Rows()
    _to_documents(rows, deal, SPAN, ids[row], (tie[row], 4), (first[row] + lo, 4), (first[row] + hi + length, 4))
    return rows.batch()


def _windows(data, at, size, anchor, rows, group, ids, length):
    """(row, first, last windows) of each snippet that repeat a window of another snippet of its group with a smaller id.

    A group of up to CHUNK bytes is solved by one transform. The windows of a
    larger one are halved by where the anchor lies in them: windows of one half
    have bytes around the anchor in common, by which the group falls into
    smaller ones of shorter snippets, until these are small enough or have but
    one window each. Snippets that become equal leave but the smallest id's.
    """
    todo = [(rows, group, 0, length - GRAM)]
    while todo:
        rows, group, least, most = todo.pop()
        lo, hi = np.maximum(0, anchor[rows] - most), np.minimum(size[rows] - length, anchor[rows] - least)
        some = lo <= hi
        rows, group, lo, hi = rows[some], group[some], lo[some], hi[some]
        by = np.lexsort((ids[rows], group))
        rows, group, lo, hi = rows[by], group[by], lo[by], hi[by]
        pieces = [data[a:b].tobytes() for a, b in zip((at[rows] + lo).tolist(), (at[rows] + hi + length).tolist(), strict=True)]
        if (least, most) != (0, length - GRAM):
            first: dict[tuple, int] = {}
            stay = np.ones(len(rows), dtype=bool)
            for k, key in enumerate(zip(group.tolist(), (anchor[rows] - lo).tolist(), pieces, strict=True)):
                if ids[first.setdefault(key, rows[k])] < ids[rows[k]]:
                    stay[k] = False
                    yield int(rows[k]), lo[k : k + 1], hi[k : k + 1]
            pieces = [p for p, s in zip(pieces, stay, strict=True) if s]
            rows, group, lo, hi = rows[stay], group[stay], lo[stay], hi[stay]
        if least == most or not len(rows):
            continue
        length_of = np.array([len(p) for p in pieces])
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        members = np.diff(np.concatenate((begin, [len(group)])))
        large = np.repeat((np.add.reduceat(length_of, begin) > CHUNK) & (members > 1), members)
        small = np.flatnonzero(~large)
        for part in _chunks(group[small], length_of[small]):
            k = small[part]
            for x, where in zip(k, repeated([pieces[i] for i in k], ids[rows[k]], length), strict=True):
                if len(where):
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(where) > 1)))
                    yield int(rows[x]), lo[x] + where[cut], lo[x] + where[np.concatenate((cut[1:], [len(where)])) - 1]
        rows, group = rows[large], group[large]
        del pieces
        mid = (least + most) // 2
        for a, b in ((least, mid), (mid + 1, most)):
            # windows that begin a to b bytes before the anchor share the bytes from a before it to the end of the first of them
            fits = np.maximum(0, anchor[rows] - b) <= np.minimum(size[rows] - length, anchor[rows] - a)
            r, g = rows[fits], group[fits]
            code = _core(data, at[r] + anchor[r] - a, length - b + a)
            order, new = _groups(g, code)
            n = np.diff(np.concatenate((new, [len(order)])))
            keep = np.repeat(n > 1, n)
            todo.append((r[order][keep], np.repeat(np.arange(len(n)), n)[keep], a, b))


def _core(data: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` bytes from each of ``begin``."""
    code, weight, reach = np.empty(len(begin), dtype=np.uint64), powers(n), np.arange(n)
    for k in range(0, len(begin), 50_000):
        code[k : k + 50_000] = (BYTE_CODE[data[begin[k : k + 50_000, None] + reach]] * weight).sum(axis=1, dtype=np.uint64)
    return code


def _spans(batches):
    """One row for each document with repeats: its maximal removed ranges (begin, end)."""
    for held in _one_by_one(batches):
        got = _of_documents(held, SPAN, ("i8", 4), ("i8", 4), ("i8", 4))
        rows = _Rows()
        if got is not None:
            ids, tie, begin, end = got
            for k in _by_doc(ids, tie):
                rows.add((0, 0), SPAN, int(ids[k[0]]), int(tie[k[0]]), _merge(np.stack((begin[k], end[k]), axis=1)).astype("<u4").tobytes())
        yield rows.batch()


def _whole(data, at, size, anchor):
    """A hash of each snippet's bytes and of where its anchor lies, block by block."""
    out = np.empty(len(size), dtype=np.uint64)
    for i in range(0, len(size), 4096):
        n, lo = size[i : i + 4096], at[i : i + 4096] - at[i]
        some = data[at[i] : at[i] + lo[-1] + n[-1]]
        sums = np.zeros(len(some) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[some] * powers(len(some)), out=sums[1:])
        extra = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + anchor[i : i + 4096].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[i : i + 4096] = mix((sums[lo + n] - sums[lo]) * powers(len(some), inverse=True)[lo] + extra)
    return out


def _plausible(data, at, size, anchor, h, row, length):
    """Which snippets can share a window with another one of their anchor.

    A window reaches at least half of what it has besides the gram to the left
    or to the right of it, so those bytes must agree with another snippet's.
    """
    if not len(row):
        return np.empty(0, dtype=np.int64)
    half = (length - GRAM + 1) // 2
    centre = at[row] + anchor[row]
    alive = np.zeros(len(row), dtype=bool)
    for lo in (centre - half, centre):
        ok = np.flatnonzero((lo >= at[row]) & (lo + GRAM + half <= at[row] + size[row]))
        order, new = _groups(h[ok], _core(data, lo[ok], GRAM + half))
        count = np.diff(np.concatenate((new, [len(order)])))
        alive[ok[order[np.repeat(count > 1, count)]]] = True
    return np.flatnonzero(alive)


def _chunks(h: np.ndarray, size: np.ndarray):
    """Slices of about CHUNK bytes that keep the rows of one anchor together."""
    total = np.cumsum(size)
    border = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else []
    begin, done = 0, 0
    for k in border:
        if k > begin and total[k - 1] - done > CHUNK:
            yield slice(begin, k)
            begin, done = k, total[k - 1]
    if begin < len(h):
        yield slice(begin, len(h))


# --- step 3: what remains


def _merge(x: np.ndarray) -> np.ndarray:
    """Maximal runs of ranges (begin, end), ascending."""
    if not len(x):
        return np.empty((0, 2), dtype=np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > reach[:-1])))
    return np.stack((x[new, 0], reach[np.concatenate((new[1:], [len(x)])) - 1]), axis=1)


def keyed(plain: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``plain`` with id, its rows' place in the order of doc_id, tie, a hash that tells apart rows of one doc_id, and text."""
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(LATE))
    return plain.withColumnRenamed(text, "text").select("*", place.alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 32) - 1)).alias("tie"))


def repeat_spans(base: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, spans: for each doc_id with repeats (tie, blob of (begin, end) byte ranges to remove).

    ``base`` is from ``keyed``. Each step's result is written, its shuffle
    files are dropped and memory is given back before the next. The one wide
    exchange of the steps is that of the texts with shared anchors; the rest
    are compressed blobs of hashes and of snippets.
    """
    spark = frugal(base.sparkSession)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    deal = _Deal(labels(spark, parts), -(-size // BUCKET))
    told = _dealt(base.select("id", "text").mapInArrow(lean(_anchor_blobs(deal, length)), BLOB), deal).mapInArrow(lean(_shared_anchors(deal)), BLOB)
    told = _dealt(told, deal).mapInArrow(lean(_flags), BLOB)
    flags = materialize(told.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("blob").alias("flags")), "flags")
    release(spark)
    marked = base.select("id", "tie", "text").join(flags, "id")
    solved = _dealt(marked.mapInArrow(lean(_snippet_blobs(deal, length)), BLOB), deal).mapInArrow(lean(_solve(deal, length)), BLOB)
    solved = _dealt(solved, deal).mapInArrow(lean(_spans), BLOB)
    spans = materialize(solved.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("tie", "blob")).alias("spans")), "spans")
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents with their columns, ``text`` without its repeated passages, and ``removed_spans``.

    Every byte is removed that lies in a window of ``length`` bytes which also
    starts in a document with a smaller doc_id, judged on the input as it is.
    Of a character that a cut splits nothing stays. removed_spans are the
    maximal byte ranges (begin, end); it is the last column, and has underscores
    after its name where a column is called so already. Columns may have any
    names.

    A null text stays null; a text below ``length`` bytes stays whole. Rows
    with one doc_id, repeated rows too, do not remove from each other. A null
    doc_id comes after all others. Very long texts are read whole; an empty
    table gives no rows.
    """
    names = docs.columns
    at, plain = names.index("text"), shielded(docs)
    base = keyed(plain, f"c{names.index('doc_id')}", f"c{at}")
    columns = ["text" if i == at else c for i, c in enumerate(plain.columns)]
    joined = base.join(repeat_spans(base, length), "id", "left").select(*columns, "tie", "spans")

    def run(batches):
        for b in batches:
            texts, blobs = b.column(at).cast(pa.large_binary()).to_pylist(), _own(b)
            out, gone = [], []
            for t, cut in zip(texts, blobs, strict=True):
                gone.append([{"begin": int(x), "end": int(y)} for x, y in cut])
                out.append(None if t is None else _keep(t, cut).decode("utf-8", "ignore"))
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=[*columns, "removed"])

    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    out = joined.mapInArrow(lean(run), T.StructType([*joined.schema.fields[: len(names)], T.StructField("removed", span)]))
    return out.toDF(*names, free_name("removed_spans", names))


def _own(batch) -> list[np.ndarray]:
    """Each row's removed ranges: of those of its doc_id the ones that carry its text's hash."""
    return [_merge(np.frombuffer(b"".join(x["blob"] for x in found or [] if x["tie"] == tie), "<u4").reshape(-1, 2)) for tie, found in zip(batch.column("tie").to_pylist(), batch.column("spans").to_pylist(), strict=True)]


def _keep(text: bytes, cut: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, b in cut.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes are removed as ``remove_repeats`` says. A null text counts as empty;
    null doc_ids come after all others; each repeated row has its own row and
    removes nothing from its like. Very long texts are read whole, other columns
    are ignored whatever their names, and an empty table gives no rows.
    """
    base = keyed(docs.select(F.col("doc_id").cast("long").alias("c0"), F.col("text").alias("c1")), "c0", "c1")
    joined = base.join(repeat_spans(base, length), "id", "left").select("c0", "text", "tie", "spans")

    def run(batches):
        for b in batches:
            texts = binary_texts(b.column(1))
            cuts = _own(b)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([int((c[:, 1] - c[:, 0]).sum()) for c in cuts], pa.int64()),
                    pa.array(map(len, cuts), pa.int64()), pa.array([hashlib.sha256(_keep(t, c)).hexdigest() for t, c in zip(texts, cuts, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
