"""SentencePiece encoding and decoding with forward states shared along a trie."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import read, text_of

MARK = "▁"
MAX_UNITS = 200_000  # of a generation; two are kept, so frequent words stay and memory is bounded
MAX_FITS = 1_000_000
SHORT = 40  # characters up to which merging scans a list
NEVER = float("-inf")
ONE = (1,)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def marked_words(pieces) -> re.Pattern:
    """A pattern of words: marks, then characters that the pieces join with one another.

    Where no piece has two characters side by side, none spans them, so a text
    may be cut there and both parts have the ids that they have together. What
    stands alone in all pieces (often digits and line ends) is a word by itself.
    """
    group: dict[str, set] = {}
    for p in pieces:
        p = p.lstrip(MARK)
        for a, b in zip(p, p[1:], strict=False):
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                group.update(dict.fromkeys(y, x))
    joined = sorted("".join(sorted(g)) for g in {id(g): g for g in group.values()}.values())
    return re.compile(" *(?:" + "".join(f"[{re.escape(g)}]+|" for g in joined) + ".)", re.DOTALL)


def _shared(a: str, b: str) -> int:
    """How many characters two words begin with in common."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Spelled(dict):
    """Ids of pieces as bytes; a character outside the vocabulary has those of its UTF-8 bytes."""

    def __init__(self, ids: dict[str, int], byte_ids: list[int]):
        super().__init__((p, i.to_bytes(4, "little")) for p, i in ids.items())
        self.byte_ids = byte_ids

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = b"".join([self.byte_ids[b].to_bytes(4, "little") for b in piece.encode()])
        return found


class PieceCodec:
    """Ids of texts and texts of ids for a vocabulary of scored pieces.

    No piece holds a mark after another character, so a text is the
    concatenation of its marked words (see ``marked_words``), which
    are encoded alone. The distinct new words of a batch are sorted; walking
    them in order is a depth-first traversal of their trie, and the forward
    states of a prefix serve all words below it.

    ``kind`` is ``unigram`` (a state is the best sum of scores up to there) or
    ``bpe`` (a state is the last piece of the merged prefix: the encoding of a
    prefix ends in the one piece that follows its predecessor without the two
    being merged otherwise).
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], kind: str = "bpe", skip: frozenset = frozenset()):
        self.kind = kind
        self.id = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte_ids = byte_ids
        ends: dict[str, set] = {}
        for p in self.id:
            ends.setdefault(p[-2:], set()).add(len(p))
        #: The lengths of the pieces that end in two given characters, the longest first; a character stands alone if need be.
        self.ends = {e: (*sorted(n - {1}, reverse=True), 1) for e, n in ends.items()}
        self.spell = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.spell[i] = bytes([b])
        for i in skip - set(byte_ids):
            self.spell[i] = b""
        self.spell = [s.replace(MARK.encode(), b" ") if i not in byte_ids else s for i, s in enumerate(self.spell)]
        self.cut = marked_words(self.id).findall
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation of units before
        self.raw = _Spelled(self.id, byte_ids)
        self.fits: dict[str, dict] = {}  # by piece: which pieces it may follow
        self.known_fits = 0
        self._forget_fits()

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        odd = frozenset(i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], skip=odd)

    # --- encoding

    def merged(self, word: str) -> list[str]:
        """Greedy merges of one word: the highest score first, the leftmost where scores tie."""
        if len(word) > SHORT:
            return self._merged_long(word)
        parts, score = list(word), self.score.get
        offers = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while offers and (top := max(offers)) > NEVER:
            i = offers.index(top)
            parts[i] += parts.pop(i + 1)
            del offers[i]
            if i < len(offers):
                offers[i] = score(parts[i] + parts[i + 1], NEVER)
            if i:
                offers[i - 1] = score(parts[i - 1] + parts[i], NEVER)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        """The same with a heap, in time that hardly grows faster than the word."""
        parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(word) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < len(word):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _forget_fits(self) -> None:
        self.fits = {p: {"": True, None: False} for p in self.id}
        self.known_fits = 0

    def _fit(self, a: str, b: str) -> bool:
        """Whether b stays apart from a, the piece before it."""
        self.known_fits += 1
        return a + b not in self.score and self.merged(a + b) == [a, b]

    def _walk(self, words: list[str]):
        """(word, pieces) of sorted words; states of the prefix shared with the word before are kept."""
        return self._walk_sums(words) if self.kind == "unigram" else self._walk_merges(words)

    def _walk_sums(self, words: list[str]):
        back: list[int] = [0]  # where the last piece of each prefix begins
        best: list[float] = [0.0]
        was = ""
        score, ends = self.score.get, self.ends.get
        low = min(self.score.values(), default=0.0) - 10.0  # of a character outside the vocabulary
        for word in words:
            keep = _shared(was, word)
            del back[keep + 1 :], best[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                found, top = -1, NEVER
                for n in ends(word[max(0, i - 2) : i], ONE):
                    if n <= i:
                        s = score(word[i - n : i], low if n == 1 else NEVER)
                        if best[i - n] + s > top:
                            found, top = i - n, best[i - n] + s
                back.append(found)
                best.append(top)
            was = word
            pieces, i = [], len(word)
            while i > 0:
                pieces.append(word[back[i] : i])
                i = back[i]
            yield word, pieces[::-1]

    def _walk_merges(self, words: list[str]):
        last: list[str | None] = [""]  # the last piece of each prefix; none where no piece fits
        was = ""
        ends, fits = self.ends.get, self.fits
        for word in words:
            if self.known_fits > MAX_FITS:
                self._forget_fits()
                fits = self.fits
            del last[_shared(was, word) + 1 :]
            for i in range(len(last), len(word) + 1):
                found = None
                for n in ends(word[i - 2 : i] if i > 1 else word[0], ONE):
                    if n > i:
                        continue
                    piece = word[i - n : i]
                    after = fits.get(piece)
                    if after is None:
                        if n > 1:
                            continue
                        after = fits[piece] = {"": True, None: False}  # a character outside the vocabulary stands alone
                    before = last[i - n]
                    ok = after.get(before)
                    if ok is None:
                        ok = after[before] = self._fit(before, piece)
                    if ok:
                        found = piece
                        break
                last.append(found)
            was = word
            pieces, i = [], len(word)
            while i and (piece := last[i]) is not None:
                pieces.append(piece)
                i -= len(piece)
            yield word, self.merged(word) if i else pieces[::-1]

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet. Runs of marks tie in score and are merged directly."""
        marked = sorted(u.replace(" ", MARK) for u in units)
        plain = [m for m in marked if MARK not in m[1:] or self.kind == "unigram"]
        if len(plain) < len(marked):
            self._store((m, self.merged(m)) for m in marked if MARK in m[1:])
        self._store(self._walk(plain))

    def _store(self, found) -> None:
        raw = self.raw.__getitem__
        for word, pieces in found:
            self.units[word.replace(MARK, " ")] = b"".join(map(raw, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.cut(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.units) > MAX_UNITS:
            self.units, self.old = {}, self.units
        fresh = set().union(*split) - self.units.keys()
        if fresh:
            again = fresh & self.old.keys()
            self.units.update((u, self.old[u]) for u in again)
            self.learn(fresh - again)
        get = self.units.__getitem__
        return [b"".join(map(get, s)) for s in split]

    # --- decoding

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of a text: pieces spelled in turn, marks as spaces, without the mark put before the text."""
        spell = self.spell
        return b"".join([spell[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])[1:]


_SHARED: dict[str, PieceCodec] = {}


def shared(path: str) -> PieceCodec:
    if path not in _SHARED:
        _SHARED[path] = PieceCodec.load(path)
    return _SHARED[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit).

    Null and empty texts have no ids. Repeated rows and null doc_ids are
    encoded as they come; a very long text is one value. An empty table gives
    no rows; other columns are ignored.
    """
    path = model or piece_path()

    def run(batches):
        codec = shared(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1000), pa.array(codec.encode(texts[i : i + 1000]), pa.binary())], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, text. A text comes back as it was, but that U+2581 becomes a space.

    Null ids give an empty text; bytes that are not UTF-8 are replaced.
    """
    path = model or piece_path()

    def run(batches):
        codec = shared(path)
        for b in batches:
            texts = [codec.decode(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encoded and decoded documents: doc_id, n_pieces, ids_crc32, decoded_sha256, n_bytes."""
    path = model or piece_path()

    def run(batches):
        import hashlib
        import zlib

        codec = shared(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                ids = codec.encode(texts[i : i + 1000])
                back = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, 1000), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array(map(len, back), pa.int64()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "n_bytes"],
                )

    return text_of(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, n_bytes long")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
