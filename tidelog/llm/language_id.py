"""Language identification: nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm._base import binary_texts, frugal, lean, materialize, read, slices, text_of

DIMS = 1 << 13
PER_LANGUAGE = 600  # labelled rows for each language that the fit may use
CLUSTERS = 3
REJECT = 0.08  # cosine below which no centroid is near, whatever the text
BANDS = DIMS.bit_length() + 1  # texts by the bit length of their number of distinct grams
MARGIN = 0.8  # of the least cosine of a band's training rows: what lies below is unlike all of them
ENOUGH = 50  # training rows that a band needs for a bound of its own

_FOLD = np.full(256, 32, dtype=np.uint8)  # other bytes count as a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: The lead byte C3 holds Latin-1 letters, whose capitals lie 32 below the small ones.
_CAPITAL = np.zeros(256, dtype=np.uint8)
_CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = 32


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Hashed counts of byte bigrams, trigrams and 4-grams, one row for each text.

    Letters are lower-cased, other ASCII counts as one space; a text begins
    and ends with a space; grams do not cross texts, whatever stands beside one.
    """
    raw = np.frombuffer(b"".join([b" " + t + b" " for t in texts]), dtype=np.uint8)
    x = _FOLD[raw]
    x[1:] += np.where(raw[:-1] == 0xC3, _CAPITAL[raw[1:]], 0).astype(np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = np.concatenate((x[keep], [32, 32, 32])).astype(np.uint32), np.concatenate((doc[keep], [-1, -1, -1]))
    code, own, out = x[:-3].copy(), doc[:-3], np.zeros(len(texts) * DIMS, dtype=np.float32)
    for n in (1, 2, 3):
        code = code | (x[n : len(x) - 3 + n] << np.uint32(8 * n))
        same = own == doc[n : len(doc) - 3 + n]
        h = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 13)
        out += np.bincount((own * DIMS + h)[same], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without grams stays zero."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    default: str  # the language of most training rows, or und
    least: np.ndarray  # the cosine that a text of each band needs

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages and cosines of the nearest centroids, ``und`` and 0 for a text without a letter; bands."""
        langs, scores, bands = [], np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for a, b in slices(texts, 1 << 20):
            for i in range(a, b, 128):
                some = texts[i : min(i + 128, b)]
                counts = ngram_counts(some)
                near = np.zeros((len(some), 1)) if not self.languages else weighted(counts, self.idf) @ self.centroids.T
                bands[i : i + len(some)] = [int(k).bit_length() for k in (counts > 0).sum(axis=1)]
                best = near.argmax(axis=1)
                for k, t in enumerate(some):
                    s = float(near[k, best[k]])
                    if not has_letter(t.decode()):
                        langs.append("und")
                        continue
                    langs.append(self.languages[best[k]] if s > 0 else self.default)
                    scores[i + k] = min(1.0, max(0.0, s))
        return langs, scores, bands

    def judge(self, texts: list[bytes], reject: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines, and whether a text has no letter or is near to no centroid."""
        langs, scores, bands = self.predict(texts)
        return langs, scores, (np.array(langs, dtype=object) == "und") | (scores < np.maximum(self.least[bands], reject))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _clusters(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from seeds that lie far apart, the first nearest to the mean."""
    mean = rows.mean(axis=0)
    seeds = [int((rows @ mean).argmax())]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int((rows @ rows[seeds].T).max(axis=1).argmin()))
    c = rows[seeds]
    for _ in range(rounds):
        own = (rows @ c.T).argmax(axis=1)
        sums = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """A model of the languages in ``labelled`` (doc_id, text, lang), however many there are.

    A bounded sample is used: of each language the ``per_language`` rows whose
    doc_id and text hash lowest, so that the model depends on the rows alone.
    Each language is fitted in a task of its own; the driver holds ``clusters``
    centroids a language and no rows. Null languages and texts are left out;
    repeated rows count once. Without rows every text with a
    letter is ``und``. The bounds of rejection come from all rows.
    """
    frugal(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    # only keys are ranked, at most per_language of each language from a task
    keys = rows.select("lang", F.xxhash64("doc_id", F.lit(11)).alias("k"), F.xxhash64("text").alias("t"))
    ranked = keys.withColumn("place", F.dense_rank().over(Window.partitionBy("lang").orderBy("k", "t"))).filter(F.col("place") <= per_language)
    last = materialize(ranked.groupBy("lang").agg(F.max(F.struct("k", "t")).alias("last")), "last")  # one row a language
    chosen = rows.withColumn("key", F.struct(F.xxhash64("doc_id", F.lit(11)).alias("k"), F.xxhash64("text").alias("t"))).join(last, "lang").filter("key <= last").dropDuplicates(["lang", "key"])
    sample = materialize(chosen.select("text", "lang").mapInArrow(_packed_counts, "lang string, at binary, n binary"), "sample")
    held = sample.mapInArrow(_holders, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most DIMS rows
    if not held:
        return Model([], np.zeros((0, DIMS), dtype=np.float32), np.ones(DIMS, dtype=np.float32), "und", np.zeros(BANDS))
    total, having = 0, np.zeros(DIMS)
    for r in held:
        if r["at"] < 0:
            total = r["n"]
        else:
            having[r["at"]] = r["n"]
    idf = (np.log((1 + total) / (1 + having)) + 1).astype(np.float32)

    def centroids(table: pa.Table) -> pa.Table:
        grams = sorted(zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True))  # in an order that does not depend on tasks
        own = _clusters(weighted(_dense(*zip(*grams, strict=True)), idf), clusters)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(own), pa.string()), "centroid": pa.array([c.astype("<f4").tobytes() for c in own], pa.binary())})

    found = sorted((r["lang"], bytes(r["centroid"])) for r in sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary").collect())
    default = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").first()["lang"]
    matrix = np.stack([np.frombuffer(c, "<f4") for _, c in found])
    model = Model([lang for lang, _ in found], matrix, idf, default, np.zeros(BANDS))
    model.least = _bounds(rows, model)
    return model


def _packed_counts(batches):
    """text, lang to lang and the grams' places and counts."""
    for b in batches:
        texts, langs = binary_texts(b.column(0)), b.column(1).to_pylist()
        for a, z in slices(texts, 1 << 20):
            for i in range(a, z, 128):
                c = ngram_counts(texts[i : min(i + 128, z)])
                packed = [(np.flatnonzero(r).astype("<u2").tobytes(), r[r > 0].astype("<f4").tobytes()) for r in c]
                yield pa.RecordBatch.from_arrays([pa.array(langs[i : i + len(c)], pa.string()), *(pa.array(v, pa.binary()) for v in zip(*packed, strict=True))], names=["lang", "at", "n"])


def _holders(batches):
    """How many rows have a gram at each place; at -1 how many rows there are."""
    held, rows = np.zeros(DIMS, dtype=np.int64), 0
    for b in batches:
        for at in b.column(1).to_pylist():
            held[np.frombuffer(at, "<u2")] += 1
            rows += 1
    if rows:
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([rows, *held[at].tolist()], pa.int64())], names=["at", "n"])


def _dense(places, counts) -> np.ndarray:
    out = np.zeros((len(places), DIMS), dtype=np.float32)
    for row, at, n in zip(out, places, counts, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
    return out


def _bounds(rows: DataFrame, model: Model) -> np.ndarray:
    """The cosine that a text of each band needs: ``MARGIN`` of the least of all training rows there.

    The more grams a text has, the more of them any centroid shares by chance,
    and the higher the cosines of clean text are. A band of fewer than
    ``ENOUGH`` rows takes the bound of the next lower one that has one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores, bands = m.predict(binary_texts(b.column(0)))
            known = np.array(langs, dtype=object) != "und"
            have = [(k, float(scores[w].min()), int(w.sum())) for k in range(BANDS) if (w := known & (bands == k)).any()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in have], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["band", "least", "n"])

    found = rows.select("text").mapInArrow(lean(run), "band long, least double, n long").groupBy("band").agg(F.min("least").alias("least"), F.sum("n").alias("n")).collect()  # BANDS rows
    own, out = {r["band"]: MARGIN * r["least"] for r in found if r["n"] >= ENOUGH}, np.zeros(BANDS)
    for k in range(BANDS):
        out[k] = own.get(k, out[k - 1] if k else 0.0)
    return out


def predict(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected.

    ``rejected`` holds where a text has no letter or its cosine to the
    nearest centroid is below ``reject`` or the bound for texts of as many grams. Null and empty texts are ``und``.
    Whole texts are read; repeated rows and null doc_ids are judged as they
    come; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x dimensions, whatever the rows

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores, gone = m.judge(binary_texts(b.column(1)), reject)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return text_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents that are not rejected, with their columns.

    A text without a letter, a null and an empty one are rejected, and any
    whose nearest centroid lies beyond ``reject`` or the bound for texts of as
    many grams; all others stay as they are. Whole texts are read, however
    long; repeated rows and null doc_ids are judged as they come; columns may
    have any names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(~m.judge(binary_texts(b.column(at)), reject)[2], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training(docs: DataFrame) -> DataFrame:
    """Labelled documents that are not held out."""
    return docs.filter(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(training(docs)))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
