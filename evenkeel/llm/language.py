"""Language identification by nearest clustered centroids.

A text becomes its counts of letter n-grams (one to three letters, lower-cased, words apart),
hashed to a fixed number of dimensions, weighted by TF-IDF and normalised. Each language keeps a
few centroids, found by spherical k-means over its training vectors. A text gets the language of
the centroid nearest by cosine; it is rejected where that cosine is far below what training texts
of its length reach.

The classifier is fitted on a bounded sample: about ``per_language`` labelled documents of
each language, drawn by a hash of id and text at a rate set from full counts, repeated rows once. Labels with under
``LEAST_SHARE`` of the labelled texts are not learned; ``max_languages`` may keep the most frequent only, ties by code point. Vectors and centroids are made on
executors, a language at a time; the driver gets one number for each dimension and the centroids.
Every other step covers all rows, and prediction is a map without any shuffle that sends texts
alone to Python.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected. With no
labelled document every text is ``und``. Ties go to the language first by code point. Repeated
rows get equal predictions. Very long texts are counted whole, in pieces of ``CHUNK`` letters. An
empty table gives no rows. Further columns are ignored by the report and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, staged

UNKNOWN = "und"
DIMENSIONS = 4096
PER_LANGUAGE = 400
CENTROIDS = 3
#: A label is learned where it has this share of the labelled texts at least: up to a million texts that is every label.
LEAST_SHARE = 1e-6
#: Letters that are counted at once.
CHUNK = 1 << 20
#: For rejection, training texts are also cut to so many letters and more, doubling.
SHORTEST, LENGTHS = 8, 12
#: A text is rejected under this share of the cosine that all but this part of the training texts of its length reach.
SLACK, ODDEST = 0.4, 0.01


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters of the text as code points, with one 0 around and between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = np.concatenate([[0], np.where(_letters()[points], points, 0), [0]]).astype(np.int64)
    keep = kept != 0
    keep[1:] |= kept[:-1] != 0
    keep[0] = True
    return kept[keep]


def counts(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed counts of the one- to three-letter runs; none lies over a gap except at its ends."""
    total = np.zeros(dimensions)
    for at in range(0, max(1, len(points) - 1), CHUNK):
        p = points[at : at + CHUNK + 2]
        n = min(CHUNK, len(p))
        one = p[:n]
        hashes = [(one * 0x9E3779B1 >> 7)[one > 0]]
        if len(p) > 1:
            a, b = p[:-1][:n], p[1:][:n]
            hashes.append((a * 0x85EBCA77 + b * 0xC2B2AE3D + 1 >> 9)[(a > 0) | (b > 0)])
        if len(p) > 2:
            a, b, c = p[:-2][:n], p[1:-1][:n], p[2:][:n]
            hashes.append((a * 0x27D4EB2F + b * 0x165667B1 + c * 0x9E3779B1 + 2 >> 8)[b > 0])
        total += np.bincount(np.concatenate(hashes) % dimensions, minlength=dimensions)
    return total


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF of counts, with logarithmic term frequency; zero stays zero."""
    v = np.log1p(count) * idf
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: Least cosine by log2 of the letters.
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        points = code_points(text) if text else np.zeros(0, dtype=np.int64)
        letters = int((points > 0).sum())
        if not letters or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ weighted(counts(points), self.idf).astype(np.float32)
        best = int(near.argmax())
        cosine = float(min(1.0, max(0.0, near[best])))
        return self.languages[self.owner[best]], cosine, bool(cosine < self.floor[_length_class(letters)])


def _length_class(letters: int) -> int:
    return min(LENGTHS - 1, max(0, int(np.log2(max(letters, 1) / SHORTEST)) if letters >= SHORTEST else 0))


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the first vector and then always the one farthest from all centres."""
    centres = vectors[:1]
    while len(centres) < min(k, len(vectors)):
        centres = np.vstack([centres, vectors[(vectors @ centres.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        mine = (vectors @ centres.T).argmax(axis=1)
        sums = np.vstack([vectors[mine == j].sum(axis=0) if (mine == j).any() else centres[j] for j in range(len(centres))])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = sums / np.where(norm > 0, norm, 1)
    return centres


def _vector_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of each text, packed: DIMENSIONS numbers at most, however long it is."""
    for batch in batches:
        made = (counts(code_points(t)).astype("<f4") for t in batch["text"])
        packed = [(np.flatnonzero(c).astype("<u2").tobytes(), c[c > 0].tobytes()) for c in made]
        out = batch[["key", "lang"]].copy()
        out["at"], out["n"] = zip(*packed, strict=True) if packed else ([], [])
        yield out[out["at"].map(len) > 0]


def _frequency_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each dimension, in how many texts it occurs; -1 stands for all texts."""
    seen, texts = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for at in batch["at"]:
            seen[np.frombuffer(at, "<u2")] += 1
        texts += len(batch)
    some = np.flatnonzero(seen)
    yield pd.DataFrame({"d": [-1, *some.tolist()], "n": [texts, *seen[some].tolist()]})


def _clustered(idf: np.ndarray, centroids: int):
    def run(vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("key")
        dense = np.zeros((len(vectors), DIMENSIONS), dtype=np.float32)
        for i, (at, n) in enumerate(zip(vectors["at"], vectors["n"], strict=True)):
            dense[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
        centres = cluster(weighted(dense, idf), centroids).astype("<f4")
        return pd.DataFrame({"lang": vectors["lang"].iloc[0], "k": range(len(centres)), "centre": [c.tobytes() for c in centres]})

    return run


def _nearest(model: Model):
    """For each text and for its beginnings of doubling lengths: the length class and the nearest cosine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                points = code_points(text)
                for cut in [*(SHORTEST << k for k in range(LENGTHS) if SHORTEST << k < len(points)), len(points)]:
                    letters = int((points[:cut] > 0).sum())
                    if letters:
                        near = float((model.centroids @ weighted(counts(points[:cut]), model.idf).astype(np.float32)).max())
                        found.append((_length_class(letters), near))
            yield pd.DataFrame(found, columns=["c", "near"])

    return run


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int | None = None) -> DataFrame:
    """labelled: doc_id, lang, text. key, lang and text of about per_language rows of each learned language."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = staged(known.groupBy(F.col("lang").alias("t_lang")).count(), "language-totals")
    # one row for each label, a million at most
    totals = totals.crossJoin(F.broadcast(totals.agg(F.sum("count").alias("all")))).where(F.col("count") >= LEAST_SHARE * F.col("all")).drop("all")
    if max_languages is not None:
        totals = totals.orderBy(F.col("count").desc(), "t_lang").limit(max_languages)
    key = F.xxhash64(F.lit("language sample"), "doc_id", "text")
    share = F.shiftrightunsigned(key, 11) / F.lit(float(2**53))
    drawn = (
        known.join(F.broadcast(totals), F.col("lang") == F.col("t_lang"))
        .where(share * F.col("count") < F.lit(float(per_language)))
        .select(key.alias("key"), "lang", "text")
        .dropDuplicates(["key", "lang"])
    )
    return staged(drawn, "language-sample")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, max_languages: int | None = None) -> Model:
    """labelled: doc_id, lang, text."""
    bounded_batches(labelled.sparkSession)
    sample = training_sample(labelled, per_language, max_languages)
    vectors = staged(sample.mapInPandas(_vector_batches, "key bigint, lang string, at binary, n binary"), "language-vectors")
    seen = vectors.select("at").mapInPandas(_frequency_batches, "d int, n bigint").groupBy("d").agg(F.sum("n").alias("n")).collect()
    frequency, texts = np.zeros(DIMENSIONS), 0
    for d, n in seen:
        if d < 0:
            texts = n
        else:
            frequency[d] = n
    idf = (np.log((1 + texts) / (1 + frequency)) + 1).astype(np.float32)
    rows = vectors.groupBy("lang").applyInPandas(_clustered(idf, centroids), "lang string, k int, centre binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    languages = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    centres = np.vstack([np.frombuffer(r["centre"], "<f4") for r in rows]) if rows else np.zeros((0, DIMENSIONS), dtype=np.float32)
    model = Model(languages, idf, centres, np.array([place[r["lang"]] for r in rows], dtype=int), np.zeros(LENGTHS))
    # a class of lengths that no training text reaches rejects nothing
    if languages:
        near = sample.select("text").mapInPandas(_nearest(model), "c int, near double")
        for c, low in near.groupBy("c").agg(F.expr(f"percentile(near, {ODDEST}D)")).collect():
            model.floor[c] = low * SLACK
    return model


PREDICTION = "struct<lang_pred:string,score:double,rejected:boolean>"


def told(spark: SparkSession, model: Model, text: Column) -> Column:
    """lang_pred, score and rejected of a text; Python gets nothing but the text."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            made = [shared.value.predict(t.as_py()) for t in batch]
            yield pa.array([dict(zip(("lang_pred", "score", "rejected"), m, strict=True)) for m in made], type=kind)

    return F.arrow_udf(run, PREDICTION)(text)


def predictions(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """The key columns, lang_pred, score and rejected of every row; only text is looked at."""
    rows = docs.select(*keys, told(docs.sparkSession, model, F.col("text")).alias("__ek_told"))
    return rows.select(*keys, "__ek_told.lang_pred", "__ek_told.score", "__ek_told.rejected")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def identified(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))).select("doc_id", "lang", "text"), **options)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predictions(rows, model, "doc_id", "held_out")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are rejected; the columns of docs stay."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))).select("doc_id", "lang", "text"), **options)
    return docs.where(~told(docs.sparkSession, model, F.col("text"))["rejected"])


def op1_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read_table(spark, sf_dir, "documents"))
