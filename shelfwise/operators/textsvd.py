"""Dense text vectors without pre-trained weights: randomised truncated SVD of the TF-IDF matrix.

Terms are hashed to a fixed number of features, so everything but the documents
has a size set by parameters: the sketch, the projection and each task's sums
are ``num_features x (dim + OVERSAMPLE)`` numbers. With A the documents' unit
TF-IDF rows, a pass over them takes a matrix M to Y = A M and back to A'Y in the
same task, and reduces Y to the triangle R of its QR factorisation (the
triangles of all partitions are stacked and reduced again, TSQR). Then
Q = Y R^-1 is orthonormal and A'Q = (A'Y) R^-1 without Y or Q being kept. A few
such passes from a random M, then the SVD of the small A'Q gives the leading
singular values and the projection V. A document's vector is a V, scaled to unit
length; new texts need V and the document frequencies only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import build_document
from shelfwise.operators.blockscore import _lists
from shelfwise.session import ensure_checkpoint_dir

DIM = 64
FEATURES = 1 << 14
OVERSAMPLE = 10
PASSES = 4
# Singular values below this share of the largest are rounding, not directions.
LEAST_SHARE = 1e-10


@dataclass
class TextProjection:
    """idf: a weight for each feature; components: features x dims; singular: the singular values, falling."""
    idf: np.ndarray
    components: np.ndarray
    singular: np.ndarray

    @property
    def dim(self) -> int:
        return self.components.shape[1]

    def table(self, like: DataFrame) -> DataFrame:
        """(feature, idf, vector): a row for each feature, to be saved with a model."""
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.idf, self.components))]
        return like.sparkSession.createDataFrame(rows, "feature int, idf double, vector array<double>")

    @classmethod
    def load(cls, path: str) -> TextProjection:
        """A projection from its saved table, without Spark; its singular values aren't in it."""
        store, root = fs.FileSystem.from_uri(path)
        rows = ds.dataset(root, filesystem=store, format="parquet").to_table().sort_by("feature")
        vectors = np.array(rows.column("vector").to_pylist(), dtype=np.float64)
        return cls(rows.column("idf").to_numpy(), vectors.reshape(rows.num_rows, -1), np.zeros(0))

    def vectors(self, ptr: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Unit vectors of documents given by their terms' features; zero for one without terms."""
        rows, idx, val = weighted(ptr, features, self.idf)
        out = _times(len(ptr) - 1, rows, idx, val, self.components)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def term_features(document: str | Column, num_features: int = FEATURES) -> Column:
    """A document's terms (between spaces) as features, one for each occurrence; null and empty documents have none."""
    terms = F.filter(F.split(F.coalesce(F.col(document) if isinstance(document, str) else document, F.lit("")), " "), lambda x: x != "")
    return F.transform(terms, lambda x: (F.crc32(x.cast("binary")) % num_features).cast("int"))


def text_features(text: str | None, num_features: int = FEATURES) -> list[int]:
    """``term_features`` of one text."""
    return [zlib.crc32(t.encode()) % num_features for t in (text or "").split(" ") if t]


def weighted(ptr: np.ndarray, features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of unit TF-IDF rows, by row and feature."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    code, tf = np.unique(row * len(idf) + features, return_counts=True)
    row, idx = code // len(idf), code % len(idf)
    val = tf * idf[idx]
    square = np.bincount(row, val * val, len(ptr) - 1)
    return row, idx, val / np.sqrt(square[row])


def _times(n: int, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix; entries come by row."""
    out = np.zeros((n, m.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] = np.add.reduceat(m[idx] * val[:, None], first, axis=0)
    return out


STEP_ROWS = 512


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield _lists(batch.column("features").slice(at, STEP_ROWS), np.int64)


def _pass(docs: DataFrame, idf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A'A M, a triangle R with R'R = M'A'A M) in one pass over the documents (features)."""
    spark, (size, width) = docs.sparkSession, m.shape
    shared = spark.sparkContext.broadcast((idf, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        back, r = np.zeros((size, width)), np.zeros((0, width))
        for ptr, features in _blocks(batches):
            rows, idx, val = weighted(ptr, features, weights)
            y = _times(len(ptr) - 1, rows, idx, val, start)
            order = np.argsort(idx, kind="stable")
            seen = idx[order]
            if len(seen):
                first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
                back[seen[first]] += np.add.reduceat(y[rows[order]] * val[order, None], first, axis=0)
            r = np.linalg.qr(np.concatenate([r, y]), mode="r")
        used = np.flatnonzero(back.any(axis=1))
        yield _vectors("back", used, back[used])
        yield _vectors("r", np.arange(len(r)), r)

    parts = docs.select("features").mapInArrow(run, "kind string, at int, v array<double>").checkpoint(eager=True)
    total = np.zeros((size, width))
    sums = parts.where("kind = 'back'").groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    for row in sums.toLocalIterator():  # num_features rows at most
        total[row["at"]] = row["v"]

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            r = np.linalg.qr(np.concatenate([r, _lists(batch.column("v"), np.float64)[1].reshape(-1, width)]), mode="r")
        yield _vectors("r", np.arange(len(r)), r)

    triangles = parts.where("kind = 'r'").select("v")
    groups = max(1, math.isqrt(triangles.rdd.getNumPartitions()))
    rows = triangles.repartition(groups).mapInArrow(stack, "kind string, at int, v array<double>").collect()  # width rows a group
    r = np.linalg.qr(np.array([x["v"] for x in rows]).reshape(-1, width), mode="r")
    return total, r


def _vectors(kind: str, at: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(list(v), pa.list_(pa.float64()))],
                           names=["kind", "at", "v"])


def fit_projection(docs: DataFrame, text_col: str = "document", dim: int = DIM, num_features: int = FEATURES, passes: int = PASSES,
                   seed: int = 42) -> TextProjection:
    """The leading ``dim`` directions of the documents' TF-IDF rows, fewer if the rows have fewer.

    All documents count in the frequencies and in each pass. No documents, or
    none with a term, give a projection without directions.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(term_features(text_col, num_features).alias("features")).checkpoint(eager=True)
    n = rows.count()
    df = np.zeros(num_features)
    for row in rows.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count("*").alias("n")).toLocalIterator():
        df[row["f"]] = row["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    used = int((df > 0).sum())
    width = min(dim + OVERSAMPLE, max(used, 1))
    m = np.random.default_rng(seed).normal(size=(num_features, width))
    for _ in range(passes):
        back, r = _pass(rows, idf, m)
        # Q = A M T is orthonormal; directions that are only rounding go.
        _, s, vt = np.linalg.svd(r)
        keep = s > LEAST_SHARE * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        t = vt[:len(s)][keep].T / s[keep]
        m = back @ t
        if not m.shape[1]:
            return TextProjection(idf, np.zeros((num_features, 0)), np.zeros(0))
        b, m = m, np.linalg.qr(m)[0]
    v, s, _ = np.linalg.svd(b, full_matrices=False)
    keep = (s > LEAST_SHARE * s[0]) & (np.arange(len(s)) < dim)
    v, s = v[:, keep], s[keep]
    # A direction's sign is free: its largest entry is positive.
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return TextProjection(idf, v, s)


def column_lengths(docs: DataFrame, projection: TextProjection, text_col: str = "document") -> np.ndarray:
    """The length of each column of A V over all documents: the singular values, if V's columns are right singular vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(projection)
    rows = docs.select(term_features(text_col, len(projection.idf)).alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        square = np.zeros(p.dim)
        for ptr, features in _blocks(batches):
            square += (_times(len(ptr) - 1, *weighted(ptr, features, p.idf), p.components) ** 2).sum(axis=0)
        yield pa.record_batch([pa.array([square.tolist()], pa.list_(pa.float64()))], names=["v"])

    total = rows.mapInArrow(run, "v array<double>").agg(Summarizer.sum(array_to_vector("v"))).first()[0]
    return np.sqrt(total.toArray())


def project(books: DataFrame, projection: TextProjection, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """(keys, embedding ARRAY<DOUBLE>) unit vectors of the books' documents."""
    shared = books.sparkSession.sparkContext.broadcast(projection)
    rows = books.select(*keys, term_features(build_document(), len(projection.idf)).alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                found = shared.value.vectors(*_lists(part.column("features"), np.int64))
                yield pa.record_batch([*(part.column(k) for k in keys), pa.array(list(found), pa.list_(pa.float64()))], names=[*keys, "embedding"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, embedding array<double>")


def projection_model(path: str):
    """A batch model of the projection saved at ``path``, for ``predict_batch_udf``: texts in, unit vectors out.

    Each Python worker loads it once.
    """
    def load():
        projection = TextProjection.load(path)
        size = len(projection.idf)

        def predict(texts: np.ndarray) -> np.ndarray:
            features = [text_features(x, size) for x in texts.tolist()]
            ptr = np.concatenate([[0], np.cumsum([len(f) for f in features], dtype=np.int64)])
            return projection.vectors(ptr, np.array([i for f in features for i in f], dtype=np.int64))

        return predict

    return load


def model_vectors(books: DataFrame, path: str, batch_size: int = 256) -> DataFrame:
    """I3 (c): (book_id, embedding) of the books' documents by the saved projection, through ``predict_batch_udf``."""
    encode = predict_batch_udf(projection_model(path), return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return books.select("book_id", encode(F.coalesce(build_document(), F.lit(""))).alias("embedding"))
