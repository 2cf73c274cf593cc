"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters (lower case; ASCII other than letters counts as a
space) are hashed to 2^16 features. Document frequencies come from all training
documents. The model is trained by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample of each language, and the scores'
temperature is fitted on a part of the sample that the training doesn't see.
A document's vector is its TF-IDF divided by its sum, so a whole text is scored
by adding up table rows, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_sample, held_out, steps

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
# Documents of each language that the model is fitted on, and those among them that set the temperature.
SAMPLE_PER_LANG = 800
CALIBRATION_SHARE = 5
PIECE_CHARS = 1 << 18
SCALE = 100.0

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _points(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(cp < 128, _FOLD[np.minimum(cp, 127)], cp).astype(np.uint32)


def _gram_ids(cp: np.ndarray, order: int) -> np.ndarray:
    """The feature of each n-gram, by its first place."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(cp) - order + 1), order * 0x27D4EB2F, dtype=np.uint32)
        for j in range(order):
            h = (h ^ cp[j:j + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - (FEATURES - 1).bit_length())


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, features in a piece of it): all n-grams of all texts, a bounded piece at a time."""
    for i, text in enumerate(texts):
        cp = _points(f" {text or ''} ")
        for at in range(0, len(cp), PIECE_CHARS):
            for order in ORDERS:
                yield i, _gram_ids(cp[at:at + PIECE_CHARS + order - 1], order)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(FEATURES, dtype=np.int64)
    for _, ids in _pieces([text]):
        total += np.bincount(ids, minlength=FEATURES)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """Languages, idf, weights (features x languages), biases and temperature."""
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        """idf * weights and, last, idf: what an n-gram adds to a text's sums."""
        return np.column_stack([self.weights * self.idf[:, None] * SCALE, self.idf]).astype(np.float32)

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language or ``und``, calibrated probability) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = np.zeros((len(texts), len(self.langs) + 1))
        for i, ids in _pieces(texts):
            sums[i] += table.take(ids, axis=0).sum(axis=0, dtype=np.float64)
        scores = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-12) + self.bias
        p = softmax(scores / self.temperature)
        best, letter = p.argmax(axis=1), [has_letter(t) for t in texts]
        return ([self.langs[k] if ok else "und" for k, ok in zip(best, letter)],
                np.where(letter, p[np.arange(len(texts)), best], 0.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for multinomial logistic regression over sparse rows; l1 and l2 are the elastic net's."""

    def __init__(self, n_features: int, n_classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.01):
        self.z = np.zeros((n_features + 1, n_classes))
        self.n = np.zeros((n_features + 1, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        at = np.append(ids, len(self.z) - 1)  # the last row is the bias
        x = np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3) -> Model:
    """A model of (language, features, counts) rows, in an order fixed by a seed."""
    langs = sorted({lang for lang, *_ in rows})
    if not langs:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    index = {lang: k for k, lang in enumerate(langs)}
    data = []
    for lang, ids, counts in rows:
        x = counts * idf[ids]
        data.append((index[lang], ids, SCALE * x / max(x.sum(), 1e-12)))
    order = np.random.default_rng(0).permutation(len(data))
    cut = len(order) // CALIBRATION_SHARE
    held, train = order[:cut], order[cut:]
    ftrl = Ftrl(FEATURES, len(langs))
    for _ in range(epochs):
        for i in train:
            label, ids, x = data[i]
            ftrl.learn(ids, x, label)
    w = ftrl.weights(slice(None))
    model = Model(langs, idf, w[:-1], w[-1])
    if cut:
        scores = np.stack([x @ w[ids] + w[-1] for _, ids, x in (data[i] for i in held)])
        model.temperature = fit_temperature(scores, np.asarray([data[i][0] for i in held]))
    return model


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.05 to 20 with the least log loss, by golden section on its logarithm."""
    def loss(t):
        p = softmax(scores / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    a, b, r = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, modulus: int = 5, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model of the rows that aren't held out (``crc32`` of doc_id) and have a language and a letter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out("doc_id", modulus) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        seen = np.zeros(FEATURES, dtype=bool)
        for batch in batches:
            texts = batch.column("text")
            for i in range(len(texts)):
                for _, ids in _pieces([texts[i].as_py()]):
                    seen[ids] = True
                at = np.flatnonzero(seen)
                df[at] += 1
                seen[at] = False
                n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["id", "n"])

    found = rows.select("text").mapInArrow(frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(found["id"].tolist(), found["n"].tolist()))  # a row for each feature at most
    total = found.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    chosen = bounded_sample(rows, "lang", sample_per_lang)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            got = [_counts(texts[i]) for i in keep]
            yield pa.record_batch([pa.array([langs[i] for i in keep], pa.string()), batch.column("doc_id").take(pa.array(keep, pa.int32())),
                                   pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()),
                                   pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())],
                                  names=["lang", "doc_id", "ids", "counts"])

    # At most sample_per_lang ids for each language, so the sample is broadcast.
    sample = (rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])
              .select("lang", "doc_id", "text").mapInArrow(features, "lang string, doc_id long, ids binary, counts binary"))
    got = sorted(sample.collect(), key=lambda r: (r["lang"], r["doc_id"]))
    return fit([(r["lang"], np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4")) for r in got], idf)


def predict(docs: DataFrame, model: Model, modulus: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, and so is every
    text if there was nothing to learn from. A null id counts as held out.
    Repeated rows each have a row. Only doc_id and text are read, and the id only
    for ``held_out``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value
        for batch in steps(batches):
            langs, scores = own.predict(batch.column("text").to_pylist(), table)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                                  names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 5, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """``predict`` by a model that ``train`` makes of the same documents."""
    return predict(docs, train(docs, modulus, sample_per_lang), modulus)


def keep(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least that score, with all their columns; ``und`` goes.

    Null and empty texts, and those without a letter, are ``und``; repeated rows are judged alike, and ids play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value
        for batch in steps(batches):
            langs, scores = own.predict(batch.column("text").to_pylist(), table)
            yield batch.filter(pa.array([lang != "und" and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
