"""Quality classifier: a byte-level convolutional network in numpy.

Filters slide over every byte of a document. Its places are taken in chunks;
neighbouring chunks overlap by a filter's width, so no window is missed. Each
filter is max-pooled in each chunk, the chunks' maxima are pooled to their
greatest and their mean, and a small layer makes one probability of these. An
embedding of the bytes and the filters multiply to a table for each offset, so a
window's response is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_sample, held_out, steps

WIDTH, FILTERS, EMBEDDING, HIDDEN = 6, 12, 8, 8
CHUNK = 512
# The fitting sample: documents of each label, and bytes above which a document isn't in it.
SAMPLE_PER_LABEL, SAMPLE_MAX_BYTES = 1500, 1 << 16
BLOCK_BYTES = 1 << 18
THRESHOLD = 0.3


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape) / np.sqrt(shape[0])
        self.p = {"bytes": rng.normal(0, 0.5, (256, EMBEDDING)), "filters": rng.normal(0, 1, (WIDTH, EMBEDDING, FILTERS)) / np.sqrt(WIDTH * EMBEDDING),
                  "w1": normal(2 * FILTERS, HIDDEN), "b1": np.zeros(HIDDEN), "w2": normal(HIDDEN, 1), "b2": np.zeros(1)}

    def tables(self) -> np.ndarray:
        """(offset, byte, filter)"""
        return np.einsum("be,jef->jbf", self.p["bytes"], self.p["filters"]).astype(np.float32)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, logit) of pooled responses."""
        hidden = np.tanh(pooled @ self.p["w1"] + self.p["b1"])
        return hidden, (hidden @ self.p["w2"] + self.p["b2"])[:, 0]

    def scores(self, texts: list[str | None], tables: np.ndarray) -> np.ndarray:
        """The probability of label 1 for whole texts; memory is bounded by a block of bytes and a chunk's maxima."""
        top = np.full((len(texts), FILTERS), -np.inf)
        total, chunks = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        for owners, data, cuts in _blocks(texts):
            maxima = np.maximum.reduceat(_responses(data, tables), cuts, axis=0)[::2].astype(np.float64)
            np.maximum.at(top, owners, maxima)
            np.add.at(total, owners, maxima)
            np.add.at(chunks, owners, 1)
        _, logit = self.head(np.column_stack([top, total / np.maximum(chunks, 1)[:, None]]))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _responses(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each filter at each place of ``data`` (the last ones are short of bytes and repeat the end)."""
    n = len(data) - WIDTH + 1
    out = tables[0].take(data[:n], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(data[j:n + j], axis=0)
    return out


def _bytes(text: str | None) -> np.ndarray:
    """A text's bytes; one shorter than a filter is filled up with zeros."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return data if len(data) >= WIDTH else np.concatenate([data, np.zeros(WIDTH - len(data), dtype=np.uint8)])


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each chunk, bytes, begin and end of each chunk's places) for blocks of chunks of all texts."""
    owners, parts, cuts, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = _bytes(text)
        places = len(data) - WIDTH + 1
        at = 0
        while at < places:
            n = min(places - at, max(CHUNK, (BLOCK_BYTES - size) // CHUNK * CHUNK))
            parts.append(data[at:at + n + WIDTH - 1])
            for k in range(0, n, CHUNK):
                owners.append(i)
                cuts += [size + k, size + min(n, k + CHUNK)]
            size += n + WIDTH - 1
            at += n
            if size >= BLOCK_BYTES:
                yield _block(owners, parts, cuts)
                owners, parts, cuts, size = [], [], [], 0
    if owners:
        yield _block(owners, parts, cuts)


def _block(owners, parts, cuts):
    # A byte more at the end, so that the last chunk's end is a place as well.
    return np.asarray(owners), np.concatenate([*parts, np.zeros(1, dtype=np.uint8)]), np.asarray(cuts)


def fit(rows: list[tuple[int, bytes]], prior: float, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 0) -> Network:
    """A network for (label, text's bytes) rows by Adam; ``prior`` is label 1's share among all labelled documents."""
    net = Network(seed)
    ones = np.mean([label for label, _ in rows]) if rows else 0.5
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    if rows and 0 < ones < 1:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
        data = [(label, _bytes(raw.decode())) for label, raw in rows]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), batch):
                grads = _gradients(net, [data[i] for i in order[at:at + batch]])
                t += 1
                step = rate / (1 + t / 400)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    net.p[k] -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-8)
        net.p["b2"] += logit(prior) - logit(ones)  # the sample holds the labels in other shares
    else:
        net.p["w2"][:] = 0
        net.p["b2"][:] = logit(prior)
    return net


def _gradients(net: Network, rows: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    """Of the mean log loss; only each chunk's greatest response passes a gradient on."""
    tables = net.tables()
    pooled, where = [], []
    for _, data in rows:
        r = _responses(data, tables)
        n = -(-len(r) // CHUNK)
        padded = np.full((n * CHUNK, FILTERS), -np.inf, dtype=np.float32)
        padded[:len(r)] = r
        best = padded.reshape(n, CHUNK, FILTERS).argmax(axis=1) + np.arange(n)[:, None] * CHUNK
        maxima = r[best, np.arange(FILTERS)]
        where.append((best, maxima.argmax(axis=0)))
        pooled.append(np.concatenate([maxima.max(axis=0), maxima.mean(axis=0)]))
    x = np.asarray(pooled, dtype=np.float64)
    hidden, logit = net.head(x)
    y = np.asarray([label for label, _ in rows])
    d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)[:, None] / len(rows)
    dh = d @ net.p["w2"].T * (1 - hidden ** 2)
    dx = dh @ net.p["w1"].T
    dt = np.zeros((WIDTH, 256, FILTERS))
    f = np.arange(FILTERS)
    for (_, data), (best, top), g in zip(rows, where, dx):
        own = np.repeat(g[None, FILTERS:] / len(best), len(best), axis=0)
        own[top, f] += g[:FILTERS]
        for j in range(WIDTH):
            np.add.at(dt[j], (data[best + j], f), own)
    return {"w2": hidden.T @ d, "b2": d.sum(axis=0), "w1": x.T @ dh, "b1": dh.sum(axis=0),
            "bytes": np.einsum("jbf,jef->be", dt, net.p["filters"]), "filters": np.einsum("jbf,be->jef", dt, net.p["bytes"])}


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample_per_label: int = SAMPLE_PER_LABEL,
          sample_max_bytes: int = SAMPLE_MAX_BYTES) -> Network:
    """A network of labelled rows (doc_id, quality 0 or 1) that aren't held out.

    The prior counts all of them; the sample has ``sample_per_label`` of each
    label, less those whose text has more than ``sample_max_bytes``.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(~held_out("doc_id", modulus) & F.col("quality").isin(0, 1)))
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    chosen = bounded_sample(known, "quality", sample_per_label)
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
             .where(F.octet_length("text") <= sample_max_bytes))
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "quality"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return fit([(r["quality"], r["text"].encode()) for r in rows], prior)


def score(docs: DataFrame, network: Network, modulus: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are zeros of a filter's width and get that score.
    A null id counts as held out; repeated rows each have a row; other columns are
    not read. Without labels of both kinds every score is label 1's share, or 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value
        for batch in steps(batches):
            p = net.scores(batch.column("text").to_pylist(), tables)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """``score`` by a network that ``train`` makes of the labelled ones among the documents."""
    return score(docs, train(docs, labels, modulus), modulus)
