"""TF-IDF over tag/text columns as long-form DataFrames, and its cosine top-k.

Weights follow the smoothed formulation: tf = raw count,
idf = ln((1 + n_docs) / (1 + df)) + 1, each document L2-normalised. Spark ML's
IDF omits the ``+ 1``, so the weights are built from plain aggregates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions.text import word_tokens
from shelfwise.operators.blockscore import exact_topk
from shelfwise.operators.ranking import unique_ids
from shelfwise.operators.sparsetopk import sparse_topk
from shelfwise.session import scratch_path


def corpus(books: DataFrame, columns) -> DataFrame:
    """(book_id, doc): the non-null tag columns joined by spaces."""
    return books.select("book_id", F.concat_ws(" ", *[F.col(c) for c in columns]).alias("doc"))


def tfidf(docs: DataFrame, text_col: str = "doc") -> DataFrame:
    """I4: (book_id, term, weight), L2-normalised per document.

    n_docs counts every document, including ones with no token. Texts are read
    and tokenised once: the term counts are kept, and document frequencies and
    weights come from them. Document frequency is a partial aggregate per term
    joined back on the term: AQE broadcasts it when the vocabulary is small at
    run time (the per-document norm then shuffles by book once), and splits the
    skewed partitions of very common terms when it is not (a window by term
    would put a term found in a third of all documents into one task).
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    tf = (docs.select("book_id", F.explode(word_tokens(text_col)).alias("term"))
          .groupBy("book_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    path = scratch_path(spark, f"term-counts-{uuid.uuid4().hex}")
    tf.write.parquet(path)  # read by column afterwards, unlike a checkpoint
    tf = spark.read.schema(tf.schema).parquet(path)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    w = tf.join(df, "term").select("book_id", "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("book_id")))
    return w.select("book_id", "term", (F.col("w") / norm).alias("weight"))


def tfidf_vectors(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(book_id, tfidf STRUCT<idx, val>) over exact unique term ids; empty docs get empty vectors."""
    ids = unique_ids(weights.select("term"), "term", "tid")
    v = (weights.join(ids, "term")
         .groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("tid", "weight"))).alias("e")))
    return (docs.select("book_id").join(v, "book_id", "left")
            .select("book_id", F.struct(
                F.coalesce(F.transform("e", lambda x: x["tid"]), F.array().cast("array<bigint>")).alias("idx"),
                F.coalesce(F.transform("e", lambda x: x["weight"]), F.array().cast("array<double>")).alias("val"))
                .alias("tfidf")))


def tfidf_similarity(vectors: DataFrame, k: int = 10, lists: bool = False) -> DataFrame:
    """Per book, the k most cosine-similar other books (book_id, rank, other_id, score).

    ``lists`` goes by inverted lists (``sparsetopk``): the same rows, and far fewer
    pairs where most terms are rare.
    """
    if lists:
        return sparse_topk(vectors, "book_id", "tfidf", k, out=("book_id", "rank", "other_id", "score"))[0]
    return exact_topk(vectors, "book_id", "tfidf", vectors, "book_id", "tfidf", k,
                      exclude_same_id=True, kind="sparse", out=("book_id", "rank", "other_id", "score"))
