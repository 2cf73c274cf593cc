"""Item text -> vector encoders (I3) and the pluggable batch-model hook.

The pre-trained sentence encoder is not available offline; the options are:
the precomputed ``item_embeddings`` table, dense vectors learned from the
catalogue's own texts (``textsvd``: randomised SVD of TF-IDF, whose projection
is saved with a model and encodes new books), or any numpy batch model through
``predict_batch_udf`` (Arrow batches, vectorised). ``hashed_tfidf_encode`` gives
the plain hashed TF-IDF rows.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import build_document
from shelfwise.functions.vectors import l2_normalize
from shelfwise.operators.content import item_vectors
from shelfwise.operators.textsvd import fit_projection, project


def hashed_tfidf_encode(books: DataFrame, num_features: int = 1 << 12) -> DataFrame:
    """(book_id, embedding ARRAY<DOUBLE>) unit vectors from the built document (H3)."""
    docs = books.select("book_id", build_document().alias("document"))
    tok = RegexTokenizer(inputCol="document", outputCol="tokens", pattern=r"\s+", toLowercase=False)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    t = tf.transform(tok.transform(docs))
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(t)
    n = Normalizer(inputCol="tfidf", outputCol="v", p=2.0)
    return n.transform(idf.transform(t)).select("book_id", vector_to_array("v").alias("embedding"))


def encode_items(books: DataFrame, item_embeddings: DataFrame | None = None, *, make_predict_fn=None,
                 dim: int | None = None, batch_size: int = 32) -> DataFrame:
    """(book_id, embedding) unit vectors of the catalogue's books, ready for ``user_profiles`` and the scorers.

    Form (a) joins a table of vectors, (c) runs a batch model over the built
    documents, and without either (b) vectors are learned from the books' documents.
    """
    if item_embeddings is not None:
        return item_vectors(item_embeddings, books, normalize=True)
    if make_predict_fn is not None:
        return l2_normalize(model_encode(books, make_predict_fn, dim, batch_size), "embedding")
    return project(books, fit_projection(books.select(build_document().alias("document"))))


def model_encode(books: DataFrame, make_predict_fn, dim: int, batch_size: int = 32) -> DataFrame:
    """Encode the built documents with ``make_predict_fn() -> fn(np.ndarray[str]) -> np.ndarray[n, dim]``.

    The model is loaded once per Python worker and fed Arrow batches.
    """
    enc = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    docs = books.select("book_id", build_document().alias("document"))
    return docs.select("book_id", enc("document").cast("array<double>").alias("embedding")).where(
        F.size("embedding") == dim)
