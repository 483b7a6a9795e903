"""TF-IDF and latent semantic analysis."""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..runtime import cut

#: Terms kept, concepts computed.
VOCABULARY, CONCEPTS = 5000, 25
#: Up to so many terms the decomposition is worked out from the terms' Gramian matrix (72 MB), beyond by the distributed solver.
GRAMIAN_TERMS = 3000


def term_freqs(docs: DataFrame, doc: str, terms: str) -> DataFrame:
    """doc, term, tf, doc_len: occurrences per document, and the document's number of terms."""
    return docs.select(doc, F.size(terms).alias("doc_len"), F.explode(terms).alias("term")).groupBy(doc, "doc_len", "term").agg(F.count("*").alias("tf"))


def doc_freqs(tf: DataFrame, n_docs: int, top_n: int = VOCABULARY, min_df: int = 1) -> DataFrame:
    """term, df, idf: the terms in most documents, ties by term; idf = ln(documents / df)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.orderBy(F.desc("df"), "term").limit(top_n).withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def tf_idf(tf: DataFrame, idf: DataFrame, doc: str) -> DataFrame:
    """doc, term, weight = idf x tf / doc_len, for terms of the vocabulary (at most its size limit, hence broadcast)."""
    return tf.join(F.broadcast(idf), "term").select(doc, "term", (F.col("idf") * F.col("tf") / F.col("doc_len")).alias("weight"))


def keyword_scores(weights: DataFrame, idf: DataFrame, doc: str, words: list[str], n: int = 10) -> DataFrame:
    """doc, score: sum over the query's known terms of idf x weight; top n, ties to the larger id."""
    q = idf.where(F.col("term").isin(*words)).select("term", "idf")
    return weights.join(F.broadcast(q), "term").groupBy(doc).agg(F.sum(F.col("weight") * F.col("idf")).alias("score")).orderBy(F.desc("score"), F.desc(doc)).limit(n)


class Lsa:
    """Truncated SVD of the documents' TF-IDF rows. The terms' side (vocabulary x concepts) is local, the documents' side distributed.

    Each concept's sign is fixed so that its weight of greatest size among the terms is positive.
    """

    def __init__(self, weights: DataFrame, idf: DataFrame, doc: str, k: int = CONCEPTS):
        spark = weights.sparkSession
        vocab = [r["term"] for r in idf.select("term").orderBy("term").collect()]  # at most the vocabulary's size limit
        self.terms, self.doc = vocab, doc
        ids = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "term string, j int")
        rows = weights.join(F.broadcast(ids), "term").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("j", "weight"))).alias("v"))
        rows = cut(rows)
        size = len(vocab)
        vectors = rows.rdd.map(lambda r: OldVectors.sparse(size, [x["j"] for x in r["v"]], [x["weight"] for x in r["v"]]))
        # as a DataFrame of vectors the rows stay in the JVM over the solver's many passes
        held = spark.createDataFrame(vectors.map(lambda x: (x,)), StructType([StructField("v", VectorUDT())])).persist()
        matrix, k = RowMatrix(held), min(k, size)
        if size <= GRAMIAN_TERMS:
            # one pass over the rows, then a local eigenproblem of bounded size
            values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
            self.s, v = np.sqrt(np.clip(values[::-1][:k], 0, None)), vectors[:, ::-1][:, :k]
        else:
            svd = matrix.computeSVD(k, computeU=False)
            self.s, v = svd.s.toArray(), svd.V.toArray()
        held.unpersist()
        flip = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        self.v = v * flip
        self.rows = rows

    def term_weights(self) -> DataFrame:
        """concept, term, weight"""
        spark = self.rows.sparkSession
        return spark.createDataFrame([(c, t, float(self.v[i, c])) for c in range(self.v.shape[1]) for i, t in enumerate(self.terms)], "concept int, term string, weight double")

    def _basis(self, scale: np.ndarray) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.createDataFrame([(i, (self.v[i] * scale).tolist()) for i in range(len(self.terms))], "j int, basis array<double>")

    def doc_weights(self, scaled: bool = False) -> DataFrame:
        """doc, u: the documents in concept space, U (or U x S with ``scaled``), as rows x V (/ S) by a join on the term and sums."""
        with np.errstate(divide="ignore"):
            scale = np.ones(len(self.s)) if scaled else np.where(self.s > 0, 1 / self.s, 0.0)
        k = self.v.shape[1]
        e = self.rows.select(self.doc, F.explode("v").alias("x")).select(self.doc, "x.j", "x.weight").join(F.broadcast(self._basis(scale)), "j")
        sums = e.groupBy(self.doc).agg(*[F.sum(F.col("weight") * F.col("basis")[c]).alias(f"c{c}") for c in range(k)])
        return sums.select(self.doc, F.array(*[F.col(f"c{c}") for c in range(k)]).alias("u"))

    def top_terms(self, n: int = 25) -> DataFrame:
        """concept, rank, term, weight: by signed weight."""
        return _top(self.term_weights(), "term", n)

    def top_docs(self, n: int = 25) -> DataFrame:
        """concept, rank, doc, weight: by signed weight."""
        long = self.doc_weights().select(self.doc, F.posexplode("u").alias("concept", "weight"))
        return _top(long, self.doc, n)

    def query(self, words: list[str], idf: DataFrame, n: int = 10, cosine: bool = False) -> DataFrame:
        """doc, score: dot product of U x S (rows of length one with ``cosine``) with the query's place in concept space."""
        known = {r["term"]: r["idf"] for r in idf.where(F.col("term").isin(*words)).collect()}  # at most one row per query word
        q = np.zeros(len(self.terms))
        for i, t in enumerate(self.terms):
            q[i] = known.get(t, 0.0)
        place = F.array(*[F.lit(float(x)) for x in self.v.T @ q])
        total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
        d = self.doc_weights(scaled=True)
        score = total(F.zip_with("u", place, lambda a, b: a * b))
        if cosine:
            norm = F.sqrt(total(F.transform("u", lambda a: a * a)))
            score = F.when(norm > 0, score / norm).otherwise(0.0)
        return d.select(self.doc, score.alias("score")).orderBy(F.desc("score"), F.desc(self.doc)).limit(n)


def _top(df: DataFrame, name: str, n: int) -> DataFrame:
    """Best n per concept: each partition first keeps its own best n, so that no task sorts all documents of a concept."""
    local = Window.partitionBy("concept", F.pmod(F.xxhash64(name), F.lit(256))).orderBy(F.desc("weight"), name)
    w = Window.partitionBy("concept").orderBy(F.desc("weight"), name)
    few = df.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= n).drop("rank")
    return few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("concept", "rank", name, "weight")

