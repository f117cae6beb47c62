"""A store of vectors with their metadata, and semantic search over it: candidates, exact scores, rerank, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import features
from siftwork.operators import ann
from siftwork.operators import search as S
from siftwork.operators.cache import VersionedTable
from siftwork.sources.files import VECTOR_SCHEMA


class VectorStore:
    """Vectors of one dimension by id, in a versioned table; an id has one row, whatever is added.

    The index of a search is derived from the vectors, so adding, replacing and deleting leave nothing behind in it.
    """

    def __init__(self, spark: SparkSession, folder: str, dim: int = 768, most: int | None = None) -> None:
        self.spark, self.dim, self.most, self.table = spark, dim, most, VersionedTable(spark, folder)

    def all(self) -> DataFrame:
        held = self.table.read()
        return self.spark.createDataFrame([], VECTOR_SCHEMA) if held is None else held

    def add(self, entries: DataFrame) -> int:
        """Insert or replace by id; of several rows of an id the last updated counts. Raises if a vector has another dimension."""
        wrong = entries.where(F.col("embedding").isNull() | (F.size("embedding") != self.dim))
        if not wrong.isEmpty():
            raise ValueError(f"vectors of {self.dim} numbers are expected")
        rest = [c for c in VECTOR_SCHEMA.names if c != "id"]
        last = entries.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "hash")).alias("e")).select("id", *[f"e.{c}" for c in rest])
        return self.table.upsert(last, "id")

    update = add

    def by_id(self, id: str) -> DataFrame:
        return self.all().where(F.col("id") == id)

    def by_file(self, path: str) -> DataFrame:
        return self.all().where(F.col("file_path") == path)

    def delete(self, ids: DataFrame) -> int:
        """Delete the rows whose ``id`` is in ``ids``; gives how many there were."""
        n = self.all().join(ids.select("id").distinct(), "id", "left_semi").count()
        if n:
            self.table.delete(ids, "id")
        return n

    def delete_files(self, paths: DataFrame) -> int:
        """Delete the vectors of files (``file_path``); gives how many there were."""
        return self.delete(self.all().join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id"))

    def replace_files(self, entries: DataFrame) -> int:
        """The entries in place of all vectors of their files."""
        self.delete_files(entries)
        return self.add(entries)

    def stats(self) -> DataFrame:
        """Vectors, files and an estimate of MB, in all and by language and by kind."""
        g = self.all().groupingSets([[F.col("language")], [F.col("code_type")], []], F.col("language"), F.col("code_type"))
        return g.agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), (F.count("*") * self.dim * 4 / 1048576).alias("mb"))

    def search(self, vector: list[float], k: int = 10, least: float = 0.7, exact: bool = False) -> DataFrame:
        """``id``, ``score``, ``rank`` of the ``k`` nearest by cosine of at least ``least``: among bucket neighbours, or among all with ``exact``. With ``most`` of the store never more than that."""
        k = k if self.most is None else min(k, self.most)
        if len(vector) != self.dim:
            raise ValueError(f"a vector of {self.dim} numbers is expected")
        v = self.all().select("id", F.col("embedding").alias("v"))
        q = self.spark.createDataFrame([("?", [float(x) for x in vector])], "query string, qv array<float>")
        found = ann.exact_topk(v, q, k, least=least) if exact else ann.approximate_topk(v, q, self.dim, k, least)
        return found.select("id", "score", "rank")


def semantic_search(store: VectorStore, question: str, k: int = 10, filters: S.Filters | None = None, embedder: str = "lexical", least: float = 0.1, candidates: int = 50, exact: bool = False) -> DataFrame:
    """The best entries for a question: ``id, file_path, similarity, rerank, score, confidence, rank``.

    Candidates by vector, then the rerank score of name, kind and tokens, the combined score, at least ``least``, the
    best ``k``, and only then the filters: a filtered search may give fewer than there are.
    """
    vector = features.EMBEDDERS[embedder](question, store.dim).tolist()
    near = store.search(vector, candidates, least, exact).select("id", F.col("score").alias("similarity"))
    text = F.concat_ws(" ", "function_name", "code_type", "language", F.array_join("tokens", " "))
    rows = store.all().join(near, "id").withColumn("rerank", S.rerank_score(F.lit(question), text))
    rows = rows.withColumn("combined", ann.combined_score(F.col("similarity"), F.col("rerank"))).where(F.col("combined") >= least)
    found = S.search(rows, F.col("combined"), "id", k, filters=filters)
    return found.select("id", "file_path", "similarity", "rerank", "score", ann.combined_confidence(F.col("similarity"), F.col("rerank")).alias("confidence"), "rank")
