"""Queries over stored structures: the versioned BM25 index, and cells of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.operators.search import CANDIDATES
from marlspark.operators.search_index import SearchIndex
from marlspark.operators.vector_cells import Cells
from marlspark.plans.base import query
from marlspark.plans.retrieval import BM25, _docs, _points, _questions


def _built(spark: SparkSession, sf_dir: str) -> SearchIndex:
    index = SearchIndex(spark)
    index.rebuild(lambda: _docs(spark, sf_dir).select("doc_id", "text", "lang"))
    return index


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text, from stored postings with block bounds."""
    return _built(spark, sf_dir).snapshot().search(_questions(spark, sf_dir), 10).hits


@query(
    f"""WITH {BM25}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE lang = 'es')
    SELECT * FROM f WHERE rank <= 10"""
)
def bm25_indexed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one category, whose best score is the threshold; the corpus counts stay those of all documents."""
    return _built(spark, sf_dir).snapshot().search(_questions(spark, sf_dir), 10, F.col("lang") == "es").hits


@query()
def bm25_index_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the blocks of each query's terms, how many are read."""
    return _built(spark, sf_dir).snapshot().search(_questions(spark, sf_dir), 10).touched


@query(f"WITH {BM25.replace('FROM documents', 'FROM documents WHERE doc_id % 10 <> 7')} SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10")
def bm25_indexed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after changes: a third of the documents had another text, a third comes later, and a tenth goes."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    index, third = SearchIndex(spark), F.col("doc_id") % 3
    index.rebuild(lambda: docs.where(third < 2).withColumn("text", F.when(third == 1, F.reverse("text")).otherwise(F.col("text"))))
    index.apply(docs.where(third == 1))
    index.apply(docs.where(third == 2), docs.where("doc_id % 10 = 7").select("doc_id"))
    index.apply(docs.where(F.lit(False)), docs.where("doc_id % 10 = 7").select("doc_id"))
    return index.snapshot().search(_questions(spark, sf_dir), 10).hits


@query()
def vector_cells_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each query vector is compared with, of all."""
    points, asked = _points(spark, sf_dir)
    cells = Cells.build(points.select("id", "embedding"), 64)
    every = int(cells.rings[:, 2].sum()) if len(cells.rings) else 0
    return cells.search(asked.select("query_id", "vector"), CANDIDATES)[1].withColumn("points", F.lit(every).cast("long"))
