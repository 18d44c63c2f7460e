"""Top pages by score without scoring every match (X05, O04): postings in blocks with bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.ordering import number_all
from docketry.operators.search import B, K1, SearchIndex

#: Blocks beyond which the first round isn't worth a round of its own.
FIRST_BLOCKS = 8


def bm25(tf: Column, n_terms: Column) -> Column:
    """What a term adds to a score; rises with ``tf`` and falls with the document's length."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * (tf / (tf + K1 * (1 - B + B * n_terms / F.col("mean_terms"))))


@dataclass
class BlockIndex:
    """A search index whose documents are dealt, by length, to blocks of ``size``.

    ``postings``: ``term, block, document_id, tf, n_terms``; ``blocks``: of each term and block the largest ``tf`` and
    the smallest length, from which no document of the block can score more than a bound, whatever the mean length.
    """

    docs: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame

    @staticmethod
    def build(index: SearchIndex, path: str, size: int = 128) -> BlockIndex:
        """Write the blocks of ``index`` under ``path``; documents of like length share a block."""
        spark = index.docs.sparkSession
        places = number_all(index.docs.select("document_id", "n_terms"), [F.col("n_terms"), F.col("document_id")])
        places = places.select("document_id", "n_terms", F.floor((F.col("row_no") - 1) / size).alias("block"))
        postings = index.postings.select("term", "document_id", "tf").join(places, "document_id").select("term", "block", "document_id", "tf", "n_terms")
        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        put(postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), "postings")
        written = spark.read.parquet(f"{path}/postings")
        put(written.groupBy("term", "block").agg(F.max("tf").alias("most"), F.min("n_terms").alias("shortest")).repartitionByRange("term").sortWithinPartitions("term", "block"), "blocks")
        put(index.docs, "docs")
        put(index.terms, "terms")
        return BlockIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("docs", "postings", "blocks", "terms")])


@dataclass
class Top:
    """``rows``: ``document_id, score`` of the page, best first; how many blocks hold all terms, and how many were read."""

    rows: DataFrame
    blocks: int
    read: int


def top_documents(index: BlockIndex, terms: list[str], k: int, among: DataFrame | None = None) -> Top:
    """The ``k`` documents with every term that score best (ties: the larger id), out of ``among`` (``document_id``).

    The blocks with the highest bounds are read first; the k-th score found there is what others must be able to
    reach, so of the rest only blocks with such a bound are read.  Two rounds; the result is exact.  If the first
    round finds less than ``k``, all blocks with all terms are read.
    """
    terms = list(dict.fromkeys(terms))
    whole = index.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean_terms"))
    known = F.broadcast(index.terms.where(F.col("term").isin(terms)).join(F.broadcast(whole)))  # a row a term of the query
    bounds = index.blocks.where(F.col("term").isin(terms)).join(known, "term").groupBy("block").agg(F.sum(bm25(F.col("most"), F.col("shortest"))).alias("bound"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.where(F.col("n") == len(terms)).select("block", (F.col("bound") * (1 + 1e-9)).alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        hits = index.postings.where(F.col("term").isin(terms)).join(blocks.select("block"), "block").join(known, "term")
        hits = hits.join(among.select("document_id").distinct(), "document_id", "left_semi") if among is not None else hits
        found = hits.groupBy("document_id").agg(F.sum(bm25(F.col("tf"), F.col("n_terms"))).alias("score"), F.count(F.lit(1)).alias("n"))
        return found.where(F.col("n") == len(terms)).select("document_id", "score")

    best = [F.col("score").desc(), F.col("document_id").desc()]
    first = bounds.orderBy(F.col("bound").desc(), "block").limit(max(FIRST_BLOCKS, k)).collect()
    if not first:
        return Top(scored(bounds.where(F.lit(False))), 0, 0)
    spark = index.docs.sparkSession
    chosen = spark.createDataFrame([(r.block,) for r in first], "block long")
    page = scored(F.broadcast(chosen)).orderBy(*best).limit(k).collect()
    least = page[-1].score if len(page) == k else None
    rest = bounds.join(F.broadcast(chosen), "block", "left_anti")
    rest = rest.where(F.col("bound") >= least) if least is not None else rest
    counts = bounds.agg(F.count(F.lit(1)).alias("all")).join(rest.agg(F.count(F.lit(1)).alias("more"))).first()
    found = spark.createDataFrame([tuple(r) for r in page], scored(chosen).schema)
    rows = found.unionAll(scored(rest)) if counts.more else found
    return Top(rows.orderBy(*best).limit(k), counts["all"], len(first) + counts.more)
