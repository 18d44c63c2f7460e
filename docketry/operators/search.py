"""Ranked full-text search (X01 to X10): an inverted index as tables, AND match, BM25, filters, highlights, pages."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from docketry.functions.stem import STOP_WORDS, query_words, stem, stem_term, words_of
from docketry.operators.paging import Page, date_range, decode_cursor, equal_filters, keyset, page_size
from docketry.session import last_put, put_once

# fixed values: parameters of the ranking, and the length of an excerpt
K1, B, FRAGMENT = 1.2, 0.75, 200
#: Partitions of stored postings by term, so that a query reads only its terms'.
TERM_BUCKETS = 64


@dataclass
class SearchIndex:
    """``docs``: stored fields and ``n_terms``; ``postings``: ``term, document_id, tf``; ``terms``: ``term, df``."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stemmed: bool = True

    def write(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        bucket = F.pmod(F.hash("term"), F.lit(TERM_BUCKETS))
        self.postings.withColumn("bucket", bucket).repartition("bucket", "term").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str, stemmed: bool = True) -> SearchIndex:
        return SearchIndex(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stemmed)


def build_index(docs: DataFrame, text: str = "ruling_text", stemmed: bool = True) -> SearchIndex:
    """Index ``docs``, which have a ``document_id``.  Words are counted before they are stemmed, so
    Python sees distinct words only."""
    words = docs.select("document_id", F.explode(words_of(F.col(text))).alias("word"))
    counts = words.groupBy("document_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    if stemmed:
        stems = counts.select("word").distinct().withColumn("term", stem_term("word"))
        counts = counts.join(stems, "word").groupBy("document_id", "term").agg(F.sum("tf").alias("tf"))
    else:
        counts = counts.withColumnRenamed("word", "term")
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stored = docs.withColumn("n_terms", F.coalesce(F.size(words_of(F.col(text))), F.lit(0)))
    return SearchIndex(stored, counts.select("term", "document_id", "tf"), terms, stemmed)


def refresh_index(index: SearchIndex, docs: DataFrame, text: str = "ruling_text", content: str = "content_hash") -> SearchIndex:
    """``index`` after ``docs``, one row a ``document_id``, were put into it.

    Documents whose stored ``content`` equals theirs are skipped, the others replace what is stored or are new; a
    null ``content`` equals nothing.  Only the changed ones are cut into words.  Write the result to a new folder,
    not over the files that ``index`` reads.
    """
    changed = docs.join(index.docs.select("document_id", content), ["document_id", content], "left_anti")
    fresh = build_index(changed, text, index.stemmed)
    gone = changed.select("document_id")
    stored = index.docs.join(gone, "document_id", "left_anti").unionByName(fresh.docs, allowMissingColumns=True)
    old = index.postings.select("term", "document_id", "tf").join(gone, "document_id", "left_anti")
    postings = old.select("term", "document_id", "tf").unionByName(fresh.postings)
    return SearchIndex(stored, postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), index.stemmed)


def publish_index(index: SearchIndex, root: str) -> str:
    """Write ``index`` as a new version under ``root`` and point the alias at it; returns the version's folder.

    The alias is the last of numbered files, each put in place once the version is whole: readers meet the old version
    or the new one, and of two that publish at once the one that comes second has the next number.  Older versions
    stay for readers that have them open.
    """
    spark, folder = index.docs.sparkSession, f"{root}/versions/{uuid.uuid4().hex}"
    index.write(folder)
    while True:
        last = last_put(spark, f"{root}/alias")
        if put_once(spark, f"{root}/alias/{int(last[0]) + 1 if last else 1:012d}", folder):
            return folder


def published_index(spark: SparkSession, root: str, stemmed: bool = True) -> SearchIndex:
    """The index that the alias under ``root`` points at."""
    last = last_put(spark, f"{root}/alias")
    if last is None:
        raise ValueError(f"no index is published under {root}")
    return SearchIndex.read(spark, last[1], stemmed)


def analyze_query(index: SearchIndex, query: str) -> list[str]:
    words = query_words(query)
    return list(dict.fromkeys(stem(w) for w in words)) if index.stemmed else words


def match_all_terms(index: SearchIndex, terms: list[str]) -> DataFrame:
    """``document_id, score`` of the documents that hold every term.

    Frequencies and the mean length are those of the whole index, whatever is filtered later.
    """
    hits = index.postings.where(F.col("term").isin(terms))
    if "bucket" in index.postings.columns:
        bucket = F.pmod(F.hash("term"), F.lit(TERM_BUCKETS))
        wanted = index.docs.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket.alias("bucket")).distinct().collect()
        hits = hits.where(F.col("bucket").isin([r.bucket for r in wanted]))
    whole = index.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean_terms"))
    hits = hits.join(index.terms.where(F.col("term").isin(terms)), "term").join(index.docs.select("document_id", "n_terms"), "document_id")
    hits = hits.join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean_terms")))
    scored = hits.groupBy("document_id").agg(F.sum(idf * weight).alias("score"), F.count(F.lit(1)).alias("n"))
    return scored.where(F.col("n") == len(terms)).drop("n")


def boolean_match(index: SearchIndex, must: list[str] = (), some: list[str] = (), without: list[str] = ()) -> DataFrame:
    """``document_id`` of the documents with all of ``must``, one or more of ``some`` and none of ``without``
    (terms of the index), in one aggregation over these terms' postings; with ``without`` alone, all others."""
    if not must and not some:
        rest = index.docs.select("document_id")
        return rest.join(index.postings.where(F.col("term").isin(list(without))).select("document_id"), "document_id", "left_anti") if without else rest
    hits = index.postings.where(F.col("term").isin([*must, *some, *without]))
    has = lambda terms: F.count_if(F.col("term").isin(list(terms)))
    found = hits.groupBy("document_id").agg(has(must).alias("n_must"), has(some).alias("n_some"), has(without).alias("n_without"))
    wanted = (F.col("n_must") == len(set(must))) & (F.col("n_without") == 0)
    return found.where(wanted & (F.col("n_some") > 0) if some else wanted).select("document_id")


def most_similar(vectors: DataFrame, wanted: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query, <key>, cosine``: for each of some wanted vectors (``query, vector``; few, they are broadcast) the
    ``k`` rows of ``vectors`` closest to it, ties by key.  Filter ``vectors`` by their metadata before.

    Each task keeps its own ``k`` best of a query before these meet."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = vectors.join(F.broadcast(wanted))
    cosine = F.try_divide(product(vector, "vector"), F.sqrt(product(vector, vector)) * F.sqrt(product("vector", "vector")))
    scored = both.select("query", key, cosine.alias("cosine")).where("cosine is not null")
    best = W.partitionBy("query", "part").orderBy(F.col("cosine").desc(), key)
    some = scored.withColumn("part", F.spark_partition_id()).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    last = W.partitionBy("query").orderBy(F.col("cosine").desc(), key)
    return some.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k).select("query", key, "cosine", "place")


def highlighter(terms: list[str], stemmed: bool):
    """A function of texts that gives the part around the first match, with matches marked."""
    wanted = set(terms)

    def mark(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        words = list(re.finditer(r"[^\W_]+(?:['’][^\W_]+)*", text))
        is_hit = lambda m: (w := m[0].lower()) not in STOP_WORDS and (stem(w) if stemmed else w) in wanted
        first = next((m for m in words if is_hit(m)), None)
        if first is None:
            return None
        start = max(0, min(first.start() - FRAGMENT // 4, len(text) - FRAGMENT))
        while start and not text[start - 1].isspace():
            start -= 1
        end = min(len(text), start + FRAGMENT)
        while end < len(text) and not text[end].isspace():
            end += 1
        out, at = [], start
        for m in words:
            if m.start() >= start and m.end() <= end and is_hit(m):
                out += [text[at : m.start()], "<mark>", m[0], "</mark>"]
                at = m.end()
        return "".join([*out, text[at:end]]).strip()

    @pandas_udf(StringType())
    def marked(text: pd.Series) -> pd.Series:
        return text.map(mark)

    return marked


def search(
    index: SearchIndex, query: str | None = None, court: str | None = None, county: str | None = None, state: str | None = None,
    judge_name: str | None = None, case_number: str | None = None, date_from: str | None = None, date_to: str | None = None,
    today: str | None = None, include_future: bool = False, first: int | None = None, after: str | None = None, text: str = "ruling_text",
) -> tuple[Page, DataFrame]:
    """A page of hits, and all matches (count them for the total, A07).

    Filters are exact, but for ``case_number``, which is a beginning (P12, P13).  ``date_to`` takes the place of
    ``today`` as the upper bound (P05).  Hits come by score, if there is a query, then by hearing date (none
    last), then by document id.  Only the hits of the page are marked up.
    """
    docs = equal_filters(index.docs, court=court, county=county, state=state, judge_name=judge_name)
    if case_number:
        docs = docs.where(F.col("case_number").startswith(case_number))
    docs = date_range(docs, "hearing_date", date_from, date_to or (None if include_future else today))
    terms = analyze_query(index, query) if query else []
    if query and not terms:
        docs = docs.where(F.lit(False))
    matches = docs.join(match_all_terms(index, terms), "document_id") if terms else docs.withColumn("score", F.lit(None).cast("double"))
    day = F.coalesce("hearing_date", F.lit("0001-01-01").cast("date"))
    rows = matches.withColumn("__score", F.coalesce("score", F.lit(0.0))).withColumn("__day", day)
    keys = ["__score", "__day", "document_id"]
    if after:
        values = [F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, decode_cursor(after))]
        rows = rows.where(keyset(keys, values, descending=True))
    size = page_size(first)
    rows = rows.orderBy(*[F.col(k).desc() for k in keys]).limit(size + 1)
    excerpt = highlighter(terms, index.stemmed)(F.col(text)) if terms else F.lit(None).cast("string")
    return Page(rows.withColumn("excerpt", excerpt), size, keys), matches


def facets(matches: DataFrame, *columns: str) -> DataFrame:
    """Counts of matches by the values of each column: ``facet, value, n``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return matches.select(pairs.alias("x")).select("x.facet", "x.value").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
