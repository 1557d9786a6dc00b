"""Literature corpus: conform, dedupe, filter, score, rank and summarize papers."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.adapters import SOURCES
from evidex.functions.text import any_in, count_occurrences
from evidex.operators.blocks import overlap_search
from evidex.operators.graph import cut
from evidex.operators.titles import title_pairs

MERGED = ("title", "abstract", "doi", "pmid", "pmcid", "year", "influential_citations", "reference_count", "is_open_access", "journal", "authors", "publication_type", "keywords", "pdf_url")


#: Sources that are scanned at a time.
AT_ONCE = 4


def federated_union(sources: dict[str, DataFrame | Callable[[], DataFrame]], selected: list[str], spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, status): the selected sources' rows, and (source, status, n_results) of each.

    A source is a table or a function that makes one, as a scan of files does. Each is scanned by itself and
    written, several at a time, so that one that fails, when it is made or when it is read, gives no rows
    and a status with the reason, and the others are as they would be without it. A name that isn't among
    the sources is a failed one; a repeated one counts once.
    """
    tables = [x for x in sources.values() if isinstance(x, DataFrame)]
    spark = spark or (tables[0].sparkSession if tables else SparkSession.getActiveSession())
    selected = list(dict.fromkeys(selected))

    def scan(name: str) -> tuple[str, str, int, DataFrame | None]:
        if name not in sources:
            return name, "Failed: unknown source", 0, None
        try:
            made = sources[name]
            rows = cut((made if isinstance(made, DataFrame) else made()).withColumn("source", F.lit(name)))
            n = rows.count()
        except Exception as error:  # whatever a source raises is its outcome
            return name, f"Failed: {reason(error)}", 0, None
        return name, f"OK ({n} results)" if n else "No results", n, rows

    with ThreadPoolExecutor(AT_ONCE) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(scan), selected))
    found = [rows for *_, rows in outcomes if rows is not None]
    none = spark.createDataFrame([], "ord long, title string, source string")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else none
    return union, spark.createDataFrame([x[:3] for x in outcomes], "source string, status string, n_results long")


def reason(error: Exception) -> str:
    """The error class that Spark names, or else the error's own type."""
    seen = error
    while seen is not None:
        name = seen.getCondition() if hasattr(seen, "getCondition") else None
        if name and name not in ("FAILED_READ_FILE.NO_HINT", "TASK_WRITE_FAILED"):
            return name
        seen = seen.__cause__
    found = re.findall(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]", str(error))
    return found[-1] if found else type(error).__name__


def identifier_key(doi: Column, pmid: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.lower(F.nullif(doi, empty)), F.concat(F.lit("pmid:"), F.nullif(pmid, empty)))


def merge_papers(keyed: DataFrame, key: str) -> DataFrame:
    """One row for each key: fields first filled in order of ord, sources joined, the highest citation count.

    Partial aggregation keeps one value a field and key on each task before the shuffle.
    """
    order = F.col("ord")
    full = lambda c: F.when(F.col(c).isNotNull() & ((F.col(c) != "") if dict(keyed.dtypes)[c] == "string" else F.lit(True)), order)
    firsts = [F.min_by(c, full(c)).alias(c) for c in MERGED if c in keyed.columns]
    names = F.array_sort(F.collect_set("source"))
    return keyed.groupBy(key).agg(F.min("ord").alias("ord"), *firsts, F.max("citation_count").alias("citation_count"), F.concat_ws(", ", names).alias("source"), F.count("*").alias("n_merged"))


def dedupe_by_identifier(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows of papers with a DOI or PMID, rows without either)."""
    keyed = papers.withColumn("key", identifier_key(F.col("doi"), F.col("pmid")))
    return merge_papers(keyed.filter("key is not null"), "key").drop("key"), keyed.filter("key is null").drop("key")


def dedupe_by_title(merged: DataFrame, loose: DataFrame, least: float = 0.9) -> DataFrame:
    """``merged`` and those of ``loose`` whose title is like none of them; like ones join the first such row.

    A joined row adds its source and citation count, and fills fields that the row lacks.
    """
    heads = loose.groupBy(F.lower("title").alias("t")).agg(F.min("title").alias("title"), F.min("ord").alias("ord"))
    pairs = title_pairs(heads, merged, least, first=True).select("ord", F.col("other").alias("target"))
    target = heads.join(pairs, "ord").select("t", "target")
    marked = loose.withColumn("t", F.lower("title")).join(target, "t", "left").drop("t")
    rows = merged.drop("n_merged").withColumn("target", F.col("ord")).unionByName(marked.withColumn("target", F.coalesce("target", "ord")), allowMissingColumns=True)
    return merge_papers(rows, "target").drop("target")


def filter_papers(
    papers: DataFrame, year_from: int | None = None, year_to: int | None = None, journal: str | None = None, author: str | None = None, open_access: bool = False,
    full_text: bool = False, article_type: str | None = None, human: bool = False, animal: bool = False,
) -> DataFrame:
    """Optional predicates; a null year passes the year range."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tests = []
    if year_from is not None:
        tests.append(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        tests.append(F.col("year").isNull() | (F.col("year") <= year_to))
    if journal:
        tests.append(F.contains(low(F.col("journal")), F.lit(journal.lower())))
    if author:
        tests.append(F.exists("authors", lambda a: F.contains(low(a), F.lit(author.lower()))))
    if open_access:
        tests.append(F.col("is_open_access"))
    if full_text:
        tests.append((F.coalesce("pdf_url", F.lit("")) != "") | (F.coalesce("pmcid", F.lit("")) != ""))
    if article_type:
        tests.append(F.contains(low(F.col("publication_type")), F.lit(article_type.lower())))
    if human:
        tests.append(~F.contains(F.substring(low(F.col("abstract")), 1, 400), F.lit("animal")))
    if animal:
        tests.append(any_in(low(F.col("abstract")), ("mouse", "mice", "rat ", "murine", "animal model")))
    return reduce(lambda d, t: d.filter(t), tests, papers)


def query_terms(query: str) -> list[str]:
    import re

    return re.findall(r"[a-zA-Z0-9]+", query.lower())


def score_relevance(papers: DataFrame, query: str, as_of_year: int) -> DataFrame:
    """Adds relevance_score: term hits, three times those in titles, citations and recency."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.concat_ws(" ", "keywords")))
    title = F.lower(F.coalesce("title", F.lit("")))
    zero = F.lit(0)
    hits = reduce(lambda a, b: a + b, [count_occurrences(text, t) + 3 * count_occurrences(title, t) for t in query_terms(query)], zero)
    cited = 0.02 * F.least(F.coalesce("citation_count", zero), F.lit(500))
    recent = F.when(F.col("year").isNull(), 0.0).otherwise(0.5 * F.greatest(5 - (as_of_year - F.col("year")), zero))
    return papers.withColumn("relevance_score", F.round(hits + cited + recent, 3))


def _order(sort_by: str) -> list[Column]:
    year = lambda missing: F.coalesce("year", F.lit(missing))
    first = {"newest": year(0).desc(), "oldest": year(9999).asc(), "citations": F.coalesce("citation_count", F.lit(0)).desc(), "relevance": F.col("relevance_score").desc()}[sort_by]
    return [first, F.col("ord").asc()]


def rank_papers(papers: DataFrame, sort_by: str = "relevance", top: int | None = None) -> DataFrame:
    """The order of results; with ``top``, a top-k that never sorts the whole table in one task."""
    if top is not None:
        papers = papers.orderBy(*_order(sort_by)).limit(top)
        return papers.withColumn("rank", F.row_number().over(Window.orderBy(*_order(sort_by))))
    return papers.orderBy(*_order(sort_by))


def search_papers(papers: DataFrame, query: str, as_of_year: int, max_results: int = 50, sort_by: str = "relevance", least: float = 0.9, **filters) -> DataFrame:
    """Dedupe, filter, score, rank and cut at twice ``max_results``."""
    whole = dedupe_by_title(*dedupe_by_identifier(papers), least=least)
    return rank_papers(score_relevance(filter_papers(whole, **filters), query, as_of_year), sort_by, 2 * max_results)


def paper_terms(papers: DataFrame) -> DataFrame:
    """(ord, keys): hashes of the distinct words of four letters or more of title and abstract."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-zA-Z]{4,}"), F.lit(0)))
    return papers.select("ord", F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))).alias("keys"))


def find_similar_papers(papers: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """(target, ord, overlap, rank): for each of ``targets`` (ord) the papers that share most terms.

    Blocks of targets meet blocks of papers (see ``overlap_search``), so a term that every paper has
    makes no rows. Terms are told apart by 64 bits of hash.
    """
    terms = paper_terms(papers)
    wanted = terms.join(targets.select("ord").distinct(), "ord", "left_semi").withColumnRenamed("ord", "query")
    found = overlap_search(wanted, terms.withColumnRenamed("ord", "id"), top)
    return found.select(F.col("query").alias("target"), F.col("id").alias("ord"), F.col("score").cast("long").alias("overlap"), "rank")


def citation_summary(papers: DataFrame) -> DataFrame:
    return papers.agg(
        F.sum("citation_count").alias("total_citations"), F.round(F.avg("citation_count"), 1).alias("mean_citations"),
        F.sum("influential_citations").alias("influential"), F.round(F.avg("reference_count"), 1).alias("mean_references"),
    )


def top_cited(papers: DataFrame, top: int = 10) -> DataFrame:
    return papers.filter("citation_count > 0").orderBy(F.desc("citation_count"), "ord").limit(top).select("ord", "title", "citation_count")


def publications_per_year(papers: DataFrame) -> DataFrame:
    return papers.filter("year is not null and year <> 0").groupBy("year").agg(F.count("*").alias("n"))


def value_counts(values: DataFrame, name: str, top: int | None = None) -> DataFrame:
    counts = values.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), name).limit(top)


def top_journals(papers: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(papers.select("journal"), "journal", top)


def top_authors(papers: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(papers.select(F.explode("authors").alias("author")), "author", top)


def keyword_frequency(papers: DataFrame, top: int = 15) -> DataFrame:
    return value_counts(papers.select(F.explode(F.transform("keywords", F.lower)).alias("keyword")), "keyword", top)


def open_access_share(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_if("is_open_access").alias("open"), F.count_if(~F.col("is_open_access")).alias("closed"))


def citation_histogram(papers: DataFrame, nbins: int = 20) -> DataFrame:
    """(bin, n): equal-width bins from the lowest to the highest count."""
    known = papers.filter("citation_count is not null").select("citation_count")
    ends = F.broadcast(known.agg(F.min("citation_count").alias("lo"), F.max("citation_count").alias("hi")))
    place = F.least(F.floor((F.col("citation_count") - F.col("lo")) * nbins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(nbins - 1))
    return known.crossJoin(ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def source_breakdown(papers: DataFrame) -> DataFrame:
    return value_counts(papers.select(F.explode(F.transform(F.split("source", ","), lambda x: F.trim(x))).alias("source")), "source")


def result_metrics(papers: DataFrame) -> DataFrame:
    sources = F.count_distinct(F.coalesce("source", F.lit("")))
    return papers.agg(
        F.count("*").alias("total"), F.count_if("is_open_access").alias("open_access"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.count("*") / sources, 4).alias("mean_per_source"),
    )


def split_by_source(papers: DataFrame) -> dict[str, DataFrame]:
    return {s: papers.filter(F.col("source") == s) for s in SOURCES}
