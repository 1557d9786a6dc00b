"""Exports: flat and nested files, bibliography entries, graph files, rankings and the embedding store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.sources.store import is_store, upsert_store


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings joined by "; ", other nested columns as JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.concat_ws("; ", c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    flat(df).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="overwrite")


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False, mode="overwrite")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def bibtex(papers: DataFrame) -> DataFrame:
    """(ord, entry): a BibTeX article for each paper."""
    last = F.coalesce(F.element_at(F.split(F.element_at("authors", 1), r"\s+"), -1), F.lit("anon"))
    key = F.regexp_replace(F.concat(F.when(F.size("authors") > 0, last).otherwise("anon"), _text("year")), "[^A-Za-z0-9]", "")
    people = F.when(F.size("authors") > 0, F.concat_ws(" and ", "authors")).otherwise("Unknown")
    entry = F.format_string("@article{%s,\n  title={%s},\n  author={%s},\n  journal={%s},\n  year={%s},\n  doi={%s}\n}", key, _text("title"), people, _text("journal"), _text("year"), _text("doi"))
    return papers.select("ord", entry.alias("entry"))


def ris(papers: DataFrame) -> DataFrame:
    """(ord, entry): a RIS record for each paper; lines of empty fields, and of columns that ``papers`` lacks, are left out."""
    line = lambda tag, c: F.when(_text(c) != "", F.concat(F.lit(f"{tag}  - "), _text(c)))
    more = [line(tag, c) for tag, c in (("VL", "volume"), ("SP", "pages")) if c in papers.columns]
    lines = F.concat(
        F.array(F.lit("TY  - JOUR")), F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)),
        F.array_compact(F.array(F.concat(F.lit("TI  - "), _text("title")), F.concat(F.lit("JO  - "), _text("journal")), line("PY", "year"), *more, line("DO", "doi"), line("AB", "abstract"))), F.array(F.lit("ER  - ")),
    )
    return papers.select("ord", F.concat_ws("\n", lines).alias("entry"))


def export_graph_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two JSON data sets, nodes and links, of a directed multigraph."""
    node_link(nodes, edges)[0].write.json(f"{path}/nodes", mode="overwrite")
    node_link(nodes, edges)[1].write.json(f"{path}/links", mode="overwrite")


def node_link(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("key"), *[c for c in edges.columns if c not in ("src", "dst", "relation", "source")])
    return nodes, links


def scalar_attributes(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that flat graph formats can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema.fields])


def ranking_rows(rankings: DataFrame, compounds: DataFrame, toxicity: DataFrame) -> DataFrame:
    """Rankings with their compound and, where there is one, its toxicity; those without a compound go."""
    tox = toxicity.select("compound_id", "toxicity_level", "toxicity_score")
    return rankings.join(compounds, "compound_id").join(tox, "compound_id", "left").orderBy("rank")


def ranking_sheet(rankings: DataFrame, compounds: DataFrame, toxicity: DataFrame, structure: str, status: Column, score: str = "composite") -> DataFrame:
    """The eleven columns of a ranking: rank, compound, name, structure, score, status, weight, lipophilicity,
    violations, toxicity level and score; numbers as text with fixed digits, a missing side as an empty one."""
    from evidex.operators.compounds import digits

    rows = ranking_rows(rankings, compounds, toxicity)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = lambda c, n: F.coalesce(digits(F.col(c), n), F.lit(""))
    return rows.select(
        "rank", "compound_id", text("name").alias("name"), text(structure).alias("structure"), shown(score, 3).alias("score"), F.coalesce(status, F.lit("pending")).alias("status"), shown("mw", 2).alias("mw"),
        shown("logp", 2).alias("logp"), text("violations").alias("violations"), text("toxicity_level").alias("toxicity_level"), shown("toxicity_score", 3).alias("toxicity_score"),
    )


def new_embeddings(new: DataFrame, stored: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with a reason): ids stored already or twice in the batch are rejected."""
    counts = new.groupBy(key).agg(F.count("*").alias("_n"))
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    marked = new.join(counts, key).join(known, key, "left")
    reason = F.when(F.col("_known"), "already stored").when(F.col("_n") > 1, "repeated in the batch")
    marked = marked.withColumn("reason", reason).drop("_n", "_known")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def upsert_embedding_store(new: DataFrame, path: str, key: str = "id", replace: bool = False, batch: str | None = None) -> int:
    """Adds a batch to a versioned store (see ``store``), whole or not at all; the version that has it.

    Rejected rows (see ``new_embeddings``) are an error, unless ``replace`` lets new rows take the place of
    stored ones. Of two writers with one key the second fails, and readers see one version. A plain
    Parquet folder is checked and appended to instead, without these guarantees, and has version 0.
    """
    spark = new.sparkSession
    if is_store(spark, path):
        return upsert_store(new, path, key, replace, batch)
    fresh, rejected = new_embeddings(new, spark.read.parquet(path), key)
    if replace or not rejected.isEmpty():
        raise ValueError("the batch has ids that are stored or repeated" if not replace else "rows of a plain folder can't be replaced")
    fresh.write.parquet(path, mode="append")
    return 0
