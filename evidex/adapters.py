"""Domain tables as views of the given tables: papers, compounds, graph, store, messages, tasks and others.

Each view is a projection or one aggregation, so filters and column pruning reach the Parquet scan.
``SQL`` holds the same definitions for DuckDB, as bodies of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nine literature sources.
SOURCES = ("pubmed", "pmc", "europepmc", "crossref", "semantic_scholar", "openalex", "doaj", "biorxiv", "medrxiv")
TYPES = ("Journal Article", "Review", "Clinical Trial", "Preprint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _array(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literature table of ``documents``: ord, title, abstract, keys, year, counts, authors and flags."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as ord",
        "substring_index(text, '\n', 1) as title",
        "text as abstract",
        f"element_at(array({_array(SOURCES)}), cast(doc_id % 9 as int) + 1) as source",
        "case when doc_id % 5 < 2 then concat('10.1/', doc_id div 2) end as doi",
        "case when doc_id % 5 = 2 then cast(doc_id div 3 as string) end as pmid",
        "case when doc_id % 3 = 0 then concat('PMC', doc_id) end as pmcid",
        "case when doc_id % 11 <> 0 then cast(2000 + doc_id % 25 as int) end as year",
        "case when doc_id % 7 <> 0 then cast(doc_id * 37 % 700 as int) end as citation_count",
        "case when doc_id % 4 <> 0 then cast(doc_id % 13 as int) end as influential_citations",
        "case when doc_id % 6 <> 0 then cast(doc_id % 60 as int) end as reference_count",
        "doc_id % 3 = 0 as is_open_access",
        "source as journal",
        "array(concat('Ann Author', doc_id % 50), concat('Bob Writer', doc_id * 7 % 50)) as authors",
        f"element_at(array({_array(TYPES)}), cast(doc_id % 4 as int) + 1) as publication_type",
        "array(lang) as keywords",
        "case when doc_id % 6 = 1 then concat('http://x/', doc_id, '.pdf') end as pdf_url",
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (supplier), verb (return flag), object (part name), confidence, source (order), ts."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_discount", "l_orderkey", "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr("s_name as subject", "l_returnflag as verb", "p_name as object", "round(l_discount * 10, 6) as confidence", "cast(l_orderkey as string) as source", "cast(l_shipdate as timestamp) as ts")


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relations`` and the relations between parts, brands, types, suppliers, nations and regions."""
    part = table(spark, sf_dir, "part")
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    fixed = ["1.0D as confidence", "'catalog' as source", "timestamp'2024-01-01 00:00:00' as ts"]
    has_brand = part.selectExpr("p_name as subject", "'has_brand' as verb", "p_brand as object", *fixed).distinct()
    has_type = part.selectExpr("p_brand as subject", "'has_type' as verb", "p_type as object", *fixed).distinct()
    located = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_name as subject", "'located_in' as verb", "n_name as object", *fixed)
    part_of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_name as subject", "'part_of' as verb", "r_name as object", *fixed)
    return relations(spark, sf_dir).union(has_brand).union(has_type).union(located).union(part_of)


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor columns of ``part``."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as compound_id",
        "p_name as name",
        "p_brand as brand",
        "p_type as kind",
        "round(100 + p_retailprice % 600, 6) as mw",
        "cast(p_size % 11 - 2 as double) as logp",
        "cast(p_size * 3 as double) as tpsa",
        "cast(p_partkey % 8 as int) as hbd",
        "cast(p_partkey % 14 as int) as hba",
        "cast(p_size % 13 as int) as rot",
        "case when p_partkey % 17 <> 0 then (p_partkey % 100) / 100D end as qed",
    )


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(compound_id, bit): distinct suppliers of each part, as set bits of its fingerprint."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey as compound_id", "l_suppkey as bit").distinct()


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(compound_id, rule, match_count): lines of a part by supplier modulo 8."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as compound_id", "cast(l_suppkey % 8 as int) as rule")
    return line.groupBy("compound_id", "rule").agg(F.count("*").alias("match_count"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(compound_id, n_alerts): distinct orders modulo 5 of a part's returned lines."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_partkey as compound_id", "l_orderkey % 5 as alert")
    return line.distinct().groupBy("compound_id").agg(F.count("*").alias("n_alerts"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding store: id, source_id, chunk_index, source_type, vector."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "vec_id div 2 as source_id", "cast(vec_id % 2 as int) as chunk_index", "cast(label as string) as source_type", "embedding as vector")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as id", "conv_id as conversation_id", "turn", "role", "text as content", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, conv_id, turn, 0) as created_at"
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks; each depends on the customer's order before it."""
    status = "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end as status"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as task_id", "o_custkey as request_id", "o_orderpriority as agent", status, "cast(o_orderdate as timestamp) as created_at", "o_totalprice as amount",
        "lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dependency",
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type as component", "value as latency", "event_type <> 'error' as success", "user_id", "cast(ts as timestamp) as ts")


SQL = {
    "papers": f"""select doc_id as ord, split_part(text, chr(10), 1) as title, text as abstract,
  ([{_array(SOURCES)}])[doc_id % 9 + 1] as source,
  case when doc_id % 5 < 2 then '10.1/' || (doc_id // 2) end as doi,
  case when doc_id % 5 = 2 then cast(doc_id // 3 as varchar) end as pmid,
  case when doc_id % 3 = 0 then 'PMC' || doc_id end as pmcid,
  case when doc_id % 11 <> 0 then cast(2000 + doc_id % 25 as int) end as year,
  case when doc_id % 7 <> 0 then cast(doc_id * 37 % 700 as int) end as citation_count,
  case when doc_id % 4 <> 0 then cast(doc_id % 13 as int) end as influential_citations,
  case when doc_id % 6 <> 0 then cast(doc_id % 60 as int) end as reference_count,
  doc_id % 3 = 0 as is_open_access, source as journal,
  ['Ann Author' || (doc_id % 50), 'Bob Writer' || (doc_id * 7 % 50)] as authors,
  ([{_array(TYPES)}])[doc_id % 4 + 1] as publication_type, [lang] as keywords,
  case when doc_id % 6 = 1 then 'http://x/' || doc_id || '.pdf' end as pdf_url
from documents""",
    "relations": """select s_name as subject, l_returnflag as verb, p_name as object, round(l_discount * 10, 6) as confidence, cast(l_orderkey as varchar) as source, l_shipdate as ts
from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "graph_relations": """select * from relations
union all select distinct p_name, 'has_brand', p_brand, 1.0, 'catalog', timestamp '2024-01-01' from part
union all select distinct p_brand, 'has_type', p_type, 1.0, 'catalog', timestamp '2024-01-01' from part
union all select s_name, 'located_in', n_name, 1.0, 'catalog', timestamp '2024-01-01' from supplier join nation on s_nationkey = n_nationkey
union all select n_name, 'part_of', r_name, 1.0, 'catalog', timestamp '2024-01-01' from nation join region on n_regionkey = r_regionkey""",
    "compounds": """select p_partkey as compound_id, p_name as name, p_brand as brand, p_type as kind, round(100 + p_retailprice % 600, 6) as mw,
  cast(p_size % 11 - 2 as double) as logp, cast(p_size * 3 as double) as tpsa, cast(p_partkey % 8 as int) as hbd, cast(p_partkey % 14 as int) as hba,
  cast(p_size % 13 as int) as rot, case when p_partkey % 17 <> 0 then (p_partkey % 100) / 100.0::double end as qed from part""",
    "bits": "select distinct l_partkey as compound_id, l_suppkey as bit from lineitem",
    "matches": "select l_partkey as compound_id, cast(l_suppkey % 8 as int) as rule, count(*) as match_count from lineitem group by all",
    "alerts": "select l_partkey as compound_id, count(distinct l_orderkey % 5) as n_alerts from lineitem where l_returnflag = 'R' group by all",
    "store": "select vec_id as id, vec_id // 2 as source_id, cast(vec_id % 2 as int) as chunk_index, cast(label as varchar) as source_type, embedding::double[] as vector from embeddings",
    "messages": "select conv_id * 1000 + turn as id, conv_id as conversation_id, turn, role, text as content, timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as created_at from conversations",
    "tasks": """select o_orderkey as task_id, o_custkey as request_id, o_orderpriority as agent,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end as status, o_orderdate as created_at, o_totalprice as amount,
  lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dependency from orders""",
    "latencies": "select event_id, event_type as component, value as latency, event_type <> 'error' as success, user_id, ts from events",
}


def with_views(query: str, *views: str) -> str:
    """``query`` behind the views that it names."""
    bodies = ",\n".join(f"{v} as (\n{SQL[v]}\n)" for v in views)
    joined = query.lstrip()
    if joined.lower().startswith("with recursive "):
        return f"with recursive {bodies},\n{joined[15:]}"
    return f"with {bodies},\n{joined[5:]}" if joined.lower().startswith("with ") else f"with {bodies}\n{joined}"
