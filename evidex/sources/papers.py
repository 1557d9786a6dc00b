"""Landed payloads of the literature and compound sources, conformed to one table.

Every scan reads files that Spark opens and splits itself, by a schema that it infers or is given;
missing fields are null, and one malformed value never drops its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators.graph import cut

TEXT = "array<string>"
#: The columns that all sources have.
COLUMNS = {
    "title": "string", "authors": TEXT, "affiliations": TEXT, "journal": "string", "year": "int", "volume": "string", "issue": "string", "doi": "string", "pmid": "string",
    "pmcid": "string", "citation_count": "int", "influential_citations": "int", "reference_count": "int", "keywords": TEXT, "mesh_terms": TEXT, "abstract": "string",
    "publisher": "string", "publication_type": "string", "is_open_access": "boolean", "pdf_url": "string", "url": "string", "source": "string",
}
UNTITLED = "(untitled)"


def conform(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """``rows`` as papers: the given columns, and nulls (empty arrays) for the others."""
    out = []
    for name, kind in COLUMNS.items():
        c = F.lit(source) if name == "source" else columns.get(name)
        if c is None:
            c = F.array() if kind == TEXT else F.lit(None)
        c = c.try_cast(kind)
        out.append((F.coalesce(c, F.array().cast(TEXT)) if kind == TEXT else c).alias(name))
    return rows.select(*out)


def _json(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """One row ``r`` for each element of the array at ``items``; a payload that is no JSON gives none (see ``strict``)."""
    whole = spark.read.schema(f"{schema}, {CORRUPT} string").json(path, multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    return whole.select(F.explode(items).alias("r"))


#: Holds what isn't JSON.
CORRUPT = "_corrupt"


class MalformedPayload(ValueError):
    """A landed payload is no JSON."""


def strict(spark: SparkSession, path: str, scan: Callable[..., DataFrame], *args, **more) -> DataFrame:
    """``scan`` of a path whose payloads must all be JSON: one that isn't is an error, as from a source that fails."""
    whole = spark.read.schema(f"_any string, {CORRUPT} string").json(path, multiLine=True, columnNameOfCorruptRecord=CORRUPT)
    bad = cut(whole).filter(F.col(CORRUPT).isNotNull()).limit(1)
    if not bad.isEmpty():
        raise MalformedPayload(path)
    return scan(spark, path, *args, **more)


def _title(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNTITLED))


def scan_pmc_ids(ids: DataFrame, column: str) -> DataFrame:
    """Stub rows for article ids."""
    key = F.col(column).cast("string")
    return ids.select(
        F.col(column).alias("ord"), F.concat(F.lit("PMC Article "), key).alias("title"), key.alias("pmcid"), F.lit(True).alias("is_open_access"),
        F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), key, F.lit("/")).alias("url"),
    )


_PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,AffiliationInfo:array<struct<Affiliation:string>>>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string,_UI:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def scan_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """One paper for each PubmedArticle element."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(_PUBMED).load(path)
    a = F.col("MedlineCitation.Article")
    names = F.transform(F.filter(a["AuthorList"]["Author"], lambda p: F.coalesce(p["LastName"], F.lit("")) != ""), lambda p: F.trim(F.concat_ws(" ", p["ForeName"], p["LastName"])))
    places = F.array_distinct(F.filter(F.flatten(F.transform(a["AuthorList"]["Author"], lambda p: F.coalesce(F.transform(p["AffiliationInfo"], lambda x: x["Affiliation"]), F.array().cast(TEXT)))), lambda x: F.coalesce(x, F.lit("")) != ""))
    first = lambda kind: F.get(F.transform(F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == kind), lambda x: x["_VALUE"]), F.lit(0))
    return conform(
        rows, "pubmed", title=_title(a["ArticleTitle"]),
        abstract=F.concat_ws(" ", F.filter(F.transform(a["Abstract"]["AbstractText"], lambda t: t["_VALUE"]), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")),
        authors=names, affiliations=places, journal=a["Journal"]["Title"], year=a["Journal"]["JournalIssue"]["PubDate"]["Year"], volume=a["Journal"]["JournalIssue"]["Volume"],
        issue=a["Journal"]["JournalIssue"]["Issue"], doi=first("doi"), pmcid=first("pmc"), pmid=F.col("MedlineCitation.PMID._VALUE"),
        mesh_terms=F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"]["_VALUE"]),
        publication_type=F.concat_ws(", ", F.transform(a["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"])), is_open_access=F.coalesce(first("pmc"), F.lit("")) != "",
    )


def scan_europepmc_json(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<title:string,authorString:string,journalTitle:string,pubYear:string,doi:string,pmid:string,pmcid:string,citedByCount:string,isOpenAccess:string,abstractText:string,pubType:string>"
    r = lambda f: F.col("r." + f)
    people = F.filter(F.transform(F.split(r("authorString"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return conform(
        _json(spark, path, f"resultList struct<result:array<{item}>>", "resultList.result"), "europepmc", title=_title(r("title")), authors=people, journal=r("journalTitle"), year=r("pubYear"),
        doi=r("doi"), pmid=r("pmid"), pmcid=r("pmcid"), citation_count=r("citedByCount"), is_open_access=F.coalesce(r("isOpenAccess"), F.lit("")) == "Y", abstract=r("abstractText"), publication_type=r("pubType"),
    )


def scan_crossref_json(spark: SparkSession, path: str) -> DataFrame:
    item = (
        "struct<title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,"
        "`published-online`:struct<`date-parts`:array<array<int>>>,DOI:string,volume:string,issue:string,publisher:string,type:string,abstract:string,URL:string,`is-referenced-by-count`:int,`references-count`:int>"
    )
    r = lambda f: F.col("r")[f]
    year = lambda f: F.get(F.get(r(f)["date-parts"], F.lit(0)), F.lit(0))
    people = F.filter(F.transform(r("author"), lambda a: F.concat_ws(" ", a["given"], a["family"])), lambda x: x != "")
    return conform(
        _json(spark, path, f"message struct<items:array<{item}>>", "message.items"), "crossref", title=_title(F.concat_ws(" ", r("title"))), journal=F.concat_ws(" ", r("container-title")), authors=people,
        year=F.coalesce(year("published-print"), year("published-online")), doi=r("DOI"), volume=r("volume"), issue=r("issue"), publisher=r("publisher"), publication_type=r("type"), abstract=r("abstract"),
        url=r("URL"), citation_count=r("is-referenced-by-count"), reference_count=r("references-count"),
    )


def scan_semantic_scholar_json(spark: SparkSession, path: str) -> DataFrame:
    item = (
        "struct<title:string,abstract:string,year:int,venue:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string,PubMed:string>,citationCount:int,influentialCitationCount:int,"
        "referenceCount:int,fieldsOfStudy:array<string>,isOpenAccess:boolean,openAccessPdf:struct<url:string>,url:string>"
    )
    r = lambda f: F.col("r")[f]
    return conform(
        _json(spark, path, f"data array<{item}>", "data"), "semantic_scholar", title=_title(r("title")), abstract=r("abstract"), year=r("year"), journal=r("venue"), authors=F.transform(r("authors"), lambda a: a["name"]),
        doi=r("externalIds")["DOI"], pmid=r("externalIds")["PubMed"], citation_count=r("citationCount"), influential_citations=r("influentialCitationCount"), reference_count=r("referenceCount"),
        keywords=r("fieldsOfStudy"), is_open_access=F.coalesce(r("isOpenAccess"), F.lit(False)), pdf_url=r("openAccessPdf")["url"], url=r("url"),
    )


def scan_openalex_json(spark: SparkSession, path: str) -> DataFrame:
    item = (
        "struct<title:string,doi:string,publication_year:int,cited_by_count:int,type:string,id:string,primary_location:struct<source:struct<display_name:string>>,concepts:array<struct<display_name:string>>,"
        "open_access:struct<is_oa:boolean,oa_url:string>,authorships:array<struct<author:struct<display_name:string>>>>"
    )
    r = lambda f: F.col("r")[f]
    return conform(
        _json(spark, path, f"results array<{item}>", "results"), "openalex", title=_title(r("title")), doi=F.regexp_replace(r("doi"), "^https://doi.org/", ""), year=r("publication_year"), citation_count=r("cited_by_count"),
        publication_type=r("type"), url=r("id"), journal=r("primary_location")["source"]["display_name"], keywords=F.slice(F.transform(r("concepts"), lambda c: c["display_name"]), 1, 8),
        is_open_access=F.coalesce(r("open_access")["is_oa"], F.lit(False)), pdf_url=r("open_access")["oa_url"], authors=F.transform(r("authorships"), lambda a: a["author"]["display_name"]),
    )


def scan_doaj_json(spark: SparkSession, path: str) -> DataFrame:
    item = (
        "struct<bibjson:struct<title:string,abstract:string,year:string,journal:struct<title:string,publisher:string,volume:string,number:string>,author:array<struct<name:string>>,keywords:array<string>,"
        "identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string>>>>"
    )
    b = lambda f: F.col("r.bibjson")[f]
    last = lambda items, kind, field: F.get(F.reverse(F.transform(F.filter(items, lambda x: x["type"] == kind), lambda x: x[field])), F.lit(0))
    return conform(
        _json(spark, path, f"results array<{item}>", "results"), "doaj", title=_title(b("title")), abstract=b("abstract"), year=b("year"), journal=b("journal")["title"], publisher=b("journal")["publisher"],
        volume=b("journal")["volume"], issue=b("journal")["number"], authors=F.transform(b("author"), lambda a: a["name"]), keywords=b("keywords"), doi=last(b("identifier"), "doi", "id"),
        url=last(b("link"), "fulltext", "url"), is_open_access=F.lit(True),
    )


def preprint_match(rows: DataFrame, query: str, today: str, lookback_days: int = 180) -> DataFrame:
    """Rows (title, abstract, date) of the last days that hold any term of the query."""
    from evidex.operators.literature import query_terms

    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    hit = F.exists(F.array(*[F.lit(t) for t in query_terms(query)]), lambda t: F.contains(hay, t))
    end = F.to_date(F.lit(today))
    return rows.filter(F.col("date").between(F.date_sub(end, lookback_days), end) & hit)


def scan_preprint_json(spark: SparkSession, path: str, server: str, query: str, today: str, lookback_days: int = 180, max_results: int | None = None) -> DataFrame:
    item = "struct<title:string,abstract:string,date:string,authors:string,doi:string,category:string>"
    rows = _json(spark, path, f"collection array<{item}>", "collection").select("r.*").withColumn("date", F.col("date").try_cast("date"))
    rows = preprint_match(rows, query, today, lookback_days)
    rows = rows if max_results is None else rows.limit(max_results)
    people = F.filter(F.transform(F.split("authors", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return conform(rows, server, title=_title(F.col("title")), abstract=F.col("abstract"), authors=people, year=F.year("date"), doi=F.col("doi"), keywords=F.array("category"), publication_type=F.lit("Preprint"), is_open_access=F.lit(True))


#: Fields of a compound's property sheet, with their types.
PROPERTIES = {
    "MolecularFormula": "string", "MolecularWeight": "double", "CanonicalSMILES": "string", "IsomericSMILES": "string", "InChI": "string", "InChIKey": "string", "IUPACName": "string", "XLogP": "double",
    "ExactMass": "double", "TPSA": "double", "Complexity": "double", "HBondDonorCount": "int", "HBondAcceptorCount": "int", "RotatableBondCount": "int", "HeavyAtomCount": "int",
}
NO_DESCRIPTION = "No description available."


def scan_compound_properties_json(spark: SparkSession, path: str) -> DataFrame:
    """Property sheets: numbers that don't parse are null, missing text is "N/A", at most 20 synonyms."""
    fields = ",".join(f"{n}:string" for n in PROPERTIES)
    schema = f"PropertyTable struct<Properties:array<struct<CID:string,{fields},Synonyms:array<string>,Descriptions:array<struct<Description:string>>>>>"
    rows = _json(spark, path, schema, "PropertyTable.Properties").select("r.*")
    typed = [(F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("N/A")) if k == "string" else F.col(n).try_cast("double").try_cast(k)).alias(n) for n, k in PROPERTIES.items()]
    described = F.get(F.filter(F.transform("Descriptions", lambda x: x["Description"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    return rows.select(F.col("CID").try_cast("long").alias("compound_id"), *typed, F.slice(F.coalesce("Synonyms", F.array().cast(TEXT)), 1, 20).alias("synonyms"), F.coalesce(described, F.lit(NO_DESCRIPTION)).alias("description"))


_STORE = (
    "embedding_id string, vector array<float>, model_name string, created_at string, "
    "metadata struct<source_id:string,source_type:string,title:string,text:string,chunk_index:int,extra:map<string,string>>"
)


def read_embedding_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON store of embedding records, flat; malformed text is an error, an empty file an empty table."""
    rows = spark.read.schema(_STORE).json(path, multiLine=True, mode="FAILFAST").filter("embedding_id is not null")
    m = F.col("metadata")
    return rows.select(
        "embedding_id", m["source_id"].alias("source_id"), m["source_type"].alias("source_type"), m["title"].alias("title"), m["text"].alias("text"), F.coalesce(m["chunk_index"], F.lit(0)).alias("chunk_index"),
        F.coalesce(m["extra"], F.create_map().cast("map<string,string>")).alias("extra"), "vector", "model_name", F.try_to_timestamp("created_at").alias("created_at"),
    )
