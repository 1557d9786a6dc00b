"""Queries of the source scans (S): payloads in each source's shape are landed from the tables, then conformed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex import adapters as A
from evidex.operators.graph import shared_folder
from evidex.sources import papers as P

QUERIES, SQL = {}, {}
#: Items of a landed payload, as one page of a service's answer.
PAGE = 50


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        SQL[name] = A.with_views(sql, *views)
        return f

    return add


def folder(spark) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def land(rows: DataFrame, key: str, item: Column, wrap) -> str:
    """One JSON file for each page of items; ``wrap`` puts the array of items where the source has it."""
    pages = rows.groupBy((F.col(key) / PAGE).cast("long").alias("page")).agg(F.collect_list(item).alias("items"))
    path = folder(rows.sparkSession)
    pages.select(F.to_json(wrap(F.col("items"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def named(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n.replace("__", "-")) for n, c in fields.items()])


_NUMBER = "case when ord % 10 = 0 then 'n.d.' else cast(year as string) end"
#: Authors of two names or more come back as the first two.
_PEOPLE = "list_transform(authors, lambda a: split_part(a, ' ', 1) || ' ' || split_part(a, ' ', 2)) as authors"
_TITLE = "coalesce(nullif(trim(title), ''), '(untitled)') as title"


@query("s01_scan_pubmed_xml", f"select cast(ord as varchar) as pmid, {_TITLE}, case when ord % 10 <> 0 then year end as year, doi, pmcid, {_PEOPLE}, publication_type || ', Article' as publication_type, pmcid is not null as is_open_access, keywords as mesh_terms, md5(trim(trim(regexp_replace(abstract, '\\s+', ' ', 'g')) || ' End of ' || ord)) as abstract from papers", "papers")
def _(s, d):
    p = A.papers(s, d)
    ids = F.array_compact(F.array(F.when(F.col("doi").isNotNull(), named(_VALUE="doi", _IdType=F.lit("doi"))), F.when(F.col("pmcid").isNotNull(), named(_VALUE="pmcid", _IdType=F.lit("pmc")))))
    people = F.transform("authors", lambda a: F.struct(F.substring_index(a, " ", -1).alias("LastName"), F.substring_index(a, " ", 1).alias("ForeName")))
    parts = F.array(named(_VALUE="abstract", _Label=F.lit("BACKGROUND")), named(_VALUE=F.concat(F.lit("End of "), F.col("ord").cast("string")), _Label=F.lit("END")))
    article = named(
        ArticleTitle="title", Abstract=named(AbstractText=parts), AuthorList=named(Author=people), Journal=named(Title="journal", JournalIssue=named(PubDate=named(Year=F.expr(_NUMBER)))),
        PublicationTypeList=named(PublicationType=F.array(named(_VALUE="publication_type", _UI=F.lit("a")), named(_VALUE=F.lit("Article"), _UI=F.lit("b")))),
    )
    citation = named(PMID=named(_VALUE=F.col("ord").cast("string"), _Version=F.lit("1")), Article=article, MeshHeadingList=named(MeshHeading=F.transform("keywords", lambda k: F.struct(F.struct(k.alias("_VALUE"), F.lit("d").alias("_UI")).alias("DescriptorName")))))
    path = folder(s)
    p.select(citation.alias("MedlineCitation"), named(ArticleIdList=named(ArticleId=ids)).alias("PubmedData")).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    return P.scan_pubmed_xml(s, path).select("pmid", "title", "year", "doi", "pmcid", "authors", "publication_type", "is_open_access", "mesh_terms", F.md5(F.trim(F.regexp_replace("abstract", r"\s+", " "))).alias("abstract"))


@query("s03_scan_europepmc_json", f"select doi, pmid, {_TITLE}, authors, case when ord % 10 <> 0 then year end as year, citation_count, is_open_access, abstract from papers", "papers")
def _(s, d):
    item = named(title="title", authorString=F.concat(F.array_join("authors", ", "), F.lit(", ")), pubYear=F.expr(_NUMBER), doi="doi", pmid="pmid", citedByCount=F.col("citation_count").cast("string"), isOpenAccess=F.when(F.col("is_open_access"), "Y").otherwise("N"), abstractText="abstract")
    path = land(A.papers(s, d), "ord", item, lambda x: named(resultList=named(result=x)))
    return P.scan_europepmc_json(s, path).select("doi", "pmid", "title", "authors", "year", "citation_count", "is_open_access", "abstract")


@query("s04_scan_crossref_json", "select doi, trim(title || ' ' || ord) as title, " + _PEOPLE + ", year, journal, citation_count, reference_count, md5(abstract) as abstract from papers", "papers")
def _(s, d):
    people = F.transform("authors", lambda a: F.struct(F.substring_index(a, " ", 1).alias("given"), F.substring_index(a, " ", -1).alias("family")))
    date = named(**{"date__parts": F.array(F.array("year"))})
    item = F.struct(
        F.array(F.coalesce("title", F.lit("")), F.col("ord").cast("string")).alias("title"), F.col("abstract").alias("abstract"), F.array("journal").alias("container-title"), people.alias("author"), F.when(F.col("ord") % 2 == 0, date).alias("published-print"),
        F.when(F.col("ord") % 2 == 1, date).alias("published-online"), F.col("doi").alias("DOI"), F.col("citation_count").alias("is-referenced-by-count"), F.col("reference_count").alias("references-count"),
    )
    path = land(A.papers(s, d), "ord", item, lambda x: named(message=named(items=x)))
    return P.scan_crossref_json(s, path).select("doi", "title", "authors", "year", "journal", "citation_count", "reference_count", F.md5("abstract").alias("abstract"))


@query("s05_scan_semantic_scholar_json", f"select doi, pmid, {_TITLE}, year, citation_count, influential_citations, reference_count, keywords, pdf_url, authors, md5(abstract) as abstract from papers", "papers")
def _(s, d):
    item = named(title="title", abstract="abstract", authors=F.transform("authors", lambda a: F.struct(a.alias("name"))), year="year", externalIds=named(DOI="doi", PubMed="pmid"), citationCount="citation_count", influentialCitationCount="influential_citations", referenceCount="reference_count", fieldsOfStudy="keywords", openAccessPdf=F.when(F.col("pdf_url").isNotNull(), named(url="pdf_url")))
    path = land(A.papers(s, d), "ord", item, lambda x: named(data=x))
    return P.scan_semantic_scholar_json(s, path).select("doi", "pmid", "title", "year", "citation_count", "influential_citations", "reference_count", "keywords", "pdf_url", "authors", F.md5("abstract").alias("abstract"))


@query("s06_scan_openalex_json", f"select doi, {_TITLE}, year, citation_count, journal, list_transform(range(0, least(ord % 12, 8)), lambda i: 'c' || i) as keywords, is_open_access from papers", "papers")
def _(s, d):
    concepts = F.when(F.col("ord") % 12 > 0, F.transform(F.sequence(F.lit(0), (F.col("ord") % 12 - 1).cast("int")), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("display_name"))))
    item = named(title="title", doi=F.concat(F.lit("https://doi.org/"), "doi"), publication_year="year", cited_by_count="citation_count", primary_location=named(source=named(display_name="journal")), concepts=concepts, open_access=named(is_oa="is_open_access"))
    path = land(A.papers(s, d), "ord", item, lambda x: named(results=x))
    return P.scan_openalex_json(s, path).select("doi", "title", "year", "citation_count", "journal", "keywords", "is_open_access")


@query("s07_scan_doaj_json", f"select doi, {_TITLE}, year, journal, keywords, pdf_url as url, true as is_open_access, md5(abstract) as abstract from papers", "papers")
def _(s, d):
    idents = F.array_compact(F.array(named(type=F.lit("issn"), id=F.lit("1")), F.when(F.col("doi").isNotNull(), named(type=F.lit("doi"), id=F.lit("first"))), F.when(F.col("doi").isNotNull(), named(type=F.lit("doi"), id="doi"))))
    links = F.array_compact(F.array(F.when(F.col("pdf_url").isNotNull(), named(type=F.lit("fulltext"), url="pdf_url"))))
    item = named(bibjson=named(title="title", abstract="abstract", year=F.col("year").cast("string"), journal=named(title="journal"), keywords="keywords", identifier=idents, link=links))
    path = land(A.papers(s, d), "ord", item, lambda x: named(results=x))
    return P.scan_doaj_json(s, path).select("doi", "title", "year", "journal", "keywords", "url", "is_open_access", F.md5("abstract").alias("abstract"))


@query("s08_scan_preprint_json", f"select {_TITLE}, abstract, authors, cast(year(dt) as int) as year, doi, keywords from (select *, date '2024-01-01' + cast(ord % 400 as int) as dt from papers) where dt between date '2024-12-01' - 180 and date '2024-12-01' and (contains(lower(title || ' ' || abstract), 'thand') or contains(lower(title || ' ' || abstract), 'quell'))", "papers")
def _(s, d):
    date = F.date_format(F.expr("date_add(date'2024-01-01', cast(ord % 400 as int))"), "yyyy-MM-dd")
    item = named(title="title", abstract="abstract", date=date, authors=F.array_join("authors", "; "), doi="doi", category=F.element_at("keywords", 1))
    path = land(A.papers(s, d), "ord", item, lambda x: named(collection=x))
    return P.scan_preprint_json(s, path, "biorxiv", "thand quell", "2024-12-01").select("title", "abstract", "authors", "year", "doi", "keywords")


@query("s09_scan_compound_properties_json", "select compound_id, mw as \"MolecularWeight\", case when compound_id % 5 <> 0 then logp end as \"XLogP\", hbd as \"HBondDonorCount\", coalesce(nullif(case when compound_id % 3 > 0 then name end, ''), 'N/A') as \"IUPACName\", cast(least(compound_id % 30, 20) as int) as n_synonyms, case when compound_id % 4 = 0 then 'No description available.' else brand end as description from compounds", "compounds")
def _(s, d):
    synonyms = F.when(F.col("compound_id") % 30 > 0, F.transform(F.sequence(F.lit(1), (F.col("compound_id") % 30).cast("int")), lambda i: i.cast("string")))
    item = named(
        CID=F.col("compound_id").cast("string"), MolecularWeight=F.col("mw").cast("string"), XLogP=F.when(F.col("compound_id") % 5 == 0, "bad").otherwise(F.col("logp").cast("string")), HBondDonorCount=F.col("hbd").cast("string"),
        IUPACName=F.when(F.col("compound_id") % 3 > 0, F.col("name")), Synonyms=synonyms, Descriptions=F.array(named(Description=F.lit(None).cast("string")), named(Description=F.when(F.col("compound_id") % 4 != 0, F.col("brand")))),
    )
    path = land(A.compounds(s, d), "compound_id", item, lambda x: named(PropertyTable=named(Properties=x)))
    return P.scan_compound_properties_json(s, path).select("compound_id", "MolecularWeight", "XLogP", "HBondDonorCount", "IUPACName", F.size("synonyms").alias("n_synonyms"), "description")


@query("s10_read_embedding_store", "select cast(id as varchar) as embedding_id, cast(source_id as varchar) as source_id, source_type, case when id % 3 = 0 then 0 else chunk_index end as chunk_index, len(vector) as dims, case when id % 2 = 0 then 0 else 1 end as n_extra from store", "store")
def _(s, d):
    e = A.store(s, d)
    meta = named(source_id=F.col("source_id").cast("string"), source_type="source_type", chunk_index=F.when(F.col("id") % 3 != 0, F.col("chunk_index")), extra=F.when(F.col("id") % 2 != 0, F.create_map(F.lit("k"), F.lit("v"))))
    item = named(embedding_id=F.col("id").cast("string"), vector="vector", model_name=F.lit("m"), created_at=F.lit("2024-01-01T00:00:00Z"), metadata=meta)
    path = land(e, "id", item, lambda x: x)
    return P.read_embedding_store(s, path).select("embedding_id", "source_id", "source_type", "chunk_index", F.size("vector").cast("long").alias("dims"), F.size("extra").alias("n_extra"))
