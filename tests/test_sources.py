"""Conform steps over small landed payloads, and file round trips."""

import json

import pytest
from pyspark.sql import functions as F

from evidex.sources import papers as P
from evidex.sources import sinks

PUBMED = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">111</PMID><Article><ArticleTitle>Alpha</ArticleTitle><Abstract><AbstractText Label="A">One.</AbstractText><AbstractText Label="B"> </AbstractText><AbstractText Label="C">Two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName><AffiliationInfo><Affiliation>Here</Affiliation></AffiliationInfo></Author><Author><LastName>Roe</LastName><AffiliationInfo><Affiliation>Here</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<Journal><Title>J</Title><JournalIssue><Volume>1</Volume><Issue>2</Issue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType UI="x">Review</PublicationType><PublicationType UI="y">Letter</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="d">Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">112</PMID><Article><Journal><JournalIssue><PubDate><Year>n.d.</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def write(tmp_path, name, value):
    p = tmp_path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_pubmed_xml(spark, tmp_path):
    got = {r["pmid"]: r for r in rows(P.scan_pubmed_xml(spark, write(tmp_path, "a.xml", PUBMED)))}
    a = got["111"]
    assert (a["title"], a["abstract"], a["authors"], a["affiliations"], a["year"], a["doi"], a["pmcid"]) == ("Alpha", "One. Two.", ["Jo Doe", "Roe"], ["Here"], 2020, "10.1/a", "PMC9")
    assert a["mesh_terms"] == ["Mice"] and a["publication_type"] == "Review, Letter" and a["is_open_access"]
    b = got["112"]
    assert b["title"] == "(untitled)" and b["year"] is None and b["authors"] == [] and not b["is_open_access"]


def test_europepmc(spark, tmp_path):
    v = {"resultList": {"result": [{"title": "T", "authorString": "A B, C D, ", "pubYear": "2019", "citedByCount": "7", "isOpenAccess": "Y", "pmid": "1"}, {"title": None, "citedByCount": "x"}]}}
    a, b = rows(P.scan_europepmc_json(spark, write(tmp_path, "e.json", v)))
    assert (a["title"], a["authors"], a["year"], a["citation_count"], a["is_open_access"]) == ("T", ["A B", "C D"], 2019, 7, True)
    assert b["title"] == "(untitled)" and b["citation_count"] is None and b["is_open_access"] is False


def test_crossref(spark, tmp_path):
    v = {"message": {"items": [{"title": ["X", "Y"], "container-title": ["J"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-online": {"date-parts": [[2018, 1]]}, "DOI": "10.2/b"}]}}
    (a,) = rows(P.scan_crossref_json(spark, write(tmp_path, "c.json", v)))
    assert (a["title"], a["journal"], a["authors"], a["year"], a["doi"]) == ("X Y", "J", ["A B", "C"], 2018, "10.2/b")


def test_semantic_scholar(spark, tmp_path):
    v = {"data": [{"title": "T", "externalIds": {"DOI": "d", "PubMed": "5"}, "citationCount": 3, "influentialCitationCount": 1, "referenceCount": 9, "fieldsOfStudy": ["Bio"], "openAccessPdf": {"url": "u"}, "authors": [{"name": "N"}]}]}
    (a,) = rows(P.scan_semantic_scholar_json(spark, write(tmp_path, "s.json", v)))
    assert (a["doi"], a["pmid"], a["citation_count"], a["influential_citations"], a["reference_count"], a["keywords"], a["pdf_url"], a["authors"]) == ("d", "5", 3, 1, 9, ["Bio"], "u", ["N"])


def test_openalex(spark, tmp_path):
    v = {"results": [{"title": "T", "doi": "https://doi.org/10.3/c", "publication_year": 2021, "concepts": [{"display_name": str(k)} for k in range(12)], "open_access": {"is_oa": True}, "primary_location": {"source": {"display_name": "J"}}}]}
    (a,) = rows(P.scan_openalex_json(spark, write(tmp_path, "o.json", v)))
    assert a["doi"] == "10.3/c" and a["keywords"] == [str(k) for k in range(8)] and a["journal"] == "J" and a["is_open_access"]


def test_doaj(spark, tmp_path):
    v = {"results": [{"bibjson": {"title": "T", "year": "2017", "identifier": [{"type": "doi", "id": "a"}, {"type": "doi", "id": "b"}], "link": [{"type": "fulltext", "url": "u"}], "author": [{"name": "N"}]}}]}
    (a,) = rows(P.scan_doaj_json(spark, write(tmp_path, "d.json", v)))
    assert a["doi"] == "b" and a["url"] == "u" and a["year"] == 2017 and a["is_open_access"]


def test_preprints(spark, tmp_path):
    v = {"collection": [{"title": "Kinase work", "abstract": "x", "date": "2024-05-01", "authors": "A; B", "doi": "d"}, {"title": "Old kinase", "date": "2020-01-01"}, {"title": "Other", "abstract": "none", "date": "2024-05-02"}]}
    (a,) = rows(P.scan_preprint_json(spark, write(tmp_path, "p.json", v), "biorxiv", "kinase inhibitors", "2024-06-01"))
    assert (a["title"], a["authors"], a["year"], a["publication_type"], a["source"]) == ("Kinase work", ["A", "B"], 2024, "Preprint", "biorxiv")


def test_compound_properties(spark, tmp_path):
    v = {"PropertyTable": {"Properties": [{"CID": 1, "MolecularWeight": "180.16", "XLogP": "bad", "HBondDonorCount": 2, "Synonyms": [str(k) for k in range(30)], "Descriptions": [{"Description": None}, {"Description": "D"}]}, {"CID": 2}]}}
    a, b = rows(P.scan_compound_properties_json(spark, write(tmp_path, "q.json", v)))
    assert (a["MolecularWeight"], a["XLogP"], a["HBondDonorCount"], len(a["synonyms"]), a["description"], a["MolecularFormula"]) == (180.16, None, 2, 20, "D", "N/A")
    assert b["description"] == P.NO_DESCRIPTION and b["synonyms"] == []


def test_embedding_store(spark, tmp_path):
    v = [{"embedding_id": "e1", "vector": [1.0, 2.0], "metadata": {"source_id": "s"}}, {"embedding_id": "e2", "vector": [3.0], "metadata": {"source_id": "s", "chunk_index": 4, "extra": {"k": "v"}}}]
    a, b = rows(P.read_embedding_store(spark, write(tmp_path, "st.json", v)))
    assert (a["chunk_index"], a["extra"], b["chunk_index"], b["extra"]) == (0, {}, 4, {"k": "v"})
    assert P.read_embedding_store(spark, write(tmp_path, "none.json", "")).count() == 0
    with pytest.raises(Exception):
        P.read_embedding_store(spark, write(tmp_path, "bad.json", "[{")).collect()


def test_upsert_store(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(path)
    sinks.upsert_embedding_store(spark.createDataFrame([(2, "b")], "id long, v string"), path)
    for bad in ([(2, "c")], [(5, "x"), (5, "y")]):
        with pytest.raises(ValueError):
            sinks.upsert_embedding_store(spark.createDataFrame(bad, "id long, v string"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"}, ' say "hi", \n')], "ord int, authors array<string>, m map<string,string>, t string")
    sinks.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False).first()
    assert (back.authors, back.m, back.t) == ("a; b", '{"k":"v"}', ' say "hi", \n')
    sinks.export_graph_node_link(spark.createDataFrame([("a", ["x"])], "id string, labels array<string>"), spark.createDataFrame([("a", "b", "r", 0.5)], "src string, dst string, relation string, confidence double"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/links")).first().key == "r"
    assert sinks.scalar_attributes(df).select(F.col("authors")).first()[0] == '["a","b"]'
