"""Queries of text functions (T) and the literature corpus (L), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex import adapters as A
from evidex.functions import text as T
from evidex.operators import literature as L

QUERY, YEAR = "thand tion the", 2024


def docs(spark, sf):
    return A.table(spark, sf, "documents")


def _t(name, columns, sql):
    return name, lambda s, d: docs(s, d).select("doc_id", *[c().alias(n) for n, c in columns.items()]), f"select doc_id, {sql} from documents"


_NORM = r"nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')"
_SENT = r"string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"
_FIRST = "split_part(text, chr(10), 1)"


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def first_line():
    return F.substring_index("text", "\n", 1)


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
_DRUG = "(?i)^[A-Za-z]{3,}(mab|nib|prazole|statin|cillin|azole|olol|pril|sartan|vir|umab|ximab)$"
#: Up to five surroundings of each disease, disease after disease.
_NEAR = "flatten([" + ", ".join(rf"regexp_extract_all(text, '(?i)\b[A-Za-z0-9_\s]{{0,20}}{d}[A-Za-z0-9_\s]{{0,20}}\b')[1:5]" for d in T.DISEASES + T.DISEASES_MORE) + "])"


def _named(kind, compat=False):
    return F.coalesce(F.element_at(T.entities_context(F.col("text"), compat), kind), F.array().cast("array<string>"))


PROJECTIONS = [
    _t("t01_normalize_text", {"h": lambda: F.md5(T.normalize_text(F.col("text")))}, f"md5({_NORM}) as h"),
    _t("t02_text_hash", {"h": lambda: T.text_hash(F.col("text"))}, f"sha256({_NORM}) as h"),
    _t("t03_cache_key", {"k": lambda: T.cache_key("m1", F.col("text"))}, f"'m1:' || sha256({_NORM}) as k"),
    _t(
        "t05_paper_uid",
        {"uid": lambda: T.paper_uid(F.expr("case when doc_id % 5 < 2 then concat('10.1/', doc_id div 2) end"), F.lit(None).cast("string"), F.lit(""), first_line()), "k": lambda: T.title_key(first_line())},
        f"md5(coalesce(case when doc_id % 5 < 2 then '10.1/' || (doc_id // 2) end, substr(regexp_replace(lower({_FIRST}), '[^a-z0-9]', '', 'g'), 1, 120))) as uid, substr(regexp_replace(lower({_FIRST}), '[^a-z0-9]', '', 'g'), 1, 120) as k",
    ),
    _t("t07_truncate_text", {"t": lambda: T.truncate_text(F.col("text"), 80)}, "case when length(text) > 80 then substr(text, 1, 77) || '...' else text end as t"),
    _t("t12_extract_entities_context", {k: (lambda k=k: _named(k)) for k in ("genes", "drugs", "diseases")}, f"list_sort(list_distinct(list_filter({_TOKENS}, lambda x: length(x) >= 3 and regexp_matches(x, '^[A-Z][A-Z0-9]{{1,7}}[0-9]?$'))))[1:10] as genes, list_sort(list_distinct(list_filter({_TOKENS}, lambda x: regexp_matches(x, '{_DRUG}'))))[1:10] as drugs, list_sort(list_distinct(list_transform({_NEAR}, lambda x: trim(x))))[1:10] as diseases"),
    _t("t12_extract_entities_context_compat", {"drugs": lambda: _named("drugs", True)}, f"list_sort(list_distinct(list_transform(list_filter({_TOKENS}, lambda x: regexp_matches(x, '{_DRUG}')), lambda x: regexp_extract(x, '{_DRUG}', 1))))[1:10] as drugs"),
    _t("t13_split_sentences", {"n": lambda: F.size(T.split_sentences(F.col("text"))), "h": lambda: F.md5(F.array_join(T.split_sentences(F.col("text")), "|"))}, f"cast(len({_SENT}) as int) as n, md5(array_to_string({_SENT}, '|')) as h"),
    _t("t15_sentences_with_keywords", {"h": lambda: F.md5(T.sentences_with(F.col("text"), ("that", "from")))}, f"md5(array_to_string(list_filter({_SENT}, lambda s: contains(lower(s), 'that') or contains(lower(s), 'from')), ' ')) as h"),
    _t("t16_count_occurrences", {"n": lambda: T.count_occurrences(F.col("text"), "th")}, "cast((length(text) - length(replace(text, 'th', ''))) / 2 as int) as n"),
]
QUERIES = {n: f for n, f, _ in PROJECTIONS}
SQL = {n: s for n, _, s in PROJECTIONS}


def query(name, sql, *views):
    """Registers a query and its SQL behind the views that it reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = A.with_views(sql, *views) if views else sql
        return f

    return add


@query("t04_content_hash", "select o_orderkey, sha256('int:' || o_orderkey || '|str:' || o_orderstatus) as h, substr(sha256(o_orderstatus || '||' || o_orderpriority), 1, 16) as short from orders")
def _(s, d):
    o = A.table(s, d, "orders")
    return o.select("o_orderkey", T.content_hash(("int", F.col("o_orderkey")), ("str", F.col("o_orderstatus"))).alias("h"), T.short_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("short"))


@query("t06_chunk_text", f"select doc_id, cast(i as int) as chunk_index, md5(trim(substr(t, i * 900 + 1, 1000))) as h from (select doc_id, t, unnest(range(0, cast(ceil(greatest(length(t) - 1000, 0) / 900.0) as bigint) + 1)) as i from (select doc_id, {_NORM} as t from documents) where t is not null)")
def _(s, d):
    return T.chunk_text(docs(s, d), "text").select("doc_id", "chunk_index", F.md5("chunk").alias("h"))


@query("t08_snippet", "select conv_id, turn, case when length(trim(text)) > 160 then rtrim(substr(trim(text), 1, 159)) || '…' else trim(text) end as s from conversations")
def _(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text")).alias("s"))


@query(
    "t09_extract_keywords_4",
    f"""select doc_id, list(w order by n desc, p)[1:6] as keywords from (
  select doc_id, w, count(*) as n, min(p) as p from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from (select doc_id, regexp_extract_all(lower(text), '[a-zA-Z]{{4,}}') as ws from documents))
  where not list_contains({_list(T.STOP_4)}, w) group by doc_id, w) group by doc_id""",
)
def _(s, d):
    return T.extract_keywords_4(docs(s, d), "doc_id", "text")


@query(
    "t10_extract_keywords_generic",
    rf"""select doc_id, list(w order by n desc, p)[1:10] as keywords from (
  select doc_id, w, count(*) as n, min(p) as p from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from (
    select doc_id, regexp_split_to_array(regexp_replace(lower({_NORM}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+') as ws from documents))
  where length(w) >= 3 and not list_contains({_list(T.STOP_GENERAL)}, w) group by doc_id, w) group by doc_id""",
)
def _(s, d):
    return T.extract_keywords_generic(docs(s, d), "doc_id", "text")


@query(
    "t11_extract_entities_lexicon",
    rf"""select doc_id, list_sort(list_filter({_list(T.DISEASES)}, lambda x: contains(lower(text), x)))[1:10] as diseases,
  list_sort(list_filter(toks, lambda t: regexp_matches(t, '^[A-Z][A-Z0-9]{{1,7}}[0-9]?$') and length(t) <= 8))[1:10] as genes,
  list_sort(list_filter(toks, lambda t: regexp_matches(lower(t), '({"|".join(T.DRUG_SUFFIXES)})$')))[1:10] as drugs,
  list_sort(list_filter({_list(T.ORGANISMS)}, lambda x: contains(lower(text), x)))[1:5] as organisms
from (select doc_id, text, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda x: trim(x, '-')), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9-]{{2,}}$'))) as toks from documents)""",
)
def _(s, d):
    e = docs(s, d).select("doc_id", T.entities_lexicon(F.col("text")).alias("e"))
    return e.select("doc_id", *[F.col("e")[k].alias(k) for k in ("diseases", "genes", "drugs", "organisms")])


@query(
    "t14_summaries",
    rf"""select ord, md5(case when len(s) > 0 then s[1] else 'No abstract available for this paper.' end) as short, md5(case when len(s) > 0 then array_to_string(s[1:4], ' ') else 'No abstract available for this paper.' end) as detailed
from (select ord, list_filter(string_split(regexp_replace(trim(abstract), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) > 4) as s from papers)""",
    "papers",
)
def _(s, d):
    return T.summaries(A.papers(s, d)).select("ord", F.md5("short_summary").alias("short"), F.md5("detailed_summary").alias("detailed"))


LABEL_SQL = rf"""select {{key}}, n <> '' and length(n) <= 50 and not regexp_matches(n, '<[^>]+>') and not regexp_matches(lower(n), '{T._STATISTIC}') and not regexp_matches(n, '^[0-9.\-+%,/]+$')
  and regexp_matches(n, '[A-Za-z]') and not (words = 1 and (list_contains({_list(T.STOP_LABEL)}, bare) or length(bare) <= 2)) and words <= 6
  and length(regexp_replace(n, '[^\p{{{{L}}}}]', '', 'g')) >= greatest(2, length(n) * 0.4) as ok
from (select *, len(string_split(n, ' ')) as words, regexp_replace(lower(n), '^[.,;:()\[\]]+|[.,;:()\[\]]+$', '', 'g') as bare from ({{source}}))"""


@query("t17_is_meaningful_label", LABEL_SQL.format(key="doc_id", source=rf"select doc_id, coalesce(nullif(trim(regexp_replace({_FIRST}, '\s+', ' ', 'g')), ''), '') as n from documents"))
def _(s, d):
    return docs(s, d).select("doc_id", T.is_meaningful_label(first_line()).alias("ok"))


@query("t18_is_plausible_smiles", r"""select p_partkey, regexp_matches(t, '^[A-Za-z0-9@+\-\[\]()=#$:/\\.%~]+$') and not contains(t, ')(') as ok from (select p_partkey, trim(case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then 'C(' || p_size || ')[N]' else 'C)(' || p_size end) as t from part)""")
def _(s, d):
    t = F.expr("case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then concat('C(', p_size, ')[N]') else concat('C)(', p_size) end")
    return A.table(s, d, "part").select("p_partkey", T.is_plausible_smiles(t).alias("ok"))


@query("t19_clamp", "select l_orderkey, l_linenumber, least(greatest(l_tax * 20 - 0.3, 0), 1) as c, least(greatest(coalesce(try_cast(l_returnflag as double), 0.5), 0), 1) as conf from lineitem")
def _(s, d):
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.clamp(F.col("l_tax") * 20 - 0.3).alias("c"), T.to_confidence(F.col("l_returnflag")).alias("conf"))


@query("t20_score_to_confidence", "select compound_id, case when qed >= 0.85 then 'very_high' when qed >= 0.65 then 'high' when qed >= 0.4 then 'medium' else 'low' end as a, case when qed >= 0.9 then 'very_high' when qed >= 0.7 then 'high' when qed >= 0.4 then 'medium' else 'low' end as b, case when qed >= 0.85 then 0.925::double when qed >= 0.65 then 0.75 when qed >= 0.4 then 0.5 else 0.15 end as m from compounds", "compounds")
def _(s, d):
    a = T.score_to_confidence(F.col("qed"))
    return A.compounds(s, d).select("compound_id", a.alias("a"), T.score_to_confidence(F.col("qed"), T.ASSISTANT_SCALE).alias("b"), T.confidence_to_score(a).alias("m"))


@query("t21_safe_arithmetic", "select l_orderkey, l_linenumber, case when l_discount = 0 then 0 else l_tax / l_discount end as q, case when l_discount > 0 then ln(l_discount) else 0 end as l, case when l_discount - 0.05 >= 0 then sqrt(l_discount - 0.05) else 0 end as r from lineitem")
def _(s, d):
    x, y = F.col("l_tax"), F.col("l_discount")
    return A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.safe_divide(x, y).alias("q"), T.safe_log(y).alias("l"), T.safe_sqrt(y - 0.05).alias("r"))


@query("t24_parse_iso_timestamp", "select event_id, cast(floor(epoch(ts)) as bigint) as at, greatest(0, cast(epoch(timestamp '2024-01-15') as bigint) - cast(floor(epoch(ts)) as bigint)) as age from events")
def _(s, d):
    ts = T.parse_iso_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return A.table(s, d, "events").select("event_id", F.unix_timestamp(ts).alias("at"), T.age_seconds(ts, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("age"))


@query("t25_array_functions", "select vec_id, len(list_distinct(list_transform(embedding, lambda x: round(x, 1)))) as n, cast(ceil(len(embedding) / 10) as bigint) as runs, cast(len(embedding[61:]) as bigint) as last from embeddings")
def _(s, d):
    runs = T.chunked(F.col("embedding"), 10)
    n = F.size(T.dedupe_ordered(F.transform("embedding", lambda x: F.round(x, 1))))
    return A.table(s, d, "embeddings").select("vec_id", n.cast("long").alias("n"), F.size(runs).cast("long").alias("runs"), F.size(F.element_at(runs, -1)).cast("long").alias("last"))


@query("t27_validate_vector", "select vec_id, len(embedding) = 64 as a, len(embedding) = 63 as b from embeddings")
def _(s, d):
    return A.table(s, d, "embeddings").select("vec_id", T.validate_vector(F.col("embedding"), 64).alias("a"), T.validate_vector(F.col("embedding"), 63).alias("b"))


_KEYED = """keyed as (select *, coalesce(lower(doi), 'pmid:' || pmid) as key from papers),
merged as (select key, min(ord) as ord, first(title order by ord) filter (title <> '') as title, first(abstract order by ord) filter (abstract <> '') as abstract,
  first(year order by ord) filter (year is not null) as year, max(citation_count) as citation_count, array_to_string(list_sort(list_distinct(list(source))), ', ') as source,
  first(is_open_access order by ord) filter (is_open_access is not null) as is_open_access, first(keywords order by ord) as keywords, count(*) as n_merged from keyed where key is not null group by key)"""


@query("l01_dedupe_by_identifier", f"with {_KEYED} select ord, title, year, citation_count, source, n_merged from merged union all select ord, title, year, citation_count, source, 1 from keyed where key is null", "papers")
def _(s, d):
    merged, loose = L.dedupe_by_identifier(A.papers(s, d))
    cols = ["ord", "title", "year", "citation_count", "source", "n_merged"]
    return merged.select(cols).union(loose.withColumn("n_merged", F.lit(1).cast("long")).select(cols))


#: DuckDB's edit distance counts bytes, so letters beyond ASCII are first made capital ones.
_ONE_BYTE = "translate(lower({}), 'éèêàâçôûüäößñóíáúëïîùœæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
_A, _B = _ONE_BYTE.format("l.t"), _ONE_BYTE.format("m.title")
_TITLED = f"""{_KEYED},
loose as (select * from keyed where key is null),
near as (select l.t, min(m.ord) as target from (select distinct lower(title) as t from loose where title <> '') l join merged m on m.title <> '' and case when abs(length(l.t) - length(m.title)) <= 0.1 * greatest(length(l.t), length(m.title))
  then 1 - levenshtein({_A}, {_B}) / greatest(length(l.t), length(m.title)) > 0.9 else false end group by l.t),
rows as (select ord as target, ord, title, abstract, year, citation_count, source, is_open_access, keywords from merged
  union all select coalesce(target, ord), ord, title, abstract, year, citation_count, source, is_open_access, keywords from loose left join near on lower(title) = t),
whole as (select target, min(ord) as ord, first(title order by ord) filter (title <> '') as title, first(abstract order by ord) filter (abstract <> '') as abstract, first(year order by ord) filter (year is not null) as year,
  max(citation_count) as citation_count, array_to_string(list_sort(list_distinct(list(source))), ', ') as source, first(is_open_access order by ord) as is_open_access, first(keywords order by ord) as keywords from rows group by target)"""


@query("l02_dedupe_by_title", f"with {_TITLED} select ord, title, year, citation_count from whole", "papers")
def _(s, d):
    return L.dedupe_by_title(*L.dedupe_by_identifier(A.papers(s, d))).select("ord", "title", "year", "citation_count")


@query("l03_merge_papers", "select source, min(ord) as ord, first(doi order by ord) filter (doi is not null) as doi, first(pmid order by ord) filter (pmid is not null) as pmid, first(year order by ord) filter (year is not null) as year, max(citation_count) as citation_count, count(*) as n_merged from papers group by source", "papers")
def _(s, d):
    p = A.papers(s, d).withColumn("k", F.col("source"))
    return L.merge_papers(p, "k").select("source", "ord", "doi", "pmid", "year", "citation_count", "n_merged")


@query("l04_filter_papers", "select ord from papers where (year is null or year between 2005 and 2020) and contains(journal, 'src1') and list_bool_or(list_transform(authors, lambda a: contains(lower(a), 'author'))) and (pdf_url is not null or pmcid is not null) and not contains(substr(lower(abstract), 1, 400), 'animal')", "papers")
def _(s, d):
    return L.filter_papers(A.papers(s, d), 2005, 2020, journal="SRC1", author="author", full_text=True, human=True).select("ord")


_SCORE = """round(1.0::double * list_sum(list_transform(['thand', 'tion', 'the'], lambda t: (length(txt) - length(replace(txt, t, ''))) // length(t) + 3 * ((length(ttl) - length(replace(ttl, t, ''))) // length(t))))
  + 0.02::double * least(coalesce(citation_count, 0), 500) + case when year is null then 0 else 0.5::double * greatest(5 - (2024 - year), 0) end, 3)"""
_TEXTS = "select *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || array_to_string(keywords, ' ')) as txt, lower(coalesce(title, '')) as ttl from"


@query("l05_score_relevance", f"select ord, {_SCORE} as relevance_score from ({_TEXTS} papers)", "papers")
def _(s, d):
    return L.score_relevance(A.papers(s, d), QUERY, YEAR).select("ord", "relevance_score")


@query("l06_rank_papers", "select ord, row_number() over (order by coalesce(citation_count, 0) desc, ord) as rank from papers qualify rank <= 500", "papers")
def _(s, d):
    return L.rank_papers(A.papers(s, d), "citations", 500).select("ord", F.col("rank").cast("long").alias("rank"))


def search(s, d):
    return L.search_papers(A.papers(s, d), QUERY, YEAR, 50, year_from=2003, open_access=True).select("ord", "title", "year", "citation_count", "relevance_score", F.col("rank").cast("long").alias("rank"))


query(
    "l07_search_papers",
    f"with {_TITLED} select ord, title, year, citation_count, {_SCORE} as relevance_score, row_number() over (order by {_SCORE} desc, ord) as rank from ({_TEXTS} whole) where (year is null or year >= 2003) and is_open_access qualify rank <= 100",
    "papers",
)(search)


@query(
    "l09_find_similar_papers",
    """with terms as (select ord, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || abstract), '[a-zA-Z]{4,}'))) as term from papers)
select a.ord as target, b.ord, count(*) as overlap, row_number() over (partition by a.ord order by count(*) desc, b.ord) as rank from terms a join terms b using (term)
where a.ord % 20 = 0 and a.ord <> b.ord group by a.ord, b.ord qualify rank <= 5""",
    "papers",
)
def _(s, d):
    p = A.papers(s, d)
    return L.find_similar_papers(p, p.select("ord").filter("ord % 20 = 0")).withColumn("rank", F.col("rank").cast("long"))


@query("l10_citation_summary", "select sum(citation_count) as total_citations, round(avg(citation_count), 1) as mean_citations, sum(influential_citations) as influential, round(avg(reference_count), 1) as mean_references from papers", "papers")
def _(s, d):
    return L.citation_summary(A.papers(s, d))


@query("l10_top_cited", "select ord, title, citation_count from papers where citation_count > 0 order by citation_count desc, ord limit 10", "papers")
def _(s, d):
    return L.top_cited(A.papers(s, d))


@query("l11_publications_per_year", "select year, count(*) as n from papers where year is not null and year <> 0 group by year", "papers")
def _(s, d):
    return L.publications_per_year(A.papers(s, d))


@query("l12_top_journals", "select journal, count(*) as n from papers where journal <> '' group by journal order by n desc, journal limit 10", "papers")
def _(s, d):
    return L.top_journals(A.papers(s, d))


@query("l12_top_authors", "select author, count(*) as n from (select unnest(authors) as author from papers) group by author order by n desc, author limit 10", "papers")
def _(s, d):
    return L.top_authors(A.papers(s, d))


@query("l13_keyword_frequency", "select lower(k) as keyword, count(*) as n from (select unnest(keywords) as k from papers) where k <> '' group by all order by n desc, keyword limit 15", "papers")
def _(s, d):
    return L.keyword_frequency(A.papers(s, d))


@query("l14_open_access_share", "select count(*) filter (is_open_access) as open, count(*) filter (not is_open_access) as closed from papers", "papers")
def _(s, d):
    return L.open_access_share(A.papers(s, d))


@query("l15_citation_histogram", "select cast(least(floor((citation_count - lo) * 20 / greatest(hi - lo, 1)), 19) as int) as bin, count(*) as n from papers, (select min(citation_count) as lo, max(citation_count) as hi from papers) where citation_count is not null group by bin", "papers")
def _(s, d):
    return L.citation_histogram(A.papers(s, d))


@query("l16_source_breakdown", f"with {_KEYED} select trim(x) as source, count(*) as n from (select unnest(string_split(source, ',')) as x from merged) group by all", "papers")
def _(s, d):
    return L.source_breakdown(L.dedupe_by_identifier(A.papers(s, d))[0])


@query("l17_result_metrics", "select count(*) as total, count(*) filter (is_open_access) as open_access, sum(coalesce(citation_count, 0)) as citations, min(year) as first_year, max(year) as last_year, round(count(*) / count(distinct source), 4) as mean_per_source from papers", "papers")
def _(s, d):
    return L.result_metrics(A.papers(s, d))


_SELECTED = ("pubmed", "crossref", "doaj", "openalex", "pmc", "europepmc", "semantic_scholar", "biorxiv", "medrxiv", "elsewhere")
_FAILING = {"doaj": "MalformedPayload", "openalex": "PATH_NOT_FOUND", "elsewhere": "unknown source"}


def federated(s, d):
    """Nine sources, of which one has a payload that is no JSON and one isn't there, and a name that none has."""
    from evidex.plans.q_sources import folder, land, named
    from evidex.sources import papers as P

    sources = L.split_by_source(A.papers(s, d))
    path = land(sources["doaj"], "ord", named(bibjson=named(title="title")), lambda x: named(results=x))
    s.createDataFrame([("{ no json",)], "value string").write.mode("append").text(path)
    sources |= {"doaj": lambda: P.strict(s, path, P.scan_doaj_json), "openalex": lambda: P.strict(s, folder(s), P.scan_openalex_json)}
    return L.federated_union(sources, list(_SELECTED), s)


_OUTCOMES = "(values " + ", ".join(f"('{x}')" for x in _SELECTED) + ") v(source)"
_REASONS = "case source " + " ".join(f"when '{k}' then 'Failed: {v}'" for k, v in _FAILING.items()) + " end"


@query("s11_federated_union", f"select source, coalesce({_REASONS}, case when count(ord) = 0 then 'No results' else 'OK (' || count(ord) || ' results)' end) as status, case when {_REASONS} is null then count(ord) else 0 end as n_results from {_OUTCOMES} left join papers using (source) group by source", "papers")
def _(s, d):
    return federated(s, d)[1]


@query("s11_federated_union_rows", "select ord, title, year, source from papers where source not in ('doaj', 'openalex')", "papers")
def _(s, d):
    return federated(s, d)[0].select("ord", "title", "year", "source")


@query("s02_scan_pmc_ids", "select doc_id as ord, 'PMC Article ' || doc_id as title, cast(doc_id as varchar) as pmcid, true as is_open_access, 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || doc_id || '/' as url from documents")
def _(s, d):
    from evidex.sources import papers as P

    return P.scan_pmc_ids(docs(s, d).select("doc_id"), "doc_id")
