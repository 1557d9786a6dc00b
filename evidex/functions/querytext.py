"""Query text: validation, Boolean syntax, intents and routing, as Column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import any_in, strings

#: Substrings that mark a biomedical query.
HINTS = (
    "cancer", "tumor", "tumour", "gene", "genome", "protein", "cell", "clinical", "disease", "syndrome", "therapy", "treatment", "drug", "receptor", "enzyme", "diabetes", "cardio", "neuro", "immune",
    "immunology", "oncology", "virus", "bacteria", "infection", "vaccine", "mutation", "dna", "rna", "biomarker", "pathway", "inflammation", "chronic", "acute", "diagnosis", "prognosis", "trial",
    "patient", "disorder", "metabolic", "molecular", "pharma", "antibody", "antigen", "pathogen", "epidemiology", "genetic", "cellular", "tissue", "organ", "surgery", "screening", "biopsy", "assay",
    "cohort", "randomized", "meta-analysis", "systematic review", "risk factor",
)

#: For each intent its keywords (substrings) and patterns.
INTENT_KEYWORDS = {
    "literature_search": (
        "paper", "papers", "publication", "publications", "literature", "research", "study", "studies", "journal", "articles", "article", "bibliography", "find", "search", "bibliometric",
        "research article", "meta-analysis", "clinical trial", "systematic review", "finding papers", "literature search", "publication search", "article search", "research articles", "scholarly articles",
    ),
    "drug_info": (
        "drug", "drugs", "medicine", "medicines", "medication", "pharmaceutical", "pharmacology", "compound", "compounds", "chemical", "chemicals", "dosage", "dose", "indication", "contraindication",
        "interaction", "side effect", "adverse effect", "pubchem", "drug name", "drug information", "pharmacodynamics", "pharmacokinetics", "pharmacokinetic", "mechanism of action", "indications", "contraindications",
    ),
    "smiles_analysis": (
        "smiles", "structure", "molecular structure", "chemical structure", "3d structure", "2d structure", "molecule", "molecules", "chemical formula", "functional group", "functional groups", "lipinski",
        "rule of five", "atom", "atoms", "bond", "bonds", "molecular weight", "logp", "tpsa", "h-bond", "analyze structure", "chemical analysis",
    ),
    "knowledge_graph": (
        "relationship", "relationships", "connection", "connections", "network", "networks", "graph", "node", "nodes", "edge", "edges", "pathway", "gene", "genes", "protein", "proteins", "disease",
        "diseases", "interaction", "interactions", "knowledge graph", "biological network", "gene-disease", "protein-protein", "drug-target", "pathway analysis", "connectivity",
    ),
    "drug_discovery": (
        "drug discovery", "candidate", "candidates", "similarity search", "similar compounds", "target prediction", "toxicity prediction", "repurposing", "drug repurposing", "repositioning", "lead", "leads",
        "hit", "hits", "screening", "virtual screening", "high-throughput screening", "pharmacophore", "docking", "binding affinity", "efficacy", "safety", "admet", "drug-likeness", "rank", "ranking", "candidate ranking",
    ),
}
STRUCTURE_RUN = r"[A-Za-z0-9@+\-\[\]()=#:$/\\%.~]{10,}"
INTENT_PATTERNS = {
    "literature_search": (r"find\s+papers?", r"search\s+for\s+papers?", r"literature\s+search", r"publication\s+search", r"research\s+on\s+", r"studies?\s+on\s+", r"articles?\s+about\s+", r"clinical\s+trials?\s+on\s+", r"meta[- ]analysis", r"systematic\s+review"),
    "drug_info": (r"drug\s+information", r"about\s+drug", r"tell\s+me\s+about\s+", r"what\s+is\s+", r"information\s+about\s+", r"drug\s+name\s+", r"molecular\s+properties", r"pubchem"),
    "smiles_analysis": (r"smiles\s+string", r"molecular\s+structure", r"chemical\s+structure", r"3d\s+structure", r"functional\s+groups?", r"lipinski", r"rule\s+of\s+five", r"atom\s+information", STRUCTURE_RUN),
    "knowledge_graph": (r"relationship\s+between", r"connection\s+between", r"how\s+is\s+.*\s+related\s+to", r"interacts?\s+with", r"graph\s+of", r"knowledge\s+graph", r"pathways?\s+involving", r"biological\s+network", r"gene[- ]disease", r"protein[- ]protein"),
    "drug_discovery": (r"drug\s+discovery", r"find\s+drug", r"similar\s+compounds?", r"target\s+prediction", r"toxicity\s+prediction", r"repurposing", r"candidate\s+ranking", r"lead\s+compound", r"virtual\s+screening", r"drug[- ]likeness", r"admet"),
}
#: The agent of each intent.
AGENTS = (("literature_search", "literature_search_agent"), ("drug_info", "drug_info_agent"), ("smiles_analysis", "smiles_analysis_agent"), ("knowledge_graph", "knowledge_graph_agent"), ("drug_discovery", "drug_repurposing_agent"))
#: Single-label routes in order of precedence.
ROUTES = (
    ("compare", ("compare",)),
    ("literature", ("paper", "papers", "publication", "research", "study", "literature", "find", "search")),
    ("drug", ("drug", "medicine", "medication", "compound", "pharma", "pharmaceutical")),
    ("smiles", ("smiles", "structure", "molecule", "molecular", "chemical")),
    ("knowledge_graph", ("relationship", "connection", "pathway", "gene", "protein", "interaction")),
    ("drug_discovery", ("discovery", "candidate", "similar", "repurpose", "repurposing", "screen")),
)


def looks_biomedical(q: Column) -> Column:
    tokens = F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return any_in(F.lower(q), HINTS) | F.exists(tokens, lambda t: t.rlike("^[A-Z0-9]{2,8}$")) | (F.size(tokens) <= 6)


#: What is said to a query that fails a check, in the order of the checks.
MESSAGES = {
    "null": "Please enter a search term.",
    "empty": "Search query cannot be empty. Try a term like 'EGFR' or 'lung cancer'.",
    "short": "Your query is too short (minimum {least} characters). Try something more specific, e.g. 'BRCA1' or 'aspirin'.",
    "number": "A purely numeric query won't return meaningful results. Try a disease name, gene symbol, or drug name instead.",
    "letterless": "Your query needs to contain at least one letter or word.",
    "no term": "This doesn't look like a valid search term. Please try a biomedical keyword or phrase.",
    "typo": "This query looks like it might be a typo. Please double check the spelling.",
}


def validate_query(q: Column, least: int = 3) -> list[Column]:
    """[is_valid, message, looks_biomedical]: the first failing check names the message."""
    t = F.trim(q)
    letters = F.regexp_replace(t, "[^a-zA-Z]", "")
    message = (
        F.when(q.isNull(), MESSAGES["null"])
        .when(t == "", MESSAGES["empty"])
        .when((F.length(t) < least) & ~t.rlike("^[A-Z0-9]{2,10}$"), MESSAGES["short"].format(least=least))
        .when(t.rlike("^[0-9]+$"), MESSAGES["number"])
        .when(~t.rlike("[a-zA-Z]"), MESSAGES["letterless"])
        .when(F.length(letters) < 2, MESSAGES["no term"])
        .when((F.length(letters) >= 6) & ~letters.rlike("[aeiouAEIOU]"), MESSAGES["typo"])
        .otherwise("")
    )
    valid = message == ""
    return [valid.alias("is_valid"), message.alias("message"), F.when(valid, looks_biomedical(t)).otherwise(True).alias("looks_biomedical")]


def parse_boolean_query(q: Column) -> Column:
    """Struct of phrases, must, should, must_not and raw; a token goes to the list of the latest operator."""
    phrases = F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1))
    tokens = F.filter(F.split(F.regexp_replace(q, '"[^"]+"', ""), r"\s+"), lambda t: t != "")
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("AND").alias("mode"), none.alias("must"), none.alias("should"), none.alias("must_not"))

    def step(a: Column, t: Column) -> Column:
        op = F.upper(t).isin("AND", "OR", "NOT")
        put = lambda name, mode: F.when(~op & (a["mode"] == mode), F.concat(a[name], F.array(t))).otherwise(a[name]).alias(name)
        return F.struct(F.when(op, F.upper(t)).otherwise(a["mode"]).alias("mode"), put("must", "AND"), put("should", "OR"), put("must_not", "NOT"))

    done = F.aggregate(tokens, start, step)
    return F.struct(phrases.alias("phrases"), done["must"].alias("must"), done["should"].alias("should"), done["must_not"].alias("must_not"), q.alias("raw"))


def plain_query(parsed: Column) -> Column:
    parts = F.concat(parsed["phrases"], parsed["must"], parsed["should"])
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(parsed["raw"])


def boolean_match(text: Column, parsed: Column) -> Column:
    """All phrases and musts are in the text, no must-not is, and one should is where there are any; case is ignored."""
    low = F.lower(text)
    has = lambda t: F.contains(low, F.lower(t))
    needed = F.forall(F.concat(parsed["phrases"], parsed["must"]), has)
    return needed & ~F.exists(parsed["must_not"], has) & ((F.size(parsed["should"]) == 0) | F.exists(parsed["should"], has))


#: Queries that documents are matched with at a time.
MOST_QUERIES = 1000


def match_queries(docs: DataFrame, text: str, queries: DataFrame) -> DataFrame:
    """(docs' columns, query_id) for each match with ``queries`` (query_id, query).

    Up to ``MOST_QUERIES`` are one literal array that each row looks through. More are parsed and gathered
    into blocks of so many by Spark, and each row meets each block once, so their number has no bound.
    """
    stated = queries.select("query_id", "query").limit(MOST_QUERIES + 1).collect()
    if not stated:
        return docs.withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType)).limit(0)
    ids = lambda each: F.transform(F.filter(each, lambda x: boolean_match(F.col(text), x["p"])), lambda x: x["query_id"])
    if len(stated) <= MOST_QUERIES:
        each = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), parse_boolean_query(F.lit(r.query)).alias("p")) for r in stated])
        return docs.withColumn("query_id", F.explode(ids(each)))
    n = -(-queries.count() // MOST_QUERIES)
    parsed = queries.select(F.pmod(F.xxhash64("query_id", "query"), F.lit(n)).alias("_block"), F.struct("query_id", parse_boolean_query(F.col("query")).alias("p")).alias("q"))
    blocks = parsed.groupBy("_block").agg(F.collect_list("q").alias("_each"))  # about MOST_QUERIES each
    met = docs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(blocks, "_block")
    return met.withColumn("query_id", F.explode(ids(F.col("_each")))).drop("_block", "_each")


#: A capital and small letters that no other letter, digit or underscore of any script touches.
NAME = r"(?:^|[^\p{L}\p{N}_])[A-Z][a-z]{2,}(?:$|[^\p{L}\p{N}_])"


def intents(q: Column) -> Column:
    """Array of intents by keywords and patterns, with fall-backs, or unknown."""
    low = F.lower(q)
    found = [F.when(any_in(low, INTENT_KEYWORDS[i]) | F.coalesce(low.rlike("|".join(f"(?:{p})" for p in INTENT_PATTERNS[i])), F.lit(False)), F.lit(i)) for i in INTENT_KEYWORDS]
    direct = F.array_compact(F.array(*found))
    words = F.size(F.filter(F.split(F.coalesce(q, F.lit("")), r"\s+"), lambda w: w != ""))
    late = F.array_compact(
        F.array(
            F.when(q.rlike(STRUCTURE_RUN), F.lit("smiles_analysis")),
            F.when(q.rlike(NAME) & ((words <= 5) | low.rlike(r"^(tell|what|about)\s+(me\s+)?about")), F.lit("drug_info")),
            F.when(any_in(low, ("paper", "publication", "research", "study", "journal")), F.lit("literature_search")),
        )
    )
    return F.when(F.size(direct) > 0, direct).when(F.size(late) > 0, late).otherwise(F.array(F.lit("unknown")))


def detect_intents(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(key, F.explode(intents(F.col(text))).alias("intent"))


def route_first_match(q: Column) -> Column:
    low = F.lower(q)
    out = F.when(low.rlike(r"(?:paper|#)\s*([0-9]+)"), "paper_detail").when(any_in(low, ("summarize", "summary", "overview")), "summarize")
    for name, words in ROUTES:
        out = out.when(any_in(low, words), name)
    return out.otherwise("general")


def map_intents_to_agents(found: DataFrame, key: str, preferred: tuple[str, ...] = (), exclude: tuple[str, ...] = (), force: tuple[str, ...] = (), primary: str | None = None) -> DataFrame:
    """(key, agent, confidence): the best for each agent; forced agents replace all others, missing ones at 0.9."""
    spark = found.sparkSession
    agents = F.broadcast(spark.createDataFrame(list(AGENTS), "intent string, agent string"))
    among = lambda values: F.col("agent").isin(*values) if values else F.lit(False)
    score = F.least(F.lit(1.0), F.round(0.8 + F.when(among(preferred), 0.1).otherwise(0.0) + F.when(F.col("intent") == F.lit(primary), 0.05).otherwise(0.0), 6))
    rows = found.join(agents, "intent").filter(~among(exclude)).select(key, "agent", score.alias("confidence"))
    if force:
        extra = found.select(key).distinct().select(key, F.explode(strings(force)).alias("agent"), F.lit(0.9).alias("confidence"))
        rows = rows.filter(among(force)).union(extra.join(rows.select(key, "agent"), [key, "agent"], "left_anti"))
    return rows.groupBy(key, "agent").agg(F.max("confidence").alias("confidence"))
