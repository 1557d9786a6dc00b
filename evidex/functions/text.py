"""Scalar and text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the four-letter keyword rule leaves out.
STOP_4 = ("the", "and", "for", "with", "that", "this", "were", "was", "are", "from", "have", "has", "not", "into", "using", "study", "results", "which", "these")
#: Words that the general keyword rule leaves out.
STOP_GENERAL = (
    "a", "an", "the", "and", "or", "but", "if", "then", "so", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is",
    "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "we", "you", "they", "he", "she", "it", "i",
)
#: Words that are no label by themselves; the list begins with all of the general ones, which are given once.
STOP_LABEL = STOP_GENERAL + (
    "our", "their", "its", "his", "her", "not", "no", "yes", "do", "does", "did", "have", "has", "had", "can", "could", "will", "would",
    "should", "may", "might", "must", "than", "also", "into", "onto", "such", "via", "per", "vs", "about", "between", "among", "within",
    "study", "studies", "result", "results", "method", "methods", "conclusion", "conclusions", "background", "objective", "objectives",
    "purpose", "aim", "aims",
)
#: Disease, drug and organism cues of the lexicon rule, and the diseases that the context rule adds.
DISEASES = ("cancer", "carcinoma", "diabetes", "alzheimer", "parkinson", "syndrome", "disease", "disorder", "infection", "arthritis", "asthma", "stroke", "obesity", "hypertension", "depression", "sclerosis")
DISEASES_MORE = ("melanoma", "leukemia", "lymphoma", "tumor")
DRUG_SUFFIXES = ("mab", "nib", "prazole", "statin", "cillin", "azole", "olol", "pril", "sartan")
ORGANISMS = ("mouse", "mice", "rat", "human", "e. coli", "yeast", "drosophila", "zebrafish")
#: Words of mechanism and of indication sentences.
MECHANISM = (
    "inhibit", "inhibitor", "inhibits", "inhibiting", "agonist", "antagonist", "receptor", "enzyme", "block", "blocks", "blocking", "bind",
    "binds", "binding", "activates", "activation", "mechanism", "pathway", "kinase", "channel", "transporter", "substrate", "catalyzes", "modulates",
)
INDICATION = (
    "used to treat", "indicated for", "treatment of", "used for", "prevention of", "management of", "therapy for", "relief of",
    "used in the treatment", "approved for", "used against", "treats",
)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_in(text: Column, values) -> Column:
    """Any of the fixed ``values`` is a substring of ``text``."""
    return F.coalesce(F.exists(strings(values), lambda v: F.contains(text, v)), F.lit(False))


def normalize_text(c: Column) -> Column:
    """White space as single spaces, trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def text_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def cache_key(model: str, c: Column) -> Column:
    return F.concat(F.lit(model + ":"), text_hash(c))


def content_hash(*parts: tuple[str, Column]) -> Column:
    """SHA-256 of (type tag, value) parts; a null part is spelt null."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(tag + ":"), F.coalesce(c.cast("string"), F.lit("null"))) for tag, c in parts]), 256)


def short_hash(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *cols), 256), 1, 16)


def title_key(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 120)


def paper_uid(doi: Column, pmid: Column, pmcid: Column, title: Column) -> Column:
    empty = F.lit("")
    return F.md5(F.coalesce(F.nullif(doi, empty), F.nullif(pmid, empty), F.nullif(pmcid, empty), title_key(title)))


def chunk_text(df: DataFrame, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Rows (chunk_index, chunk) of ``df``'s text: windows of ``size`` characters that overlap."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    whole = df.withColumn("_t", normalize_text(F.col(text))).filter("_t is not null")
    last = F.ceil(F.greatest(F.length("_t") - size, F.lit(0)) / step) * step
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")), lambda i: F.trim(F.substring(F.col("_t"), (i + 1).cast("int"), F.lit(size))))
    return whole.select("*", F.posexplode(F.filter(chunks, lambda c: c != "")).alias("chunk_index", "chunk")).drop("_t")


def truncate_text(c: Column, most: int, suffix: str = "...") -> Column:
    if len(suffix) >= most:
        return F.when(F.length(c) > most, F.lit(suffix[:most])).otherwise(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def snippet(c: Column, most: int = 160) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def _top_words(df: DataFrame, key: str, words: Column, top: int) -> DataFrame:
    """(key, keywords): the most frequent words of a row's array, first seen first among equals.

    Rows are worked on by themselves: the array is sorted, and a fold over it counts runs of equal words
    and holds the ``top`` best so far. Rows without words are left out.
    """
    best = F.expr("cast(array() as array<struct<n:int,pos:int,word:string>>)")
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("pos"), best.alias("best"))

    def pushed(a: Column) -> Column:
        own = F.struct((-a["n"]).alias("n"), a["pos"].alias("pos"), a["word"].alias("word"))
        full = (F.size(a["best"]) == top) & (F.get(a["best"], F.lit(top - 1)) < own)
        return F.when(a["word"].isNull() | F.coalesce(full, F.lit(False)), a["best"]).otherwise(F.slice(F.array_sort(F.concat(a["best"], F.array(own))), 1, top))

    def step(a: Column, x: Column) -> Column:
        more = F.struct(a["word"].alias("word"), (a["n"] + 1).alias("n"), a["pos"].alias("pos"), a["best"].alias("best"))
        new = F.struct(x["word"].alias("word"), F.lit(1).alias("n"), x["pos"].alias("pos"), pushed(a).alias("best"))
        return F.when(a["word"] == x["word"], more).otherwise(new)

    runs = F.array_sort(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    found = F.aggregate(runs, start, step, pushed)
    rows = df.select(key, words.alias("_words")).filter(F.size("_words") > 0)
    return rows.select(key, F.transform(found, lambda t: t["word"]).alias("keywords"))


def extract_keywords_4(df: DataFrame, key: str, text: str, top: int = 6) -> DataFrame:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]{4,}"), F.lit(0))
    return _top_words(df, key, F.filter(words, lambda w: ~w.isin(*STOP_4)), top)


def extract_keywords_generic(df: DataFrame, key: str, text: str, least: int = 3, top: int = 10) -> DataFrame:
    plain = F.regexp_replace(F.lower(normalize_text(F.col(text))), r"[^\p{L}\p{N}_\s]", "")
    return _top_words(df, key, F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_GENERAL)), top)


def entities_lexicon(text: Column) -> Column:
    """Map of kind -> sorted distinct names, by fixed cues."""
    low = F.lower(text)
    named = lambda values: F.array_sort(F.filter(strings(values), lambda v: F.contains(low, v)))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9-]{2,}\b"), F.lit(0)))
    genes = F.array_sort(F.filter(tokens, lambda t: t.rlike(r"^[A-Z][A-Z0-9]{1,7}[0-9]?$") & (F.length(t) <= 8)))
    drugs = F.array_sort(F.filter(tokens, lambda t: F.lower(t).rlike("(" + "|".join(DRUG_SUFFIXES) + ")$")))
    none = F.array().cast("array<string>")
    return F.create_map(
        F.lit("diseases"), F.slice(named(DISEASES), 1, 10), F.lit("genes"), F.slice(genes, 1, 10), F.lit("proteins"), none,
        F.lit("chemicals"), none, F.lit("drugs"), F.slice(drugs, 1, 10), F.lit("organisms"), F.slice(named(ORGANISMS), 1, 5),
    )


def entities_context(text: Column, compat: bool = False) -> Column:
    """Map of kind -> names found by pattern, with the words around diseases; kinds with none are left out.

    Drugs are whole words; with ``compat`` only their suffixes, as the rule was first written.
    """
    suffix = "mab|nib|prazole|statin|cillin|azole|olol|pril|sartan|vir|umab|ximab"
    genes = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9]{1,7}[0-9]?\b"), F.lit(0)), lambda g: F.length(g) >= 3)
    drugs = F.regexp_extract_all(text, F.lit(rf"(?i)\b[A-Za-z]{{3,}}({suffix})\b"), F.lit(1 if compat else 0))
    around = lambda d: F.slice(F.regexp_extract_all(text, F.lit(rf"(?i)\b[A-Za-z0-9_\s]{{0,20}}{d}[A-Za-z0-9_\s]{{0,20}}\b"), F.lit(0)), 1, 5)
    low, none = F.lower(text), F.array().cast("array<string>")
    near = [F.when(F.contains(low, F.lit(d)), around(d)).otherwise(none) for d in DISEASES + DISEASES_MORE]  # the pattern is slow where the word is missing
    diseases = F.transform(F.concat(*near), lambda d: F.trim(d))
    top = lambda a: F.slice(F.array_sort(F.array_distinct(a)), 1, 10)
    return F.map_filter(F.create_map(F.lit("genes"), top(genes), F.lit("drugs"), top(drugs), F.lit("diseases"), top(diseases)), lambda k, v: F.size(v) > 0)


def split_sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def long_sentences(c: Column) -> Column:
    """Sentences with more than four words."""
    return F.filter(split_sentences(c), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) > 4)


def summaries(papers: DataFrame) -> DataFrame:
    """Adds short_summary (the first longer sentence) and detailed_summary (the first four)."""
    found = papers.withColumn("_s", long_sentences(F.coalesce("abstract", F.lit(""))))
    short = F.when(F.size("_s") > 0, F.element_at("_s", 1)).otherwise("No abstract available for this paper.")
    detailed = F.when(F.size("_s") > 0, F.concat_ws(" ", F.slice("_s", 1, 4))).otherwise(short)
    return found.withColumns({"short_summary": short, "detailed_summary": detailed}).drop("_s")


def sentences_with(c: Column, words) -> Column:
    """Sentences that hold any of the words, joined by spaces."""
    return F.concat_ws(" ", F.filter(split_sentences(c), lambda s: F.exists(strings(words), lambda k: F.contains(F.lower(s), k))))


def count_occurrences(c: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of ``term``."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(c) - F.length(F.replace(c, term, F.lit("")))) / F.length(term)).cast("int")


_STATISTIC = r"(p\s*[<=>]\s*0?\.\d+)|(\d+(\.\d+)?\s*%\s*(ci|confidence))|(\bci\b\s*[:=]?\s*\d)|(\bn\s*=\s*\d+)|(\bhr\s*[:=]\s*\d)|(\bor\s*[:=]\s*\d)"


def is_meaningful_label(label: Column, most_chars: int = 50, most_words: int = 6) -> Column:
    """A label names a concept: not a stop word, a statistic, a number, markup or a sentence."""
    t = F.coalesce(normalize_text(label), F.lit(""))
    words = F.size(F.split(t, " "))
    bare = F.regexp_replace(F.lower(t), r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")
    noise = (words == 1) & (bare.isin(*STOP_LABEL) | ((F.length(bare) <= 2) & ~bare.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    good = (t != "") & (F.length(t) <= most_chars) & ~t.rlike("<[^>]+>") & ~F.lower(t).rlike(_STATISTIC) & ~t.rlike(r"^[0-9.\-+%,/]+$") & t.rlike("[A-Za-z]")
    return good & ~noise & (words <= most_words) & (letters >= F.greatest(F.lit(2.0), F.length(t) * 0.4))


def is_plausible_smiles(c: Column) -> Column:
    """Only characters of structure strings, with brackets that close in order."""
    t = F.trim(c)
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("b"), F.lit(True).alias("ok"))

    def step(a: Column, ch: Column) -> Column:
        p = a["p"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        b = a["b"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        return F.struct(p.alias("p"), b.alias("b"), (a["ok"] & (p >= 0) & (b >= 0)).alias("ok"))

    end = F.aggregate(F.split(t, ""), start, step)
    return F.coalesce(t.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%~]+$") & end["ok"] & (end["p"] == 0) & (end["b"] == 0), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_confidence(c: Column, default: float = 0.5) -> Column:
    """Any value as a number in [0, 1]; what is no number counts as ``default``."""
    return clamp(F.coalesce(c.try_cast("double"), F.lit(default)))


#: Thresholds of the two label scales, and the middle of each label.
SCALE = (("very_high", 0.85), ("high", 0.65), ("medium", 0.4))
ASSISTANT_SCALE = (("very_high", 0.9), ("high", 0.7), ("medium", 0.4))
MIDPOINTS = (("low", 0.15), ("medium", 0.5), ("high", 0.75), ("very_high", 0.925))


def score_to_confidence(c: Column, scale=SCALE) -> Column:
    out = F.lit("low")
    for name, least in reversed(scale):
        out = F.when(c >= least, name).otherwise(out)
    return out


def confidence_to_score(c: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, middle in MIDPOINTS:
        out = F.when(c == name, middle).otherwise(out)
    return out


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def safe_log(c: Column, default: float = 0.0) -> Column:
    return F.when(c > 0, F.log(c)).otherwise(default)


def safe_sqrt(c: Column, default: float = 0.0) -> Column:
    return F.when(c >= 0, F.sqrt(c)).otherwise(default)


def parse_iso_timestamp(c: Column) -> Column:
    """ISO 8601 text as a timestamp, UTC where it names no zone (the session's zone is UTC)."""
    return F.try_to_timestamp(c)


def age_seconds(c: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(c))


def dedupe_ordered(a: Column) -> Column:
    return F.array_distinct(a)


def chunked(a: Column, size: int) -> Column:
    """Neighbouring runs of at most ``size`` elements."""
    return F.when(F.size(a) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(size)), lambda i: F.slice(a, i, F.lit(size))))


def validate_vector(v: Column, dims: int | None = None) -> Column:
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(v) == dims) if dims else good, F.lit(False))
