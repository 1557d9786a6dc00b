"""The queries op1 to op13 over the given tables, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import byte_bpe, centroids, chat, decontaminate, langid, line_dedup, quality, runs, secrets, simhash, token_count, token_files, toxicity
from evidex.llm.common import let


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_files.token_files(docs, vocabulary_path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = _read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, toxicity.fit_classifier(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "lang_threshold", "flagged")


#: Characters of HTML that count as a page of a document.
PAGE_CHARS = 3000


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn of a conversation has the page of the same number as a document, where there is one."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    size = F.ceil(F.coalesce(F.length("html"), F.lit(0)) / PAGE_CHARS)
    pages = _read(spark, sf_dir, "pages").filter("url is not null").groupBy(F.col("page_id").cast("long").alias("conv_id")).agg(F.min(F.struct("url", size.alias("pages"))).alias("page"))
    own = rows.union(extra).join(pages, "conv_id", "left").withColumn("page", F.when(F.col("role") == "user", F.col("page")))
    chats = chat.format_chats(chat.messages_of(own, chat.document_part(F.col("page.url"), F.col("page.pages"))))
    back = chat.read_chats(chats)
    turns = F.array_join(F.zip_with("roles", "bare_texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("placeholders").cast("long").alias("n_attachments"),
        F.array_join("placeholders", ",").alias("placeholders"),
        "n_attachment_tokens",
        F.array_join(F.transform("attachments", lambda a: a["ref"]), ",").alias("refs"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, trusted_ids(spark, sf_dir)).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), "text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, bytes_for_unknown = token_count.vocabulary(vocabulary_path("piece_bpe_32k.model"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, pieces, bytes_for_unknown).drop("text")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, by the multilingual ranks."""
    import public_tokenizers

    ranks = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text): one in ten, by the hash of its doc_id, goes on from some word with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, (a + (i - a) % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), again), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digests = (F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return runs.find_runs(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests, "n_words")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit_languages(docs.filter(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def queries() -> dict:
    found = (op1_token_files, op2_toxicity, op3_chat_format, op4_quality_rules, op5_decontaminate, op6_simhash, op7_line_dedup, op8_secret_scan, op9_token_count, op10_byte_bpe, op11_periodic_runs, op12_centroid_clusters, op13_language_id)
    return {f.__name__: f for f in found}


#: op3: what the templates hold, straight from the rows; the length of the marks and escapes is counted.
_OP3 = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), docs as (
  select page_id as conv_id, min(struct_pack(url := url, pages := cast(ceil(coalesce(length(html), 0) / {page}) as bigint))) as page from pages where url is not null group by 1
), sized as (
  select rows.*, regexp_replace(text, '([<\\[])(\\\\+|[|/sSI<]|$)', '\\1\\\\\\2', 'g') as escaped, case when role = 'user' then page end as page,
    count(case when role = 'user' then page end) over (partition by conv_id order by turn, role, text rows unbounded preceding) as k
  from rows left join docs using (conv_id)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(escaped) + 17 + case when page is null then 0 else 13 + length(cast(k as varchar)) end) as bigint) as formatted_chars,
  count(page) as n_attachments, coalesce(string_agg('document:' || k, ',' order by k) filter (page is not null), '') as placeholders,
  cast(coalesce(sum(page.pages), 0) * {tokens} as bigint) as n_attachment_tokens, coalesce(string_agg(page.url, ',' order by k) filter (page is not null), '') as refs
from sized group by conv_id
"""

#: op5: every window of every item against every window of every document, by their words.
_OP5 = """
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), win as (
  select distinct cast(item_id as varchar) as item_id, n, array_to_string(w[k:k + n - 1], ' ') as words
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from b where len(w) > 0)
), occ as (
  select rid, k, n, array_to_string(w[k:k + n - 1], ' ') as words
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as k from d cross join (select distinct n from win) where len(w) >= n)
), hits as (
  select rid, k, n, item_id from occ join win using (n, words)
), places as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from hits) group by rid
), items as (
  select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hits where item_id is not null) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (rid) left join items using (rid)
"""


def _op8() -> str:
    """Spans from the lengths of what a pattern matches and of what lies between, for all patterns; then windows."""
    quoted = lambda p: p.replace("'", "''")
    each = """
select rid, '{kind}' as kind, {rank} as rank, value, start_at, start_at + length(value) as end_at from (
  select rid, unnest(ms) as value, unnest(gs) as g, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) as start_at
  from (select rid, regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {group}) as gs, regexp_split_to_array(text, '{p}') as parts from docs where regexp_matches(text, '{hint}'))
) where length(g) >= {least}"""
    base = " union all ".join(each.format(kind=k, rank=r, p=quoted(p), hint=quoted(secrets.HINTS[r]), group=g, least=n) for r, (k, p, g, n) in enumerate(secrets.PATTERNS))
    found = each.format(kind="entropy", rank=len(secrets.PATTERNS), p=quoted(secrets.CANDIDATE % secrets.WINDOW), hint=secrets.CANDIDATE % secrets.WINDOW, group=0, least=secrets.WINDOW)
    allowed = " or ".join("len(list_distinct(string_split(value, ''))) = 1" if "\\1" in a else f"regexp_matches(value, '{quoted(a)}')" for a in secrets.ALLOW)
    limit = "case " + " ".join(f"when regexp_matches(value, '{p}') then {x}::double" for _, p, x in secrets.CLASSES) + " end"
    entropy = f"list_max(list_transform(range(1, length(value) - {secrets.WINDOW} + 2), lambda i: list_sum(list_transform(list_distinct(string_split(substr(value, i, {secrets.WINDOW}), '')), lambda ch: -(length(substr(value, i, {secrets.WINDOW})) - length(replace(substr(value, i, {secrets.WINDOW}), ch, ''))) / {secrets.WINDOW}.0::double * log2((length(substr(value, i, {secrets.WINDOW})) - length(replace(substr(value, i, {secrets.WINDOW}), ch, ''))) / {secrets.WINDOW}.0::double)))))"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as ({base}),
fresh as (select * from ({found}) c where not ({allowed}) and not exists (select 1 from base b where b.rid = c.rid and b.start_at < c.end_at and c.start_at < b.end_at)),
added as (select * from fresh where {entropy} >= {limit} - 1e-9),
b as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || start_at || ':' || end_at, ',' order by start_at, rank) as shown from base group by rid),
e as (select rid, count(*) filter (kind = 'entropy') as n_entropy, string_agg(kind || ':' || start_at || ':' || end_at, ',' order by start_at, rank) as spans from (select * from base union all select * from added) group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_entropy, 0) as n_entropy, sha256(coalesce(shown, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join b using (rid) left join e using (rid)
"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """Each round as two steps: every vector with every centroid, then the floors of the means."""
    near = "a{r} as materialized (select rid, vec_id, v, best.d as d, best.n as n from (select rid, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := cast(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) as bigint), n := n)) as best from kept cross join c{r} group by rid))"
    mean = """m{r} as (select n, list(cast((s - (((s % m) + m) % m)) // m as double) order by p) as c from (select n, p, cast(sum(x) as bigint) as s, count(*) as m from (select n, unnest(v) as x, unnest(range(1, 65)) as p from a{r}) group by n, p) group by n),
c{q} as materialized (select n, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (n))"""
    steps = ",\n".join(f"{near.format(r=r)},\n{mean.format(r=r, q=r + 1)}" for r in range(rounds))
    return f"""
with kept as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as n, v as c from (select coalesce(sha256('2:' || vec_id), '~') as h, v from kept order by h, v limit {k})
), {steps},
{near.format(r=rounds)},
shas as (select n, sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256 from c{rounds})
select vec_id, n as cluster, d as distance, cast(sum(d) over (partition by n) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a{rounds} join shas using (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": _OP3.replace("{page}", str(PAGE_CHARS)).replace("{tokens}", str(chat.PAGE_TOKENS)), "op5_decontaminate": _OP5, "op8_secret_scan": _op8(), "op12_centroid_clusters": _op12()}
