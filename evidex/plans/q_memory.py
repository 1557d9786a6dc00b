"""Queries of query text (Q), evaluation (V), conversation and task tables (W) and exports (K), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex import adapters as A
from evidex.functions import querytext as Q
from evidex.operators import evaluation as E
from evidex.operators import memory as M
from evidex.operators import vectors as V

QUERIES, SQL = {}, {}


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = A.with_views(sql, *views) if views else sql
        return f

    return add


def _list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text, words):
    return f"list_bool_or(list_transform({_list(words)}, lambda v: contains({text}, v)))"


def lines(s, d):
    return A.table(s, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("q"))


_LINES = "lines as (select doc_id, split_part(text, chr(10), 1) as q from documents)"
_TOKS = "regexp_extract_all(trim(q), '[A-Za-z0-9]+')"
_BIO = f"({_any('lower(trim(q))', Q.HINTS)} or coalesce(list_bool_or(list_transform({_TOKS}, lambda t: regexp_matches(t, '^[A-Z0-9]{{2,8}}$'))), false) or len({_TOKS}) <= 6)"


_SAY = {k: "'" + m.format(least=3).replace("'", "''") + "'" for k, m in Q.MESSAGES.items()}


@query("q01_validate_query", f"""with {_LINES}, m as (select doc_id, q, case when q is null then {_SAY['null']} when trim(q) = '' then {_SAY['empty']} when length(trim(q)) < 3 and not regexp_matches(trim(q), '^[A-Z0-9]{{2,10}}$') then {_SAY['short']}
  when regexp_matches(trim(q), '^[0-9]+$') then {_SAY['number']} when not regexp_matches(trim(q), '[a-zA-Z]') then {_SAY['letterless']} when length(regexp_replace(q, '[^a-zA-Z]', '', 'g')) < 2 then {_SAY['no term']}
  when length(regexp_replace(q, '[^a-zA-Z]', '', 'g')) >= 6 and not regexp_matches(q, '[aeiouAEIOU]') then {_SAY['typo']} else '' end as message from lines)
select doc_id, message = '' as is_valid, message, case when message = '' then {_BIO} else true end as looks_biomedical from m""")  # fmt: skip
def _(s, d):
    return lines(s, d).select("doc_id", *Q.validate_query(F.col("q")))


@query("q02_looks_biomedical", f"select item_id, {_BIO} as b from (select item_id, text as q from benchmark)")
def _(s, d):
    return A.table(s, d, "benchmark").select("item_id", Q.looks_biomedical(F.trim("text")).alias("b"))


_BOOL = (("a", '"of the" that OR from NOT que'), ("b", "tion and NOT der"), ("c", 'OR la the'))


@query("q03_parse_boolean_query", "select doc_id, w[1:1] as must, [x for x in w[2:2]] as should, w[3:3] as must_not, '' || array_to_string(w[1:1], ' ') || ' ' || w[2] as plain from (select doc_id, regexp_extract_all(text, '[a-z]{5,}') as w from documents) where len(w) >= 3")
def _(s, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))
    rows = A.table(s, d, "documents").select("doc_id", words.alias("w")).filter("size(w) >= 3")
    q = F.concat(F.element_at("w", 1), F.lit(" OR "), F.element_at("w", 2), F.lit(" not "), F.element_at("w", 3))
    p = rows.select("doc_id", Q.parse_boolean_query(q).alias("p"))
    return p.select("doc_id", "p.must", "p.should", "p.must_not", Q.plain_query(F.col("p")).alias("plain"))


@query("q04_boolean_match", """select doc_id, 'a' as query_id from documents where contains(lower(text), 'of the') and contains(lower(text), 'that') and contains(lower(text), 'from') and not contains(lower(text), 'que')
union all select doc_id, 'b' from documents where contains(lower(text), 'tion') and contains(lower(text), 'and') is not null and not contains(lower(text), 'der') union all select doc_id, 'c' from documents where contains(lower(text), 'la') or contains(lower(text), 'the')""")  # fmt: skip
def _(s, d):
    return Q.match_queries(A.table(s, d, "documents").select("doc_id", "text"), "text", s.createDataFrame(list(_BOOL), "query_id string, query string")).select("doc_id", "query_id")


def turns(s, d):
    return A.table(s, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))


_TURNS = "turns as (select conv_id * 1000 + turn as id, text as q from conversations where role = 'user')"


def _intent(i):
    patterns = "|".join(f"(?:{p})" for p in Q.INTENT_PATTERNS[i])
    return f"{_any('lower(q)', Q.INTENT_KEYWORDS[i])} or regexp_matches(lower(q), '{patterns}')"


_INTENTS = f"{_TURNS}, direct as (" + " union all ".join(f"select id, q, '{i}' as intent from turns where {_intent(i)}" for i in Q.INTENT_KEYWORDS) + f"""), rest as (select * from turns where id not in (select id from direct)),
late as (select id, 'smiles_analysis' as intent from rest where regexp_matches(q, '{Q.STRUCTURE_RUN}') union all select id, 'drug_info' from rest where regexp_matches(q, '{Q.NAME}') and (len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) <= 5 or regexp_matches(lower(q), '^(tell|what|about)\\s+(me\\s+)?about'))
  union all select id, 'literature_search' from rest where {_any('lower(q)', ('paper', 'publication', 'research', 'study', 'journal'))}),
found as (select id, intent from direct union all select * from late union all select id, 'unknown' from rest where id not in (select id from late))"""


@query("q05_detect_intents", f"with {_INTENTS} select id, intent from found")
def _(s, d):
    return Q.detect_intents(turns(s, d), "id", "q")


@query("q06_route_first_match", f"with {_TURNS} select id, case when regexp_matches(lower(q), '(?:paper|#)\\s*([0-9]+)') then 'paper_detail' when {_any('lower(q)', ('summarize', 'summary', 'overview'))} then 'summarize' " + " ".join(f"when {_any('lower(q)', w)} then '{n}'" for n, w in Q.ROUTES) + " else 'general' end as intent from turns")
def _(s, d):
    return turns(s, d).select("id", Q.route_first_match(F.col("q")).alias("intent"))


@query("q07_map_intents_to_agents", f"with {_INTENTS}, a as (select * from (values " + ", ".join(f"('{i}', '{g}')" for i, g in Q.AGENTS) + ") v(intent, agent)) select id, agent, max(least(1.0::double, round(0.8::double + case when agent = 'drug_info_agent' then 0.1::double else 0 end + case when intent = 'smiles_analysis' then 0.05::double else 0 end, 6))) as confidence from found join a using (intent) where agent <> 'literature_search_agent' group by 1, 2")
def _(s, d):
    return Q.map_intents_to_agents(Q.detect_intents(turns(s, d), "id", "q"), "id", ("drug_info_agent",), ("literature_search_agent",), primary="smiles_analysis")


def runs(s, d):
    e = A.store(s, d)
    own = e.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    found = V.vector_search(e, own, 10).select("query", F.col("id").alias("item"), "rank")
    return E.judge_by_label(found, e.select("id", F.col("source_type").alias("label")), own)


_RUNS = """runs as (select q.id as query, s.id as item, row_number() over (partition by q.id order by round(list_cosine_similarity(q.vector, s.vector), 9) desc, s.id) as rank from store q, store s where q.id % 20 = 0 and q.id <> s.id qualify rank <= 10),
qrels as (select q.id as query, s.id as item from store q join store s on q.source_type = s.source_type and q.id <> s.id where q.id % 20 = 0),
hits as (select r.*, q.item is not null as hit from runs r left join qrels q using (query, item)), rel as (select query, count(*) as n_rel from qrels group by 1)"""


@query("v01_precision_recall_f1", f"with {_RUNS}, pr as (select query, count(*) filter (hit) / count(*) as p, count(*) filter (hit) / any_value(n_rel) as r from hits join rel using (query) group by 1) select query, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1 from pr", "store")
def _(s, d):
    return E.precision_recall_f1(runs(s, d)).select("query", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("v02_mean_average_precision", f"with {_RUNS}, c as (select query, rank, hit, count(*) filter (hit) over (partition by query order by rank) as seen from hits) select round(avg(ap), 9) as map from (select query, sum(case when hit then seen / rank else 0 end) / any_value(n_rel) as ap from c join rel using (query) group by 1)", "store")
def _(s, d):
    return E.mean_average_precision(runs(s, d)).select(F.round("map", 9).alias("map"))


@query("v03_ndcg", f"with {_RUNS}, g as (select query, sum(case when hit then 1 / log2(rank + 1) else 0 end) as a, sum(case when hit then 1 / (rank + 1.0) else 0 end) as b, least(any_value(n_rel), 10) as k from hits join rel using (query) group by 1) select query, round(a / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= k), 9) as log2, round(b / (select sum(1 / (i + 1.0)) from range(1, 11) t(i) where i <= k), 9) as linear from g", "store")
def _(s, d):
    r = runs(s, d)
    a, b = E.ndcg(r), E.ndcg(r, discount="linear").withColumnRenamed("ndcg", "b")
    return a.join(b, "query").select("query", F.round("ndcg", 9).alias("log2"), F.round("b", 9).alias("linear"))


@query("v04_mean_reciprocal_rank", f"with {_RUNS} select round(avg(coalesce(1 / r, 0)), 9) as mrr from (select query, min(rank) filter (hit) as r from hits group by 1)", "store")
def _(s, d):
    return E.mean_reciprocal_rank(runs(s, d)).select(F.round("mrr", 9).alias("mrr"))


@query("v05_accuracy", "select round(avg(cast(quality = 1 - toxic as int)), 9) as accuracy from labels")
def _(s, d):
    return E.accuracy(A.table(s, d, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p").select(F.round("accuracy", 9).alias("accuracy"))


@query("v06_latency_stats", "select component, round(avg(latency), 6) as mean, round(median(latency), 6) as median, list_sort(list(latency))[cast(floor(count(*) * 0.95) as int) + 1] as p95, list_sort(list(latency))[cast(floor(count(*) * 0.99) as int) + 1] as p99, min(latency) as lowest, max(latency) as highest from latencies group by 1", "latencies")
def _(s, d):
    return E.latency_stats(A.latencies(s, d), "component", "latency").withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query("v07_error_analysis", "select round(avg(cast(success as int)), 9) as success_rate, round(avg(cast(not success as int)), 9) as failure_rate, count(*) filter (not success and user_id % 3 = 0) as unknown_failures from latencies", "latencies")
def _(s, d):
    rows = A.latencies(s, d).withColumn("kind", F.when(F.col("user_id") % 3 != 0, "timeout"))
    return E.error_analysis(rows, "success", "kind").select(F.round("success_rate", 9).alias("success_rate"), F.round("failure_rate", 9).alias("failure_rate"), F.element_at("failure_types", "unknown").alias("unknown_failures"))


_COMP = "comp as (select component, count(*) as total, count(*) filter (success) as successes, avg(cast(success as int)) as success_rate, avg(case when success then user_id % 5 else 0 end) as mean_results, min(case when success then user_id % 5 else 0 end) as min_results, max(case when success then user_id % 5 else 0 end) as max_results, avg(latency) as mean_latency from latencies group by 1)"


def components(s, d):
    return E.component_summary(A.latencies(s, d).withColumn("n", F.col("user_id") % 5), "component", "success", "n", "latency")


@query("v08_component_summary", f"with {_COMP} select component, total, successes, round(success_rate, 9) as success_rate, round(mean_results, 9) as mean_results, min_results, max_results, round(mean_latency, 6) as mean_latency from comp", "latencies")
def _(s, d):
    return components(s, d).withColumns({"success_rate": F.round("success_rate", 9), "mean_results": F.round("mean_results", 9), "mean_latency": F.round("mean_latency", 6)})


@query("v09_overall_summary", f"with {_COMP} select cast(sum(total) as bigint) as total, cast(sum(successes) as bigint) as successes, round(sum(successes) / sum(total), 9) as success_rate, round(avg(mean_latency), 6) as mean_of_means from comp", "latencies")
def _(s, d):
    return E.overall_summary(components(s, d)).withColumns({"success_rate": F.round("success_rate", 9), "mean_of_means": F.round("mean_of_means", 6)})


@query("v09_rollup_summary", "select component, count(*) as total, count(*) filter (success) as successes from latencies group by rollup(component)", "latencies")
def _(s, d):
    return E.rollup_summary(A.latencies(s, d), "component", "success")


@query("v10_gold_title_match", "select count(*) filter (contains(lower(title), 'and the') or contains(lower(title), 'tion')) as found_relevant from (select title from papers order by ord limit 20)", "papers")
def _(s, d):
    return E.gold_title_match(A.papers(s, d), ["And the", "tion"])


@query("w01_recent_history", "select id, row_number() over (partition by conversation_id order by created_at desc, id desc) as back from messages qualify back <= 3", "messages")
def _(s, d):
    return M.recent_history(A.messages(s, d), 3).select("id", F.col("back").cast("long").alias("back"))


@query("w02_retain_last_n", "select conversation_id, greatest(count(*) - 4, 0) as evicted from messages group by 1", "messages")
def _(s, d):
    return M.retain_last_n(A.messages(s, d), 4)[1]


@query("w02_retain_last_n_rows", "select id, role from messages qualify row_number() over (partition by conversation_id order by created_at desc, id desc) <= 4", "messages")
def _(s, d):
    return M.retain_last_n(A.messages(s, d), 4)[0].select("id", "role")


@query("w03_prune_expired", "select id from messages where created_at >= timestamp '2024-01-03 00:00:00' - to_seconds(90000)", "messages")
def _(s, d):
    return M.prune_expired(A.messages(s, d), 90000, F.to_timestamp(F.lit("2024-01-03 00:00:00")))[0].select("id")


@query("w03_evicted", "select count(*) as evicted from messages where created_at < timestamp '2024-01-03 00:00:00' - to_seconds(90000)", "messages")
def _(s, d):
    return M.prune_expired(A.messages(s, d), 90000, F.to_timestamp(F.lit("2024-01-03 00:00:00")))[1]


_REC = "rec as (select 'message' as kind, id, conversation_id, content from messages union all select 'task', task_id, request_id, agent || ' ' || status from tasks union all select 'result', event_id, user_id, component || case when success then ' done' else ' urgent' end from latencies union all select 'entity', p_partkey, p_size, p_name || ' ' || p_type from part)"


def records(s, d):
    m = A.messages(s, d).select(F.lit("message").alias("kind"), "id", "conversation_id", "content")
    tasks = A.tasks(s, d).select(F.lit("task"), "task_id", "request_id", F.concat_ws(" ", "agent", "status"))
    results = A.latencies(s, d).select(F.lit("result"), "event_id", "user_id", F.concat("component", F.when(F.col("success"), " done").otherwise(" urgent")))
    entities = A.table(s, d, "part").select(F.lit("entity"), "p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_type"))
    return m.union(tasks).union(results).union(entities)


@query("w04_keyword_search", f"with {_REC}, s as (select *, round((cast(contains(lower(content), 'pending') as int) + cast(contains(lower(content), 'tion') as int) + cast(contains(lower(content), 'urgent') as int)) / 3, 6) as score from rec) select kind, id, score, case when length(trim(content)) > 160 then rtrim(substr(trim(content), 1, 159)) || '…' else trim(content) end as snippet from s where score > 0 order by score desc, kind, id limit 50", "messages", "tasks", "latencies")
def _(s, d):
    return M.keyword_search(records(s, d), "Urgent tion pending", limit=50)


@query("w05_list_filter", "select task_id from tasks where status = 'pending' and agent = '1-URGENT'", "tasks")
def _(s, d):
    return M.list_filter(A.tasks(s, d), status="pending", agent="1-URGENT", request_id=None).select("task_id")


_SESS = "sess as (select conversation_id, max(created_at) as updated_at, count(*) as n_messages from messages group by 1)"


@query("w06_list_conversations", f"with {_SESS} select conversation_id, n_messages from sess order by updated_at desc, conversation_id limit 10 offset 20", "messages")
def _(s, d):
    return M.list_conversations(M.sessions_of(A.messages(s, d)), 10, 20).select("conversation_id", "n_messages")


#: Conversations with a user and a status: idle ones are expired, of the others those that end with the assistant completed.
_OWNED = _SESS + ", owned as (select s.*, conversation_id % 7 as user_id, case when updated_at < timestamp '2024-01-02 00:00:00' then 'expired' when n_messages % 2 = 0 then 'completed' else 'active' end as status from sess s)"


def owned(s, d):
    status = F.when(F.col("updated_at") < F.to_timestamp(F.lit("2024-01-02 00:00:00")), "expired").when(F.col("n_messages") % 2 == 0, "completed").otherwise("active")
    return M.sessions_of(A.messages(s, d)).withColumns({"user_id": F.col("conversation_id") % 7, "status": status})


@query("w06_list_conversations_of_user", f"with {_OWNED} select conversation_id, n_messages from owned where user_id = 3 and status = 'completed' order by updated_at desc, conversation_id limit 5 offset 1", "messages")
def _(s, d):
    return M.list_conversations(owned(s, d), 5, 1, user=3, status="completed").select("conversation_id", "n_messages")


@query("w08_conversation_stats_by_status", f"with {_OWNED} select count(*) as n_conversations, cast(sum(n_messages) as bigint) as n_messages, round(avg(n_messages), 6) as mean_messages, count(distinct user_id) as n_users, count(*) filter (status = 'active') as active, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'expired') as expired from owned", "messages")
def _(s, d):
    return M.conversation_stats(owned(s, d))


@query("w11_user_limits_active", f"with {_OWNED} select user_id, count(*) as n from owned where status = 'active' group by 1 having count(*) >= 2", "messages")
def _(s, d):
    return M.user_limits(owned(s, d), "user_id", 2, "status")


@query("w11_full_conversations", "select conversation_id, count(*) as n from messages group by 1 having count(*) >= 6", "messages")
def _(s, d):
    return M.full_conversations(A.messages(s, d), 6)


@query("w07_conversation_summary", "with f as (select conversation_id, arg_min(content, (created_at, id)) as f from messages where role = 'user' group by 1) select m.conversation_id, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, count(*) as n, cast(epoch(min(created_at)) as bigint) as first_at, cast(epoch(max(created_at)) as bigint) as last_at, any_value(case when length(f) > 50 then substr(f, 1, 50) || '...' else coalesce(f, '') end) as title from messages m left join f using (conversation_id) group by m.conversation_id", "messages")
def _(s, d):
    return M.conversation_summary(A.messages(s, d)).withColumns({"first_at": F.unix_timestamp("first_at"), "last_at": F.unix_timestamp("last_at")})


@query("w08_conversation_stats", f"with {_SESS} select count(*) as n_conversations, cast(sum(n_messages) as bigint) as n_messages, round(avg(n_messages), 6) as mean_messages from sess", "messages")
def _(s, d):
    return M.conversation_stats(M.sessions_of(A.messages(s, d)))


@query("w09_session_expiry", f"with {_SESS} select conversation_id, case when epoch(timestamp '2024-01-03 12:00:00') - epoch(updated_at) > 36000 then 'expired' else 'active' end as status from sess", "messages")
def _(s, d):
    return M.session_expiry(M.sessions_of(A.messages(s, d)), F.to_timestamp(F.lit("2024-01-03 12:00:00")), 36000).select("conversation_id", "status")


@query("w10_render_transcript", "select conversation_id, md5(string_agg('[' || upper(role) || '] ' || content, chr(10) order by created_at, id)) as h from messages group by 1", "messages")
def _(s, d):
    return M.render_transcript(A.messages(s, d)).select("conversation_id", F.md5("transcript").alias("h"))


@query("w10_render_last_turns", "select conversation_id, string_agg('[' || upper(role) || '] ' || substr(content, 1, 100), chr(10) order by created_at, id) as transcript from (select * from messages qualify row_number() over (partition by conversation_id order by created_at desc, id desc) <= 4) group by 1", "messages")
def _(s, d):
    return M.render_transcript(A.messages(s, d), last_turns=2)


@query("w11_user_limits", "select user_id, count(*) as n from events group by 1 having count(*) >= 70")
def _(s, d):
    return M.user_limits(A.table(s, d, "events"), "user_id", 70)


@query("w12_evict_oldest", "select task_id from tasks qualify row_number() over (partition by request_id order by cast(status in ('completed', 'failed', 'cancelled', 'timed_out') as int), created_at desc, task_id desc) <= 5", "tasks")
def _(s, d):
    return M.evict_oldest(A.tasks(s, d), ["request_id"], 5, "status").select("task_id")


@query("w13_ready_tasks", "select task_id from tasks where status = 'pending' and (dependency is null or dependency in (select task_id from tasks where status = 'completed'))", "tasks")
def _(s, d):
    t = A.tasks(s, d)
    return M.ready_tasks(t, t.select("task_id", "dependency")).select("task_id")


@query("w14_workflow_progress", "select request_id, round(100 * count(*) filter (status = 'completed') / count(*), 6) as progress, count(*) filter (status = 'pending') as pending, 0 as failed, count(*) filter (status = 'completed') as successful from tasks group by 1", "tasks")
def _(s, d):
    return M.workflow_progress(A.tasks(s, d))


@query("w15_aggregate_confidence", "select l_suppkey, round(avg(c), 9) as mean, max(c) as highest, min(c) as lowest, round(product(c), 12) as product from (select l_suppkey, least(greatest(1 - l_discount * 2, 0), 1) as c from lineitem) group by 1")
def _(s, d):
    a = M.aggregate_confidence(A.table(s, d, "lineitem").withColumn("c", 1 - F.col("l_discount") * 2), "l_suppkey", "c")
    return a.withColumns({"mean": F.round("mean", 9), "product": F.round("product", 12)})


@query("w16_overall_confidence", "select request_id, round(coalesce(least(1.0, avg(case when status = 'completed' then amount / 600000 end) * count(*) filter (status = 'completed') / count(*)), 0.5), 6) as confidence from tasks group by 1", "tasks")
def _(s, d):
    r = A.tasks(s, d).select("request_id", (F.col("status") == "completed").alias("ok"), (F.col("amount") / 600000).alias("c"))
    return M.overall_confidence(r, "request_id", "ok", "c").withColumn("confidence", F.round("confidence", 6))


@query("w17_merge_results", "select request_id, count(*) as total, count(*) filter (status = 'completed') as successful, count(*) filter (status <> 'completed') as failed, coalesce(list_sort(list(task_id) filter (status = 'completed')), []) as data, coalesce(list_sort(list(case when task_id % 2 = 0 then agent else 'Unknown error' end) filter (status <> 'completed')), []) as errors from tasks group by 1", "tasks")
def _(s, d):
    r = A.tasks(s, d).select("request_id", (F.col("status") == "completed").alias("ok"), "task_id", F.when(F.col("task_id") % 2 == 0, F.col("agent")).alias("error"))
    return M.merge_results(r, "request_id", "ok", "task_id", "error")


_BIB = "'@article{' || regexp_replace(coalesce(list_last(string_split(authors[1], ' ')), 'anon') || coalesce(cast(year as varchar), ''), '[^A-Za-z0-9]', '', 'g') || ',' || chr(10) || '  title={' || title || '},' || chr(10) || '  author={' || array_to_string(authors, ' and ') || '},' || chr(10) || '  journal={' || journal || '},' || chr(10) || '  year={' || coalesce(cast(year as varchar), '') || '},' || chr(10) || '  doi={' || coalesce(doi, '') || '}' || chr(10) || '}'"


@query("k03_export_bibtex", f"select ord, {_BIB} as entry from papers", "papers")
def _(s, d):
    from evidex.sources import sinks

    return sinks.bibtex(A.papers(s, d))


@query("k04_export_ris", "select ord, md5('TY  - JOUR' || chr(10) || 'AU  - ' || authors[1] || chr(10) || 'AU  - ' || authors[2] || chr(10) || 'TI  - ' || title || chr(10) || 'JO  - ' || journal || chr(10) || case when year is not null then 'PY  - ' || year || chr(10) else '' end || case when ord % 3 <> 1 then 'VL  - ' || ord % 40 || chr(10) else '' end || case when ord % 3 <> 2 then 'SP  - ' || ord % 900 || '-' || ord % 900 + 7 || chr(10) else '' end || case when doi is not null then 'DO  - ' || doi || chr(10) else '' end || case when abstract <> '' then 'AB  - ' || abstract || chr(10) else '' end || 'ER  - ') as entry from papers", "papers")
def _(s, d):
    from evidex.sources import sinks

    papers = A.papers(s, d).withColumn("volume", F.expr("case when ord % 3 <> 1 then cast(ord % 40 as string) end")).withColumn("pages", F.expr("case when ord % 3 <> 2 then concat(ord % 900, '-', ord % 900 + 7) end"))
    return sinks.ris(papers).withColumn("entry", F.md5("entry"))


def _exported(s, d, write, read):
    """Writes papers as files of the shared folder and reads them back."""
    import uuid

    from evidex.operators.graph import shared_folder

    path = f"{shared_folder(s)}/export-{uuid.uuid4().hex}"
    write(A.papers(s, d), path)
    return read(path)


@query("k01_export_csv", "select cast(ord as varchar) as ord, title, array_to_string(authors, '; ') as authors, doi, md5(abstract) as abstract from papers", "papers")
def _(s, d):
    from evidex.sources import sinks

    return _exported(s, d, sinks.export_csv, lambda p: s.read.csv(p, header=True, escape='"', multiLine=True, maxCharsPerColumn=-1).select("ord", F.coalesce("title", F.lit("")).alias("title"), "authors", "doi", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract")))


@query("k02_export_json", "select ord, title, authors, doi, year, md5(abstract) as abstract from papers", "papers")
def _(s, d):
    from evidex.sources import sinks

    return _exported(s, d, sinks.export_json, lambda p: s.read.schema("ord long, title string, authors array<string>, doi string, year int, abstract string").json(p).withColumn("abstract", F.md5("abstract")))
