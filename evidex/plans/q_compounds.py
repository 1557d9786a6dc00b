"""Queries of compound rules (C), repurposing evidence (R) and multi-criteria ranking (M), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidex import adapters as A
from evidex.functions.text import score_to_confidence
from evidex.operators import compounds as C
from evidex.operators import ranking as M
from evidex.operators import repurposing as R
from evidex.operators.graph import shared_folder

QUERIES, SQL = {}, {}


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = A.with_views(sql, *views) if views else sql
        return f

    return add


_VIOL = "(cast(mw > 500 as int) + cast(logp > 5 as int) + cast(hbd > 5 as int) + cast(hba > 10 as int))"
_LEVEL = "case when {0} >= 0.85 then 'very_high' when {0} >= 0.65 then 'high' when {0} >= 0.4 then 'medium' else 'low' end"
_RULES = "rules as (select * from (values " + ", ".join(f"({k}, '{t}', '{kind}', {base}::double)" for k, t, _, kind, _, base in C.TARGET_RULES) + ") v(rule, target_id, target_type, base))"


@query("c01_validate_compounds", "select compound_id, case when trim(coalesce(nm, '')) = '' then 'missing structure' end as reason from (select compound_id, case when compound_id % 10 = 0 then ' ' else name end as nm from compounds)", "compounds")
def _(s, d):
    c = A.compounds(s, d).withColumn("name", F.expr("case when compound_id % 10 = 0 then ' ' else name end"))
    valid, rejects = C.validate_compounds(c, "compound_id", "name")
    return valid.select("compound_id", F.lit(None).cast("string").alias("reason")).union(rejects.select("compound_id", "reason"))


@query("c02_lipinski_violations", f"select compound_id, {_VIOL} as violations, {_VIOL} = 0 as compliant from compounds", "compounds")
def _(s, d):
    v = C.lipinski_violations()
    return A.compounds(s, d).select("compound_id", v.alias("violations"), (v == 0).alias("compliant"))


@query("c03_lipinski_verdict", f"select compound_id, case {_VIOL} when 0 then 'PASS' when 1 then 'WARNING' else 'FAIL' end as verdict, mw <= 500 as mw_ok, hba <= 10 as hba_ok from compounds", "compounds")
def _(s, d):
    verdict, checks = C.lipinski_verdict()
    return A.compounds(s, d).select("compound_id", verdict.alias("verdict"), checks["mw"].alias("mw_ok"), checks["hba"].alias("hba_ok"))


_GRADE = "case when {c} <= {l} then 'pass' when {c} <= {l} * (1 + {m}) then 'warn' else 'fail' end as {c}_grade"


@query(
    "c04_lipinski_graded",
    "select *, case when mw_grade = 'pass' and logp_grade = 'pass' and hbd_grade = 'pass' and hba_grade = 'pass' then 'pass' when cast(mw_grade = 'fail' as int) + cast(logp_grade = 'fail' as int) + cast(hbd_grade = 'fail' as int) + cast(hba_grade = 'fail' as int) <= 1 then 'warn' else 'fail' end as overall from (select compound_id, "
    + ", ".join(_GRADE.format(c=c, l=limit, m=f"{m}::double") for c, limit, m in C.LIMITS)
    + " from compounds)",
    "compounds",
)
def _(s, d):
    return A.compounds(s, d).select("compound_id", *C.lipinski_graded())


@query("c05_drug_likeness", f"select compound_id, round((4 - {_VIOL}) / 4, 3) as drug_likeness, round((5 - {_VIOL} - cast(rot > 10 as int)) / 5, 3) as bioavailability from compounds", "compounds")
def _(s, d):
    return A.compounds(s, d).select("compound_id", C.drug_likeness().alias("drug_likeness"), C.bioavailability().alias("bioavailability"))


@query("c06_size_lipophilicity_risk", "select compound_id, case when mw > 800 or logp > 7 then 'High' when mw > 500 or logp > 5 then 'Medium' else 'Low' end as risk from compounds", "compounds")
def _(s, d):
    return A.compounds(s, d).select("compound_id", C.size_lipophilicity_risk().alias("risk"))


_SETS = "sets as (select compound_id, list_sort(list(bit)) as bs from bits group by compound_id)"


@query("c07_tanimoto", f"with {_SETS} select a.compound_id, round(len(list_intersect(a.bs, b.bs)) / (len(a.bs) + len(b.bs) - len(list_intersect(a.bs, b.bs))), 9) as t from sets a join sets b on b.compound_id = a.compound_id + 1", "bits")
def _(s, d):
    sets = A.bits(s, d).groupBy("compound_id").agg(F.collect_list("bit").alias("bs"))
    nxt = sets.select((F.col("compound_id") - 1).alias("compound_id"), F.col("bs").alias("other"))
    return sets.join(nxt, "compound_id").select("compound_id", F.round(C.tanimoto(F.col("bs"), F.col("other")), 9).alias("t"))


@query(
    "c08_similar_compounds",
    """with n as (select compound_id, count(*) as n from bits group by 1), c as (select q.compound_id as query, b.compound_id, count(*) as c from bits q join bits b using (bit) where q.compound_id % 20 = 0 and q.compound_id <> b.compound_id group by 1, 2)
select query, c.compound_id, round(c / (x.n + y.n - c), 9) as similarity, row_number() over (partition by query order by c / (x.n + y.n - c) desc, c.compound_id) as rank from c join n x on x.compound_id = query join n y on y.compound_id = c.compound_id qualify rank <= 10""",
    "bits",
)
def _(s, d):
    b = A.bits(s, d)
    q = b.select(F.col("compound_id").alias("query")).filter("query % 20 = 0").distinct()
    return C.similar_compounds(q, b, 0.0, 10).withColumn("similarity", F.round("similarity", 9))


@query(
    "c09_similarity_join",
    """with n as (select compound_id, count(*) as n from bits group by 1), c as (select a.compound_id as a, b.compound_id as b, count(*) as c from bits a join bits b using (bit) where a.compound_id < b.compound_id group by 1, 2)
select a, b, round(c / (x.n + y.n - c), 9) as similarity from c join n x on x.compound_id = a join n y on y.compound_id = b where c / (x.n + y.n - c) >= 0.45""",
    "bits",
)
def _(s, d):
    return C.similarity_join(A.bits(s, d), 0.45).withColumn("similarity", F.round("similarity", 9))


@query("c10_text_fingerprint", "select compound_id, list_sort(list_distinct(list_transform(range(1, greatest(length(name) - 4 + 1, 1) + 1), lambda i: cast(('0x' || substr(md5(substr(name, i, 4)), 1, 8)) as bigint) % 2048))) as fp from compounds", "compounds")
def _(s, d):
    return A.compounds(s, d).select("compound_id", C.text_fingerprint(F.col("name")).alias("fp"))


_PRED = f"""{_RULES}, scored as (select compound_id, target_id, target_type, least(1.0::double, round(base + 0.05::double * (match_count - 1), 6)) as confidence from matches join rules using (rule)),
predictions as (select *, {_LEVEL.format("confidence")} as level, row_number() over (partition by compound_id order by confidence desc, target_id) as rank from scored qualify rank <= 5)"""


def predictions(s, d):
    return C.rule_target_prediction(A.matches(s, d), C.rules_table(s), 5)


@query("c11_rule_target_prediction", f"with {_PRED} select * from predictions", "matches")
def _(s, d):
    return predictions(s, d)


@query("c12_functional_group_flags", "select l_partkey as compound_id, list_transform(list_sort(list(distinct l_suppkey % 14)), lambda k: ([" + ", ".join(f"'{g}'" for g in C.GROUPS) + "])[k + 1]) as groups from lineitem group by 1")
def _(s, d):
    return C.functional_groups(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("compound_id"), (F.col("l_suppkey") % 14).cast("int").alias("group_no")))


@query("c14_lipophilicity_risk", "select compound_id, round(least(greatest((logp - 3) / 7, 0), 1), 9) as risk from compounds", "compounds")
def _(s, d):
    return A.compounds(s, d).select("compound_id", F.round(C.lipophilicity_risk(F.col("logp")), 9).alias("risk"))


_TOX = f"""tox as (select *, case when toxicity_score < 0.3 then 'low' when toxicity_score < 0.6 then 'moderate' when toxicity_score < 0.85 then 'high' else 'severe' end as toxicity_level,
  case when n + violations >= 5 then 'very_high' when n + violations >= 3 then 'high' when n + violations >= 1 then 'medium' else 'low' end as toxicity_confidence from (
  select *, round(0.35::double * least(1, 0.35::double * n) + 0.2::double * least(1, 0.25::double * violations) + 0.2::double * least(greatest((logp - 3) / 7, 0), 1) + 0.25::double * coalesce(1 - qed, 0.5), 6) as toxicity_score
  from (select c.*, {_VIOL} as violations, coalesce(n_alerts, 0) as n from compounds c left join alerts using (compound_id))))"""


def assessed(s, d):
    return C.toxicity_assessment(A.compounds(s, d), A.alerts(s, d))


@query("c15_toxicity_assessment", f"with {_TOX} select compound_id, toxicity_score, toxicity_level, toxicity_confidence from tox", "compounds", "alerts")
def _(s, d):
    return assessed(s, d).select("compound_id", "toxicity_score", "toxicity_level", "toxicity_confidence")


def _sql(text):
    return text.replace("'", "''")


_DIGITS = "cast(round(cast({0} as decimal(38,9)), {1}) as varchar)"
_EXPLAINED = f"""named as (select l_partkey as compound_id, list_sort(list(distinct 'alert ' || l_orderkey % 5)) as names from lineitem where l_returnflag = 'R' group by 1),
said as (select compound_id, list_filter([
  printf('{_sql(C.OVERALL)}', {_DIGITS.format('toxicity_score', 2)}, toxicity_level),
  case when violations = 0 then '{_sql(C.COMPLIANT)}' else printf('{_sql(C.VIOLATES)}', violations, {_DIGITS.format('mw', 1)}, {_DIGITS.format('logp', 2)}) end,
  case when len(names) > 0 then printf('{_sql(C.ALERTS)}', len(names), array_to_string(names, ', ')) else '{_sql(C.NO_ALERTS)}' end,
  case when logp > 3 then printf('{_sql(C.LIPOPHILIC)}', {_DIGITS.format('logp', 2)}) end,
  case when coalesce(qed, 0.5) < 0.5 then printf('{_sql(C.QED_LOW)}', {_DIGITS.format('coalesce(qed, 0.5)', 2)}) else printf('{_sql(C.QED_FINE)}', {_DIGITS.format('coalesce(qed, 0.5)', 2)}) end], lambda x: x is not null) as explanations
  from tox left join named using (compound_id))"""


@query("c15_toxicity_explanations", f"with {_TOX}, {_EXPLAINED} select compound_id, explanations from said", "compounds", "alerts")
def _(s, d):
    line = A.table(s, d, "lineitem").filter("l_returnflag = 'R'")
    names = line.groupBy(F.col("l_partkey").alias("compound_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("alert "), F.col("l_orderkey") % 5))).alias("alert_names"))
    return C.toxicity_explanations(assessed(s, d).join(names, "compound_id", "left")).select("compound_id", "explanations")


@query("c17_screening_funnel", f"""with f as (select compound_id % 10 <> 0 as valid, qed > 0.3 as scored, case when compound_id % 10 <> 0 then {_VIOL} = 0 end as ranked from compounds)
select 'valid' as stage, count(*) filter (valid) as passed, count(*) filter (not valid) as failed, count(*) filter (valid is null) as skipped from f
union all select 'scored', count(*) filter (scored), count(*) filter (not scored), count(*) filter (scored is null) from f
union all select 'ranked', count(*) filter (ranked), count(*) filter (not ranked), count(*) filter (ranked is null) from f""", "compounds")  # fmt: skip
def _(s, d):
    f = A.compounds(s, d).select((F.col("compound_id") % 10 != 0).alias("valid"), (F.col("qed") > 0.3).alias("scored"), F.when(F.col("compound_id") % 10 != 0, C.lipinski_violations() == 0).alias("ranked"))
    return C.screening_funnel(f, ["valid", "scored", "ranked"])


_OVER = "overlap as (select compound_id, least(1.0::double, round(sum(least(confidence, q)) / 3, 6)) as overlap from (select compound_id, target_id, max(confidence) as confidence from predictions group by all) join (select target_id, max(confidence) as q from predictions where compound_id = 1 and rank <= 3 group by 1) using (target_id) group by compound_id)"


def overlap(s, d):
    p = predictions(s, d)
    return R.target_overlap(p, p.filter("compound_id = 1 and rank <= 3").select("target_id", "confidence"))


@query("r01_target_overlap_score", f"with {_PRED}, {_OVER} select o.compound_id, o.overlap, b.confidence as cox from overlap o left join (select compound_id, max(confidence) as confidence from predictions where target_id = 'TGT_COX' group by 1) b using (compound_id)", "matches")
def _(s, d):
    cox = R.target_score(predictions(s, d), "TGT_COX").withColumnRenamed("overlap", "cox")
    return overlap(s, d).join(cox, "compound_id", "left")


@query("r02_knowledge_graph_score", "select subject as candidate, least(1.0, max(confidence)) as graph, list_sort(list(distinct subject || ' ' || verb || ' ' || object)) as paths from relations where object = (select min(p_name) from part) group by 1", "relations")
def _(s, d):
    name = A.table(s, d, "part").agg(F.min("p_name").alias("n")).first().n
    edges = A.relations(s, d).select(F.col("subject").alias("src"), F.col("verb").alias("relation"), F.col("object").alias("dst"), "confidence")
    return R.graph_score(edges, name)


@query("r03_embedding_evidence", "select compound_id, least(greatest(coalesce(s, 0), 0), 1) as embedding from compounds left join (select vec_id as compound_id, max(round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)), 9)) as s from embeddings group by 1) using (compound_id)", "compounds")
def _(s, d):
    return R.embedding_evidence(A.compounds(s, d).select("compound_id"), similarities(s, d))


def similarities(s, d):
    from evidex.operators.vectors import cosine

    e = A.table(s, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 1").select(F.col("embedding").alias("q")))
    return e.crossJoin(one).select(F.col("vec_id").alias("compound_id"), F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))


_STRUCT = "structural as (select b.compound_id, round(count(*) / (any_value(n.n) + any_value(m.n) - count(*)), 9) as structural from bits q join bits b using (bit) join (select compound_id, count(*) as n from bits group by 1) n on n.compound_id = q.compound_id join (select compound_id, count(*) as n from bits group by 1) m on m.compound_id = b.compound_id where q.compound_id = 1 and b.compound_id <> 1 group by 1)"


def structural_hits(s, d):
    """Compounds that share a bit with compound 1."""
    one = s.range(1, 2).toDF("query")
    return C.similar_compounds(one, A.bits(s, d)).select("compound_id", F.round("similarity", 9).alias("similarity"))


def structural(s, d):
    c, b = A.compounds(s, d), A.bits(s, d)
    q = b.filter("compound_id = 1").select(F.col("compound_id").alias("query")).distinct()
    return R.structural_evidence(c, b, q).withColumn("structural", F.round("structural", 9))


@query("r04_structural_evidence", f"with {_STRUCT} select compound_id, coalesce(structural, 0) as structural from compounds left join structural using (compound_id)", "compounds", "bits")
def _(s, d):
    return structural(s, d)


_EVIDENCE = f"""emb as (select vec_id as compound_id, least(greatest(round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)), 9), 0), 1) as embedding from embeddings),
repurposed as (select compound_id, least(1.0::double, round(0.25::double * coalesce(structural, 0) + 0.3::double * coalesce(overlap, 0) + 0.2::double * coalesce(embedding, 0), 6)) as score from compounds left join structural using (compound_id) left join overlap using (compound_id) left join emb using (compound_id))"""


def repurposed(s, d, top):
    c = A.compounds(s, d)
    return R.repurposing_candidates(c, {"structural": structural(s, d), "overlap": overlap(s, d), "embedding": R.embedding_evidence(c.select("compound_id"), similarities(s, d))}, 0.1, top)


@query("r05_repurposing_candidates", f"with {_PRED}, {_OVER}, {_STRUCT}, {_EVIDENCE} select compound_id, score, {_LEVEL.format('score')} as level, row_number() over (order by score desc, compound_id) as rank from repurposed where score >= 0.1 qualify rank <= 50", "compounds", "bits", "matches")
def _(s, d):
    return repurposed(s, d, 50).select("compound_id", "score", "level", "rank")


#: Relations of compounds with a disease.
_NET = "net as (select p_partkey as compound_id, least(1, 0.5 + p_size / 100.0::double) as graph, ['drug ' || p_partkey || ' treats fever'] as paths from part where p_size % 5 = 0)"
_NOTE = "case when coalesce({0}, 0) > 0 then '{0} evidence ' || cast(round(cast({0} as decimal(38,9)), 2) as varchar) || ' (weight {1})' else 'no {0} evidence' end"
_FOUR = f"""{_NET}, four as (select compound_id, least(1.0::double, round({' + '.join(f'{w}::double * coalesce({k}, 0)' for k, w in R.WEIGHTS)}, 6)) as score,
  list_filter([{', '.join(_NOTE.format(k, w) for k, w in R.WEIGHTS)}, case when len(paths) > 0 then 'relations: ' || array_to_string(paths, '; ') end], lambda x: x is not null) as notes
  from compounds left join structural using (compound_id) left join overlap using (compound_id) left join emb using (compound_id) left join net using (compound_id))"""


def network(s, d):
    part = A.table(s, d, "part").filter("p_size % 5 = 0")
    edges = part.select(F.concat(F.lit("drug "), "p_partkey").alias("src"), F.lit("treats").alias("relation"), F.lit("fever").alias("dst"), (0.5 + F.col("p_size") / 100).alias("confidence"))
    return R.graph_score(edges, "fever").select(F.substring_index("candidate", " ", -1).cast("long").alias("compound_id"), "graph", "paths")


@query("r05_repurposing_four_kinds", f"with {_PRED}, {_OVER}, {_STRUCT}, {_EVIDENCE}, {_FOUR} select compound_id, score, notes, row_number() over (order by score desc, compound_id) as rank from four qualify rank <= 100", "compounds", "bits", "matches")
def _(s, d):
    c = A.compounds(s, d)
    kinds = {"structural": structural(s, d), "overlap": overlap(s, d), "embedding": R.embedding_evidence(c.select("compound_id"), similarities(s, d)), "graph": network(s, d)}
    return R.repurposing_candidates(c, kinds, 0.0, 100).select("compound_id", "score", "notes", "rank")


CRITERIA = ["qed", "logp", "tpsa", "mw"]
WEIGHTS = (("qed", 0.4, True), ("logp", 0.2, False), ("tpsa", 0.3, True), ("mw", 0.1, False))
_LONG = "weights as (select * from (values " + ", ".join(f"('{n}', {w}::double, {str(h).lower()})" for n, w, h in WEIGHTS) + ") v(criterion, weight, higher_is_better)),\nlong as (select * from (" + " union all ".join(f"select compound_id, '{c}' as criterion, {c} as value from compounds where {c} is not null" for c in CRITERIA) + ") join weights using (criterion))"


def long(s, d):
    w = F.broadcast(s.createDataFrame(list(WEIGHTS), "criterion string, weight double, higher_is_better boolean"))
    return M.criteria_long(A.compounds(s, d), "compound_id", CRITERIA).join(w, "criterion")


@query("m01_criteria_long", f"with {_LONG} select compound_id, criterion, value from long", "compounds")
def _(s, d):
    return long(s, d).select("compound_id", "criterion", "value")


_FLIP = "case when higher_is_better then x else 1 - x end"
_MINMAX = f"normed as (select *, {_FLIP} as normalized from (select *, case when max(value) over (partition by criterion) = min(value) over (partition by criterion) then 1 else (value - min(value) over (partition by criterion)) / (max(value) over (partition by criterion) - min(value) over (partition by criterion)) end as x from long))"


_SIX = " union all ".join(
    [
        "select compound_id, 'structural_similarity' as criterion, structural as value from structural", "select compound_id, 'target_confidence', max(confidence) from predictions group by 1", "select compound_id, 'toxicity_risk', toxicity_score from tox",
        "select compound_id, 'drug_likeness', qed from compounds where qed is not null", f"select compound_id, 'lipinski_violations', cast({_VIOL} as double) from compounds", "select compound_id, 'repurposing_evidence', score from repurposed where score >= 0.1",
        "select compound_id, 'novelty', (compound_id % 11) / 10.0::double from compounds where compound_id % 2 = 0",
    ]
)


@query("m01_criteria_from_evidence", f"with {_PRED}, {_OVER}, {_STRUCT}, {_EVIDENCE}, {_TOX} {_SIX}", "compounds", "bits", "matches", "alerts")
def _(s, d):
    c, tox = A.compounds(s, d), assessed(s, d)
    repurposing = repurposed(s, d, None).select("compound_id", "score")
    evidence = {"similarity": structural_hits(s, d), "targets": predictions(s, d), "toxicity": tox, "properties": tox, "repurposing": repurposing}
    custom = c.filter("compound_id % 2 = 0").select("compound_id", F.lit("novelty").alias("criterion"), (F.col("compound_id") % 11 / 10).alias("value"))
    return M.criteria_from_evidence("compound_id", evidence, custom)


@query("m02_normalize_min_max", f"with {_LONG}, {_MINMAX} select compound_id, criterion, round(normalized, 9) as normalized from normed", "compounds")
def _(s, d):
    return M.normalize_min_max(long(s, d)).select("compound_id", "criterion", F.round("normalized", 9).alias("normalized"))


@query("m03_normalize_clamp", f"with {_LONG} select compound_id, criterion, round({_FLIP}, 9) as normalized from (select *, least(greatest(value, 0), 1) as x from long)", "compounds")
def _(s, d):
    return M.normalize_clamp(long(s, d)).select("compound_id", "criterion", F.round("normalized", 9).alias("normalized"))


@query("m04_normalize_z_score", f"with {_LONG} select compound_id, criterion, round({_FLIP}, 6) as normalized from (select *, 1 / (1 + exp(-(value - avg(value) over (partition by criterion)) / stddev_pop(value) over (partition by criterion))) as x from long)", "compounds")
def _(s, d):
    return M.normalize_z_score(long(s, d)).select("compound_id", "criterion", F.round("normalized", 6).alias("normalized"))


def composite(s, d, strategy=M.weighted_sum):
    return M.combine(M.normalize_min_max(long(s, d)), "compound_id", strategy)


_SUM = "summed as (select compound_id, round(least(greatest(sum(weight * normalized) / sum(weight), 0), 1), 6) as composite from normed group by 1)"


@query("m05_weighted_sum", f"with {_LONG}, {_MINMAX}, {_SUM} select * from summed", "compounds")
def _(s, d):
    return composite(s, d).withColumn("composite", F.round("composite", 6))


@query("m06_weighted_geometric_mean", f"with {_LONG}, {_MINMAX} select compound_id, round(exp(sum(weight * ln(greatest(1e-6, normalized))) / sum(weight)), 6) as composite from normed group by 1", "compounds")
def _(s, d):
    return composite(s, d, M.weighted_geometric_mean).withColumn("composite", F.round("composite", 6))


@query("u01_ranking_strategy", f"with {_LONG}, {_MINMAX} select compound_id, round(min(normalized), 6) as composite from normed group by 1", "compounds")
def _(s, d):
    return composite(s, d, lambda value, weight: F.min(value)).withColumn("composite", F.round("composite", 6))


_CONF = "conf as (select compound_id, 0.5::double * count(*) / 4 + 0.5::double * coalesce(any_value(lv) / 3.0::double, 1 / 3.0::double) as confidence from long left join (select compound_id, avg(case level when 'very_high' then 3 when 'high' then 2 when 'medium' then 1 else 0 end) as lv from predictions group by 1) using (compound_id) group by 1)"


def confidences(s, d):
    covered = long(s, d).groupBy("compound_id").agg(F.count("*").alias("covered"))
    levels = predictions(s, d).groupBy("compound_id").agg(F.avg(M.ordinal(F.col("level"), M.CONFIDENCE_ORDER)).alias("lv"))
    c = M.candidate_confidence(F.col("covered"), len(CRITERIA), F.col("lv"))
    return covered.join(levels, "compound_id", "left").select("compound_id", c.alias("confidence"), score_to_confidence(F.round(c, 9)).alias("confidence_level"))


@query("m07_candidate_confidence", f"with {_LONG}, {_PRED}, {_CONF} select compound_id, round(confidence, 6) as confidence, {_LEVEL.format('round(confidence, 9)')} as confidence_level from conf", "compounds", "matches")
def _(s, d):
    return confidences(s, d).withColumn("confidence", F.round("confidence", 6))


_ALL = f"{_LONG}, {_MINMAX}, {_SUM}, {_PRED}, {_CONF}, {_TOX}, scored_all as (select compound_id, composite, toxicity_level, violations, {_LEVEL.format('round(confidence, 9)')} as confidence_level from summed join tox using (compound_id) join conf using (compound_id))"
_KEPT = "composite >= 0.3 and case toxicity_level when 'low' then 0 when 'moderate' then 1 when 'high' then 2 when 'severe' then 3 else 4 end <= 1 and violations = 0 and confidence_level in ('medium', 'high', 'very_high')"


def scored(s, d):
    c = composite(s, d).withColumn("composite", F.round("composite", 6))
    return c.join(assessed(s, d).select("compound_id", "toxicity_level", "violations"), "compound_id").join(confidences(s, d).drop("confidence"), "compound_id")


@query("m08_ranking_filter", f"with {_ALL} select compound_id from scored_all where {_KEPT}", "compounds", "matches", "alerts")
def _(s, d):
    return M.ranking_filter(scored(s, d), 0.3, "moderate", True, "medium").select("compound_id")


@query("u02_filter_predicates", f"with {_ALL} select compound_id from scored_all where composite > 0.5 and compound_id % 2 = 0", "compounds", "matches", "alerts")
def _(s, d):
    return M.ranking_filter(scored(s, d), predicates=[F.col("composite") > 0.5, F.col("compound_id") % 2 == 0]).select("compound_id")


@query("m09_rank_top_k", f"with {_LONG}, {_MINMAX}, {_SUM} select compound_id, composite, row_number() over (order by composite desc, compound_id) as rank from summed qualify rank <= 100", "compounds")
def _(s, d):
    return M.rank_top_k(composite(s, d).withColumn("composite", F.round("composite", 6)), "compound_id", 100)


@query("m09_filtered_out", f"with {_ALL} select count(*) as total, count(*) filter ({_KEPT}) as kept, count(*) filter (not ({_KEPT})) as filtered_out from scored_all", "compounds", "matches", "alerts")
def _(s, d):
    every = scored(s, d)
    return M.filtered_out(every, M.ranking_filter(every, 0.3, "moderate", True, "medium"), "compound_id")


@query("m10_explanations", f"""with {_LONG}, {_MINMAX}, {_SUM} select compound_id, list_concat([printf('Overall score %.3f', any_value(composite))], list(printf('%s: %.3f (weight %.1f%%)', criterion, round(normalized, 6), 100 * weight / tw) order by weight desc, criterion)) as lines
from (select *, sum(weight) over (partition by compound_id) as tw from normed) join summed using (compound_id) group by 1""", "compounds")  # fmt: skip
def _(s, d):
    n = M.normalize_min_max(long(s, d)).withColumn("normalized", F.round("normalized", 6))
    return M.explanations(n, composite(s, d).withColumn("composite", F.round("composite", 6)), "compound_id")


@query("m11_ranking_statistics", f"with {_LONG}, {_MINMAX}, {_SUM} select count(*) as n, round(avg(composite), 6) as mean, round(median(composite), 6) as median, round(stddev_pop(composite), 6) as std, min(composite) as lowest, max(composite) as highest from summed", "compounds")
def _(s, d):
    t = M.ranking_statistics(composite(s, d).withColumn("composite", F.round("composite", 6)))
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("m11_ranking_distributions", f"with {_ALL} select (select list(k || ':' || n order by k) from (select confidence_level as k, count(*) as n from scored_all group by 1)) as confidence_distribution, (select list(criterion || ':' || round(m, 6) order by criterion) from (select criterion, avg(normalized) as m from normed group by 1)) as criterion_averages", "compounds", "matches", "alerts")
def _(s, d):
    t = M.ranking_statistics(scored(s, d), level="confidence_level", normalized=M.normalize_min_max(long(s, d)))
    shown = lambda c, f: F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), f(e["value"]).cast("string")))
    return t.select(shown("confidence_distribution", lambda v: v).alias("confidence_distribution"), shown("criterion_averages", lambda v: F.round(v, 6)).alias("criterion_averages"))


_DOM = " and ".join(f"coalesce(b.{c} >= a.{c}, true)" for c in ("qed", "tpsa", "logp"))
_BETTER = " or ".join(f"coalesce(b.{c} > a.{c}, false)" for c in ("qed", "tpsa", "logp"))


@query("m12_pareto_frontier", f"select a.compound_id from compounds a where not exists (select 1 from (select distinct qed, tpsa, logp from compounds) b where {_DOM} and ({_BETTER}))", "compounds")
def _(s, d):
    return M.pareto_frontier(A.compounds(s, d), "compound_id", ["qed", "tpsa", "logp"])


@query("m13_ranked_candidates", f"with {_LONG}, {_MINMAX}, {_SUM}, r as (select compound_id, row_number() over (order by composite desc, compound_id) as rank from summed qualify rank <= 10) select compound_id, name, rank from compounds left join r using (compound_id)", "compounds")
def _(s, d):
    r = M.rank_top_k(composite(s, d).withColumn("composite", F.round("composite", 6)), "compound_id", 10)
    return M.ranked_candidates(A.compounds(s, d), r, "compound_id", "compound_id").select("compound_id", "name", "rank")


@query("m15_discovery_pipeline", f"""with {_ALL}, {_OVER}, {_STRUCT}, {_EVIDENCE},
final as (select compound_id, round(0.7::double * composite + 0.3::double * coalesce(score, 0), 6) as composite from scored_all left join repurposed using (compound_id) where {_KEPT})
select compound_id, composite, row_number() over (order by composite desc, compound_id) as rank from final qualify rank <= 25""", "compounds", "bits", "matches", "alerts")  # fmt: skip
def _(s, d):
    from evidex.plans.discovery import discovery

    return discovery(scored(s, d), structural(s, d), overlap(s, d), R.embedding_evidence(A.compounds(s, d).select("compound_id"), similarities(s, d)), top=25)


@query("m15_discovery_pipeline_compat", f"with {_ALL}, final as (select compound_id, composite from scored_all where {_KEPT}) select compound_id, composite, row_number() over (order by composite desc, compound_id) as rank from final qualify rank <= 25", "compounds", "matches", "alerts")
def _(s, d):
    from evidex.plans.discovery import discovery

    return discovery(scored(s, d), structural(s, d), overlap(s, d), R.embedding_evidence(A.compounds(s, d).select("compound_id"), similarities(s, d)), top=25, compat=True)


@query("m17_percentile", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) as p95, round(quantile_cont(l_quantity, 0.5), 6) as p50 from lineitem group by 1")
def _(s, d):
    line = A.table(s, d, "lineitem")
    price, quantity = M.percentiles(line, "l_returnflag", "l_extendedprice", {"p95": 95}), M.percentiles(line, "l_returnflag", "l_quantity", {"p50": 50})
    return price.join(quantity, "l_returnflag").select("l_returnflag", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


@query("u03_pluggable_engines", f"with {_PRED} select compound_id, target_id, confidence from predictions union all select compound_id, 'TGT_LIGHT', 0.5 from compounds where mw < 300", "matches", "compounds")
def _(s, d):
    rules = lambda c: C.rule_target_prediction(A.matches(s, d), C.rules_table(s), 5).join(c.select("compound_id"), "compound_id", "left_semi")
    light = lambda c: c.filter("mw < 300").select("compound_id", F.lit("TGT_LIGHT").alias("target_id"), F.lit(0.5).alias("confidence"))
    return C.predict_with(A.compounds(s, d), rules, light).select("compound_id", "target_id", "confidence")


_SHEET = "{_L}, r as (select compound_id, composite, row_number() over (order by composite desc, compound_id) as rank from summed qualify rank <= 100), priced as (select * from tox where compound_id % 3 > 0)".replace("{_L}", f"{_LONG}, {_MINMAX}, {_SUM}, {_TOX}")
_TEXT = "cast(round(cast({0} as decimal(38,9)), {1}) as varchar)"


@query(
    "k08_export_ranking_csv",
    f"with {_SHEET} select rank, compound_id, coalesce(name, '') as name, coalesce(brand, '') as structure, {_TEXT.format('composite', 3)} as score, 'ranked' as status, coalesce({_TEXT.format('c.mw', 2)}, '') as mw, coalesce({_TEXT.format('c.logp', 2)}, '') as logp, {_VIOL.replace('mw', 'c.mw').replace('logp', 'c.logp').replace('hbd', 'c.hbd').replace('hba', 'c.hba')} as violations, coalesce(p.toxicity_level, '') as toxicity_level, coalesce({_TEXT.format('p.toxicity_score', 3)}, '') as toxicity_score from r join compounds c using (compound_id) left join (select compound_id, toxicity_level, toxicity_score from priced) p using (compound_id)",
    "compounds",
    "alerts",
)
def _(s, d):
    from evidex.sources import sinks

    r = M.rank_top_k(composite(s, d).withColumn("composite", F.round("composite", 6)), "compound_id", 100)
    path = f"{shared_folder(s)}/ranking-{uuid.uuid4().hex}"
    sheet = sinks.ranking_sheet(r, A.compounds(s, d).withColumn("violations", C.lipinski_violations()), assessed(s, d).filter("compound_id % 3 > 0"), structure="brand", status=F.lit("ranked"))
    sinks.export_csv(sheet, path)
    schema = "rank long, compound_id long, name string, structure string, score string, status string, mw string, logp string, violations int, toxicity_level string, toxicity_score string"
    return s.read.schema(schema).csv(path, header=True, escape='"').fillna("")
