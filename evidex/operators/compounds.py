"""Compound rules: property checks, fingerprints, rule-based targets and toxicity, funnels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import normalize_text, score_to_confidence
from evidex.operators.blocks import overlap_search, spread_join
from evidex.operators.graph import cut

#: The eight default target rules, by number: target id, name, type, gene, base confidence.
TARGET_RULES = (
    (0, "TGT_PBP", "Penicillin-binding protein", "enzyme", None, 0.75),
    (1, "TGT_CA", "Carbonic anhydrase", "enzyme", "CA2", 0.6),
    (2, "TGT_KINASE", "Protein kinase (ATP-binding site)", "enzyme", None, 0.55),
    (3, "TGT_COX", "Cyclooxygenase (COX-1/COX-2)", "enzyme", "PTGS2", 0.5),
    (4, "TGT_GABAA", "GABA-A receptor", "receptor", None, 0.65),
    (5, "TGT_STEROID_RECEPTOR", "Nuclear steroid hormone receptor", "receptor", None, 0.6),
    (6, "TGT_SUR1", "Sulfonylurea receptor (ABC transporter subunit)", "transporter", "ABCC8", 0.7),
    (7, "TGT_NUCLEOTIDE_ENZYME", "Nucleotide-processing enzyme", "enzyme", None, 0.45),
)
#: Functional groups in table order.
GROUPS = ("Carboxylic Acid", "Ester", "Amide", "Aldehyde", "Ketone", "Alcohol", "Phenol", "Ether", "Primary Amine", "Secondary Amine", "Tertiary Amine", "Thiol", "Benzene Ring", "Halogen")
#: Lipinski limits with the margins of the graded form.
LIMITS = (("mw", 500, 0.1), ("logp", 5, 0.1), ("hbd", 5, 0.2), ("hba", 10, 0.2))


def validate_compounds(compounds: DataFrame, key: str, structure: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with a reason). With ``strict`` it is an error if there are rows and all are rejected."""
    blank = lambda c: normalize_text(F.col(c).cast("string")).isNull()
    marked = compounds.withColumn("reason", F.when(blank(key), "missing compound id").when(blank(structure), "missing structure"))
    valid, rejects = marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
    if strict and valid.isEmpty() and not rejects.isEmpty():
        raise ValueError("all compounds are rejected")
    return valid, rejects


def _over(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) > limit for c, limit, _ in LIMITS]


def lipinski_violations() -> Column:
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in _over()), F.lit(0))


def lipinski_verdict() -> tuple[Column, Column]:
    """(PASS, WARNING or FAIL, map of checks); a null property fails its check."""
    checks = [F.coalesce(F.col(c) <= limit, F.lit(False)) for c, limit, _ in LIMITS]
    failed = sum((1 - c.cast("int") for c in checks), F.lit(0))
    verdict = F.when(failed == 0, "PASS").when(failed == 1, "WARNING").otherwise("FAIL")
    return verdict, F.map_from_arrays(F.array(*[F.lit(c) for c, _, _ in LIMITS]), F.array(*checks))


def lipinski_graded() -> list[Column]:
    """A grade for each rule (pass, warn within the margin, fail), then the overall grade."""
    grades = [F.when(F.col(c) <= limit, "pass").when(F.col(c) <= limit * (1 + margin), "warn").otherwise("fail") for c, limit, margin in LIMITS]
    fails = sum(((g == "fail").cast("int") for g in grades), F.lit(0))
    clean = sum(((g != "pass").cast("int") for g in grades), F.lit(0)) == 0
    overall = F.when(clean, "pass").when(fails <= 1, "warn").otherwise("fail")
    return [*[g.alias(c + "_grade") for g, (c, _, _) in zip(grades, LIMITS)], overall.alias("overall")]


def drug_likeness() -> Column:
    return F.round((4 - lipinski_violations()) / 4, 3)


def bioavailability() -> Column:
    return F.round((5 - lipinski_violations() - F.coalesce((F.col("rot") > 10).cast("int"), F.lit(0))) / 5, 3)


def size_lipophilicity_risk() -> Column:
    return F.when((F.col("mw") > 800) | (F.col("logp") > 7), "High").when((F.col("mw") > 500) | (F.col("logp") > 5), "Medium").otherwise("Low")


def tanimoto(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_compounds(queries: DataFrame, bits: DataFrame, threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """(query, compound_id, similarity, rank) by Tanimoto of bit sets, blocks of queries against blocks of compounds.

    ``queries`` (query) are compound ids of ``bits`` (compound_id, bit); pairs that share no bit are
    left out, whatever the threshold. A bit that all compounds have makes no rows.
    """
    sets = bits.groupBy("compound_id").agg(F.collect_set(F.col("bit").cast("long")).alias("keys"))
    own = sets.join(queries.select(F.col("query").alias("compound_id")).distinct(), "compound_id", "left_semi").withColumnRenamed("compound_id", "query")
    found = overlap_search(own, sets.withColumnRenamed("compound_id", "id"), top, "tanimoto", threshold)
    return found.select("query", F.col("id").alias("compound_id"), F.col("score").alias("similarity"), "rank")


#: Longs of a set's sketch, which bounds how many bits two sets can share.
SKETCH = 4


def _ordered_sets(bits: DataFrame) -> DataFrame:
    """(compound_id, set, n, s0, s1, ...): bits from rare to common, how many there are, and a sketch.

    A sketch has 64 * SKETCH places; each bit of the set turns one of them over, by its hash.
    """
    bits = bits.select("compound_id", "bit").distinct()
    freq = bits.groupBy("bit").agg(F.count("*").alias("f"))
    place = F.pmod(F.xxhash64("bit"), F.lit(64 * SKETCH)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
    sketch = [F.bit_xor(F.when(F.floor(place / 64) == k, one).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)]
    sets = bits.join(freq, "bit").groupBy("compound_id").agg(F.array_sort(F.collect_list(F.struct("f", "bit"))).alias("fb"), *sketch)
    return sets.select("compound_id", F.transform("fb", lambda x: x["bit"]).alias("set"), F.size("fb").alias("n"), *[f"s{k}" for k in range(SKETCH)])


def similarity_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of ordered sets that can be as similar as ``threshold``: few more than those that are.

    Two such sets share ceil(t / (1 + t) (na + nb)) bits, so they share one of the first n - ceil(t n) + 1
    of the larger and of the first n - ceil(2 t / (1 + t) n) + 1 of the smaller (prefix filter). Of the bits
    shared there all up to the last one are known, and after it there can't be more than the shorter rest
    (positional filter). Places in which their sketches differ are bits that only one of them has, which
    bounds the shared ones before anything is grouped. A bit that many prefixes have is dealt over tasks.
    """
    first = lambda share: F.greatest((F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"), F.lit(1))
    ks = [f"s{k}" for k in range(SKETCH)]
    prefix = sets.select("compound_id", "n", F.posexplode(F.slice("set", F.lit(1), first(threshold))).alias("pos", "bit"), *ks)
    prefix = cut(prefix)  # read for both sides, and to count
    small = prefix.filter(F.col("pos") < first(2 * threshold / (1 + threshold)))
    a, b = small.toDF("a", "na", "pa", "bit", *["a" + k for k in ks]), prefix.toDF("b", "nb", "pb", "bit", *["b" + k for k in ks])
    needed = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = smaller & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    apart = sum((F.bit_count(F.col("a" + k).bitwiseXOR(F.col("b" + k))) for k in ks[1:]), F.bit_count(F.col("a" + ks[0]).bitwiseXOR(F.col("b" + ks[0]))))
    at_most = 1 + F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    met = spread_join(a, b, "bit").filter(fits & (at_most >= needed) & (F.col("na") + F.col("nb") - apart >= 2 * needed))
    known = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    rest = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    return known.filter(F.col("c") + rest >= needed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similarity_join(bits: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, similarity) of different compounds with Tanimoto at ``threshold`` or more; candidates are compared exactly."""
    sets = cut(_ordered_sets(bits))
    pairs = similarity_candidates(sets, threshold)
    both = pairs.join(sets.select(F.col("compound_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("compound_id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", tanimoto(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)


def text_fingerprint(c: Column, q: int = 4, n_bits: int = 2048) -> Column:
    """Set bits of a string's q-grams (LINGO fingerprint); not equal to circular fingerprints."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(n_bits))))))


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TARGET_RULES), "rule int, target_id string, target string, target_type string, gene string, base double")


def rule_target_prediction(matches: DataFrame, rules: DataFrame, top: int = 5, least: float = 0.0) -> DataFrame:
    """Predictions for each compound: base confidence and 0.05 for each further match, at most 1."""
    confidence = F.least(F.lit(1.0), F.round(F.col("base") + 0.05 * (F.col("match_count") - 1), 6))
    scored = matches.filter("match_count > 0").join(rules, "rule").withColumn("confidence", confidence).filter(F.col("confidence") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("compound_id").orderBy(F.desc("confidence"), "target_id")).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("compound_id", "target_id", "target_type", "confidence", score_to_confidence(F.col("confidence")).alias("level"), "rank")


def functional_groups(matched: DataFrame) -> DataFrame:
    """(compound_id, groups): names of the groups that a compound has, in table order. ``matched`` has compound_id, group_no."""
    names = F.array(*[F.lit(g) for g in GROUPS])
    return matched.groupBy("compound_id").agg(F.transform(F.array_sort(F.collect_set("group_no")), lambda k: F.element_at(names, k + 1)).alias("groups"))


def lipophilicity_risk(logp: Column) -> Column:
    return F.least(F.greatest((logp - 3) / 7, F.lit(0.0)), F.lit(1.0))


def toxicity_assessment(compounds: DataFrame, alerts: DataFrame) -> DataFrame:
    """Adds endpoints (map), toxicity_score, toxicity_level and toxicity_confidence."""
    n = F.coalesce("n_alerts", F.lit(0))
    v = lipinski_violations()
    ends = {"structural_alerts": F.least(F.lit(1.0), 0.35 * n), "lipinski": F.least(F.lit(1.0), 0.25 * v), "lipophilicity": lipophilicity_risk(F.col("logp")), "qed": F.coalesce(1 - F.col("qed"), F.lit(0.5))}
    weights = {"structural_alerts": 0.35, "lipinski": 0.20, "lipophilicity": 0.20, "qed": 0.25}
    score = F.round(sum((w * ends[k] for k, w in weights.items()), F.lit(0.0)), 6)
    level = F.when(score < 0.3, "low").when(score < 0.6, "moderate").when(score < 0.85, "high").otherwise("severe")
    evidence = n + v
    sure = F.when(evidence >= 5, "very_high").when(evidence >= 3, "high").when(evidence >= 1, "medium").otherwise("low")
    joined = compounds.join(alerts, "compound_id", "left")
    pairs = [x for k, c in ends.items() for x in (F.lit(k), c)]
    return joined.withColumns({"endpoints": F.create_map(*pairs), "toxicity_score": score, "toxicity_level": level, "toxicity_confidence": sure, "violations": v})


#: The sentences that explain an assessment.
OVERALL = "Overall toxicity risk score is %s (category: %s)."
COMPLIANT = "Compound is fully compliant with Lipinski's Rule of Five."
VIOLATES = "Compound violates %d of Lipinski's Rule of Five criteria (MW=%s, LogP=%s), which may indicate reduced drug-likeness and elevated risk."
ALERTS = "%d PAINS/Brenk structural alert(s) detected: %s. These substructures are associated with assay interference or known reactivity and toxicity liabilities."
NO_ALERTS = "No PAINS or Brenk structural alerts were detected."
LIPOPHILIC = "Calculated LogP of %s exceeds 3.0, indicating elevated lipophilicity that is commonly associated with off-target binding and hepatotoxicity risk."
QED_LOW = "QED drug-likeness score of %s is relatively low, suggesting the compound's overall physicochemical profile is less favorable for further development."
QED_FINE = "QED drug-likeness score of %s indicates a reasonably favorable physicochemical profile."


def digits(c: Column, n: int) -> Column:
    """A number with ``n`` digits after the point."""
    return F.round(c.cast("decimal(38,9)"), n).cast(f"decimal(30,{n})").cast("string")


def toxicity_explanations(assessed: DataFrame, names: str = "alert_names") -> DataFrame:
    """Adds explanations to assessed compounds: overall, rule of five, alerts by name, lipophilicity and drug-likeness.

    ``names`` is an array of the alerts' names, if the table has it. A null QED counts as 0.5, as in the score;
    null properties are shown as such.
    """
    listed = F.coalesce(names, F.array().cast("array<string>")) if names in assessed.columns else F.array().cast("array<string>")
    shown = lambda c, n: F.coalesce(digits(F.col(c), n), F.lit("null"))
    qed = F.coalesce("qed", F.lit(0.5))
    lines = F.array_compact(
        F.array(
            F.format_string(OVERALL, digits(F.col("toxicity_score"), 2), "toxicity_level"),
            F.when(F.col("violations") == 0, COMPLIANT).otherwise(F.format_string(VIOLATES, "violations", shown("mw", 1), shown("logp", 2))),
            F.when(F.size(listed) > 0, F.format_string(ALERTS, F.size(listed), F.array_join(listed, ", "))).otherwise(NO_ALERTS),
            F.when(F.col("logp") > 3, F.format_string(LIPOPHILIC, shown("logp", 2))),
            F.when(qed < 0.5, F.format_string(QED_LOW, digits(qed, 2))).otherwise(F.format_string(QED_FINE, digits(qed, 2))),
        )
    )
    return assessed.withColumn("explanations", lines)


def screening_funnel(flags: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, passed, failed, skipped) by boolean columns, null where a stage was skipped."""
    one = flags.agg(*[F.struct(F.count_if(F.col(s)).alias("passed"), F.count_if(~F.col(s)).alias("failed"), F.count_if(F.col(s).isNull()).alias("skipped")).alias(s) for s in stages])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s)["passed"].alias("passed"), F.col(s)["failed"].alias("failed"), F.col(s)["skipped"].alias("skipped")) for s in stages])).alias("r")).select("r.*")


def predict_with(compounds: DataFrame, *engines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions of several engines; an engine is any function from compounds to predictions."""
    found = engines[0](compounds)
    for engine in engines[1:]:
        found = found.unionByName(engine(compounds), allowMissingColumns=True)
    return found
