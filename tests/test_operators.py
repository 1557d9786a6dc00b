"""Rules on small literal tables: exact values, null rules and metamorphic checks."""

import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from evidex.functions import querytext as Q
from evidex.functions import text as T
from evidex.operators import compounds as C
from evidex.operators import evaluation as E
from evidex.operators import graph as G
from evidex.operators import literature as L
from evidex.operators import memory as W
from evidex.operators import ranking as M
from evidex.operators import vectors as V


def one(spark, column, *values, schema=None):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema or "c string").select(column(F.col("c"))).collect()]


def test_text_rules(spark):
    assert one(spark, T.normalize_text, "  a \n b ", " ", None) == ["a b", None, None]
    assert one(spark, lambda c: T.truncate_text(c, 5), "abcdef", "abc", None) == ["ab...", "abc", None]
    assert one(spark, lambda c: T.truncate_text(c, 2), "abcdef") == [".."]
    assert one(spark, T.is_meaningful_label, "EGFR", "we", "the", "p=0.01", "12", "a b c d e f g h", "", None, "P5") == [True, False, False, False, False, False, False, False, False]
    assert one(spark, T.is_plausible_smiles, "CC(=O)O", "CC(", ")(", "a b", "", None) == [True, False, False, False, False, False]
    assert one(spark, T.score_to_confidence, 0.85, 0.65, 0.4, 0.39, schema="c double") == ["very_high", "high", "medium", "low"]
    assert one(spark, lambda c: T.chunked(c, 2), [1, 2, 3], [], schema="c array<int>") == [[[1, 2], [3]], []]


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (7, 6)])
def test_chunks_match_the_loop(spark, size, overlap):
    texts = ["x" * n if n % 2 else ("ab " * n)[:n].strip() for n in range(1, 60)]
    got = {}
    for r in T.chunk_text(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", size, overlap).select("id", "chunk_index", "chunk").collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.chunk))
    for i, t in enumerate(texts):
        t, start, out = " ".join(t.split()), 0, []
        while True:
            piece = t[start : start + size].strip()
            if piece:
                out.append(piece)
            if start + size >= len(t):
                break
            start += size - overlap
        assert [c for _, c in sorted(got.get(i, []))] == out
    with pytest.raises(ValueError):
        T.chunk_text(spark.range(1).withColumn("t", F.lit("x")), "t", 5, 5)


def long(spark, values, higher=True):
    return spark.createDataFrame([(k, "c", float(v), 1.0, higher) for k, v in values.items()], "id string, criterion string, value double, weight double, higher_is_better boolean")


def test_normalizers(spark):
    got = lambda df: {r.id: round(r.normalized, 9) for r in df.collect()}
    assert got(M.normalize_min_max(long(spark, {"a": 0, "b": 0.5, "c": 1}))) == {"a": 0, "b": 0.5, "c": 1}
    assert got(M.normalize_min_max(long(spark, {"a": 2, "b": 2}))) == {"a": 1, "b": 1}
    assert got(M.normalize_min_max(long(spark, {"a": 2, "b": 2}, False))) == {"a": 0, "b": 0}
    assert got(M.normalize_clamp(long(spark, {"a": -0.5, "b": 0.5, "c": 1.5}))) == {"a": 0, "b": 0.5, "c": 1}
    assert got(M.normalize_z_score(long(spark, {"a": 1, "b": 1}))) == {"a": 1, "b": 1}


def test_combine_and_weights(spark):
    rows = spark.createDataFrame([("x", 0.8, 1.0), ("x", 0.6, 1.0), ("y", 0.5, 0.0)], "id string, normalized double, weight double")
    assert {r.id: round(r.composite, 9) for r in M.combine(rows, "id").collect()} == {"x": 0.7, "y": 0.0}
    assert {r.id: round(r.composite, 6) for r in M.combine(rows, "id", M.weighted_geometric_mean).collect()} == {"x": round(math.sqrt(0.48), 6), "y": 0.0}


def test_pareto_with_gaps_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(k, *[None if rng.random() < 0.2 else float(rng.randrange(6)) for _ in range(3)]) for k in range(80)]
    got = {r.id for r in M.pareto_frontier(spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(5), "id", ["a", "b", "c"]).collect()}

    def beats(x, y):
        shared = [(p, q) for p, q in zip(x[1:], y[1:]) if p is not None and q is not None]
        return all(p >= q for p, q in shared) and any(p > q for p, q in shared)

    assert got == {y[0] for y in rows if not any(beats(x, y) for x in rows)}


def test_pareto_cells_match_brute_force(spark, monkeypatch):
    """Many cells, equal sums, NaN and infinite values; then a front that holds every row."""
    import random

    rng = random.Random(6)
    for d, n in ((1, 50), (2, 600), (4, 500)):
        names = list("abcd")[:d]
        rows = [(k, *[rng.choice([float(rng.randrange(30)), float(rng.randrange(30)), math.inf, -math.inf]) for _ in range(d)]) for k in range(n)]
        got = {r.id for r in M.pareto_frontier(spark.createDataFrame(rows, f"id int, {', '.join(x + ' double' for x in names)}").repartition(4), "id", names).collect()}
        beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
        assert got == {y[0] for y in rows if not any(beats(x, y) for x in rows)}
    odd = spark.createDataFrame([(1, math.nan, 3.0), (2, None, 2.0), (3, 1.0, 1.0), (4, math.nan, 3.0)], "id int, a double, b double")
    assert {r.id for r in M.pareto_frontier(odd, "id", ["a", "b"]).collect()} == {1, 4}


def test_pareto_of_anti_correlated_rows(spark):
    """200,000 rows, none of which dominates another: all with all would be 4 x 10^10 pairs."""
    rows = spark.range(200_000).select("id", F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    begun = time.time()
    assert M.pareto_frontier(rows, "id", ["a", "b"]).count() == 200_000
    assert time.time() - begun < 120


def test_percentile_interpolates(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", None), ("c", 7.0), ("c", 7.0), ("c", 9.0)]
    got = M.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", {"mid": 50, "high": 95}).collect()
    assert {r.g: (r.mid, round(r.high, 9)) for r in got} == {"a": (2.5, 3.85), "b": (0.0, 0.0), "c": (7.0, 8.8)}


def test_similarity_join_matches_all_pairs(spark):
    import random

    rng = random.Random(9)
    sets = {k: set(rng.sample(range(40), rng.randrange(1, 15))) for k in range(60)}
    sets |= {100 + k: s | {99} for k, s in list(sets.items())[:15]}
    bits = spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "compound_id int, bit int")
    for t in (0.3, 0.6, 0.9):
        got = {(r.a, r.b): round(r.similarity, 9) for r in C.similarity_join(bits, t).collect()}
        assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_similarity_join_with_a_bit_in_every_set(spark, monkeypatch):
    """A bit that all sets have, and prefixes full of it: pairs stay right, few candidates are no pairs, hot bits are dealt out."""
    import random

    from evidex.operators import blocks

    monkeypatch.setattr(blocks, "TOGETHER", 10)
    monkeypatch.setattr(blocks.spread_join, "__defaults__", (10,))
    rng = random.Random(3)
    sets = {k: {0, *rng.sample(range(1, 60), rng.randrange(0, 12))} for k in range(150)}
    bits = spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "compound_id int, bit int")
    for t in (0.4, 0.7):
        expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in C.similarity_join(bits, t).collect()} == expected
        found = {(r.a, r.b) for r in C.similarity_candidates(C._ordered_sets(bits), t).collect()}
        prefix_only = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}
        assert expected <= found and len(found) < len(prefix_only) / 4


def test_similarity_candidates_of_large_sets(spark):
    """Sets of 30 bits with bits in common everywhere: hardly a pair is a candidate that isn't alike."""
    import random

    rng = random.Random(4)
    sets = {k: set(rng.sample(range(200), 30)) for k in range(300)}
    sets |= {1000 + k: (s - set(sorted(s)[:5])) | {500 + k} for k, s in list(sets.items())[:20]}
    bits = spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "compound_id int, bit int")
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.45}
    found = {(r.a, r.b) for r in C.similarity_candidates(C._ordered_sets(bits), 0.45).collect()}
    assert alike <= found and len(alike) >= 20 and len(found) < 2 * len(alike)
    assert {(r.a, r.b) for r in C.similarity_join(bits, 0.45).collect()} == alike


def test_lipinski_nulls(spark):
    df = spark.createDataFrame([(510.0, None, 6, 3), (100.0, 1.0, 1, 1)], "mw double, logp double, hbd int, hba int")
    verdict, checks = C.lipinski_verdict()
    assert [(r.v, r.w) for r in df.select(C.lipinski_violations().alias("v"), verdict.alias("w")).collect()] == [(2, "FAIL"), (0, "PASS")]


def test_graph_merges_surface_forms(spark):
    rel = spark.createDataFrame([("Aspirin", "inhibit", "COX-1", 0.8, "p1", "2024-01-01"), ("  aspirin ", "INHIBIT", "cox-1", 0.95, "p2", "2024-01-02"), (" ", "x", "y", 0.1, "p3", "2024-01-03")], "subject string, verb string, object string, confidence double, source string, ts string").withColumn("ts", F.to_timestamp("ts"))
    (e,) = G.build_edges(rel).collect()
    assert (e.src, e.dst, e.relation, e.confidence, e.merge_count, e.source) == ("aspirin", "cox-1", "inhibit", 0.95, 2, "p2")
    s = G.build_summary(rel).first()
    assert (s.relations_added, s.relations_skipped) == (2, 1)
    a, b = (G.build_edges(rel.filter(f"source = '{p}'"), lists=True) for p in ("p1", "p2"))
    e = G.merge_edges(a, b).first()
    assert (e.confidence, e.all_sources, e.n_sources) == (0.95, ["p1", "p2"], 2)
    assert "n_sources" not in G.merge_edges(a.drop("all_sources"), b).columns
    assert {tuple(r) for r in G.edge_sources(rel).collect()} == {("aspirin", "cox-1", "inhibit", "p1"), ("aspirin", "cox-1", "inhibit", "p2")}


def test_graph_merges_nodes(spark):
    rows = [("ASPIRIN", "DRUG", "p1", "2024-01-02"), (" aspirin", "CHEMICAL", "p2", "2024-01-01"), ("aspirin", "DRUG", "p2", "2024-01-03"), ("pain", "SYMPTOM", "p3", "2024-01-01"), (" ", "X", "p3", "2024-01-01")]
    m = spark.createDataFrame(rows, "text string, label string, source string, ts string").withColumn("ts", F.to_timestamp("ts"))
    none = spark.createDataFrame([], "subject string, object string, source string, ts timestamp")
    whole = G.build_nodes(m, none, lists=True)
    parts = [G.build_nodes(m.filter(c), none, lists=True) for c in ("ts = '2024-01-02'", "ts <> '2024-01-02'")]
    rows_of = lambda df: sorted(tuple(r) for r in df.select(*whole.columns).collect())
    assert rows_of(G.merge_nodes(*parts)) == rows_of(whole)
    (a,) = [r for r in whole.collect() if r.id == "aspirin"]
    assert (a.canonical_name, a.labels, a.mention_count, a.sources, a.n_sources) == (" aspirin", ["CHEMICAL", "DRUG"], 3, ["p1", "p2"], 2)
    assert {tuple(r) for r in G.node_sources(m, none).collect()} == {("aspirin", "p1"), ("aspirin", "p2"), ("pain", "p3")}


def test_mentions_of_rows_with_one_key(spark):
    docs = spark.createDataFrame([(1, "Beta, gamma alpha"), (1, "gamma alpha"), (2, None), (2, "Alpha--beta ALPHA")], "id int, t string")
    patterns = spark.createDataFrame([("A", "alpha"), ("B", "Alpha  Beta"), ("C", "...")], "label string, pattern string")
    got = sorted(tuple(r) for r in G.extract_mentions(docs, "id", "t", patterns).collect())
    assert got == [(1, "A", "alpha", 6, 11), (1, "A", "alpha", 12, 17), (2, "A", "alpha", 0, 5), (2, "A", "alpha", 12, 17), (2, "B", "alpha beta", 0, 11)]
    assert "Exchange hashpartitioning(key" not in G.extract_mentions(docs, "id", "t", patterns)._jdf.queryExecution().toString()


def test_keywords_of_rows_with_one_key(spark):
    import collections
    import random
    import re

    rng = random.Random(3)
    texts = [None, "", "the and", "zeta zeta beta beta gamma"] + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zetas", "theta"]) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = [(k % 3, t) for k, t in enumerate(texts)]
    got = collections.Counter((r.id, tuple(r.keywords)) for r in T.extract_keywords_4(spark.createDataFrame(rows, "id int, t string"), "id", "t", 3).collect())
    words = [(k, [w for w in re.findall("[a-zA-Z]{4,}", (t or "").lower()) if w not in T.STOP_4]) for k, t in rows]
    assert got == collections.Counter((k, tuple(w for w, _ in collections.Counter(ws).most_common(3))) for k, ws in words if ws)


def test_overlap_search_matches_sets(spark):
    import random

    from evidex.operators import blocks

    rng = random.Random(5)
    sets = {k: set(rng.sample(range(30), rng.randrange(0, 12))) | ({99} if k % 2 else set()) for k in range(70)}
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, keys array<long>").repartition(5)
    asked = rows.filter("id % 3 = 0").withColumnRenamed("id", "query")
    for measure in ("count", "tanimoto"):
        value = lambda a, b: float(len(a & b)) if measure == "count" else len(a & b) / len(a | b)  # noqa: E731, B023
        wanted = {q: sorted(((-value(sets[q], s), k) for k, s in sets.items() if k != q and sets[q] & s)) for q in sets if q % 3 == 0}
        got = {(r.query, r.rank): (-r.score, r.id) for r in blocks.overlap_search(asked, rows, 4, measure, query_rows=7).collect()}
        assert got == {(q, k + 1): x for q, xs in wanted.items() for k, x in enumerate(xs[:4])}
        every = {(r.query, r.id): r.score for r in blocks.overlap_search(asked, rows, None, measure, 0.3 if measure == "tanimoto" else 2).collect()}
        assert every == {(q, k): -s for q, xs in wanted.items() for s, k in xs if -s >= (0.3 if measure == "tanimoto" else 2)}


def test_ranks_without_a_limit(spark):
    from evidex.operators import repurposing as R

    c = spark.createDataFrame([(k, (k * 7 % 13) / 13) for k in range(40)], "compound_id long, graph double").repartition(6)
    a = {r.compound_id: r.rank for r in R.repurposing_candidates(c, {"graph": c}).collect()}
    b = {r.compound_id: r.rank for r in R.repurposing_candidates(c, {"graph": c}, top=40).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 41))


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], "src string, dst string, relation string, confidence double")


def test_paths_and_components(spark):
    e = edges(spark, ("aspirin", "cox-1"), ("cox-1", "inflammation"), ("x", "y"))
    p = G.shortest_path(e, "Aspirin", "inflammation").first()
    assert (p.found, p.path, p.length) == (True, ["aspirin", "cox-1", "inflammation"], 2)
    assert G.shortest_path(e, "inflammation", "aspirin").first().found is False
    assert G.shortest_path(e, "aspirin", "nobody").first().path == []
    assert G.shortest_path(e, "x", "X").first().length == 0
    nodes = spark.createDataFrame([(n,) for n in ("aspirin", "cox-1", "inflammation", "x", "y", "alone")], "id string")
    assert {r.id: r.component for r in G.connected_components(nodes, e).collect()} == {"aspirin": "aspirin", "cox-1": "aspirin", "inflammation": "aspirin", "x": "x", "y": "x", "alone": "alone"}


def test_graph_statistics_of_nothing(spark):
    nodes, e = spark.createDataFrame([], "id string"), edges(spark).limit(0)
    s = G.graph_statistics(nodes, e).first()
    assert (s.n_nodes, s.n_edges, s.density, s.n_components, s.edges_per_node) == (0, 0, 0.0, 0, 0.0)


def test_svo(spark):
    docs = spark.createDataFrame([(1, "Aspirin inhibits COX. It was not activated by the drug.")], "id int, t string")
    rows = G.extract_svo(docs, "id", "t", {"inhibits": "inhibit", "activated": "activate"}).orderBy("sentence_no").collect()
    assert [(r.subject, r.verb, r.passive, r.negated) for r in rows] == [("Aspirin", "inhibit", False, False), ("It", "activate", True, True)]


def test_leader_clusters_match_the_loop(spark, sf):
    import numpy as np

    store = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = sorted((r.id, np.array(r.vector, float)) for r in store.collect())
    leader = {}
    for i, (a, x) in enumerate(rows):
        if a not in leader:
            leader[a] = a
            for b, y in rows[i + 1 :]:
                if b not in leader and round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9) >= 0.3:
                    leader[b] = a
    assert {r.id: r.leader for r in V.cluster_leader(store, 0.3).collect()} == leader


def test_search_is_the_same_however_rows_are_dealt(spark, sf):
    store = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = store.filter("id < 30").select(F.col("id").alias("query"), "vector")
    a = sorted(tuple(r) for r in V.vector_search(store, queries, 5).collect())
    b = sorted(tuple(r) for r in V.vector_search(store.repartition(7), queries, 5).collect())
    assert a == b and len(a) == 150
    with pytest.raises(KeyError):
        V.find_similar(store, [10**9], 3)


def test_metrics(spark):
    runs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query int, item string, rank int")
    qrels = spark.createDataFrame([(1, "b"), (1, "z"), (3, "q")], "query int, item string")
    got = {r.query: (r.precision, r.recall, round(r.f1, 6)) for r in E.precision_recall_f1(runs, qrels).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert round(E.mean_average_precision(runs, qrels).first().map, 9) == round(0.25 / 3, 9)
    assert round(E.mean_reciprocal_rank(runs, qrels).first().mrr, 9) == round(0.5 / 3, 9)


def test_boolean_queries(spark):
    q = 'heart "lung cancer" OR trial study NOT mouse'
    (p,) = one(spark, Q.parse_boolean_query, q)
    assert (p.phrases, p.must, p.should, p.must_not) == (["lung cancer"], ["heart"], ["trial", "study"], ["mouse"])
    docs = spark.createDataFrame([(1, "Heart and lung cancer TRIAL"), (2, "heart lung cancer"), (3, "heart lung cancer study in mouse")], "id int, t string")
    assert [r.id for r in Q.match_queries(docs, "t", spark.createDataFrame([(1, q)], "query_id int, query string")).collect()] == [1]
    valid = spark.createDataFrame([(x,) for x in (None, " ", "ab", "AB", "123", "...", "xkcdbr", "lung cancer")], "q string").select(*Q.validate_query(F.col("q")))
    assert [r.is_valid for r in valid.collect()] == [False, False, False, True, False, False, False, True]
    assert one(spark, Q.route_first_match, "tell me about paper 3", "compare a and b", "hello") == ["paper_detail", "compare", "general"]


def test_queries_beyond_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 5}") for k in range(40)], "id int, t string")
    asked = spark.createDataFrame([(k, f"word{k % 9} NOT word{k % 4}") for k in range(50)] + [(99, None)], "query_id int, query string")
    few = sorted((r.id, r.query_id) for r in Q.match_queries(docs, "t", asked).collect())
    monkeypatch.setattr(Q, "MOST_QUERIES", 8)
    assert sorted((r.id, r.query_id) for r in Q.match_queries(docs, "t", asked).collect()) == few and len(few) > 40


def test_hashed_embedding_by_hand(spark):
    """Words by their hash bucket, counts to length 1; blank texts have no row."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    texts = {1: "b a  A a", 2: " ", 3: None, 4: "x"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r.id: r.v for r in V.embed_hashed_table(df, "id", "t", 16).select("id", vector_to_array("vector").alias("v")).collect()}
    tf = HashingTF(inputCol="w", outputCol="o", numFeatures=16)
    expected = {}
    for k in (1, 4):
        v = [0.0] * 16
        for w in texts[k].lower().split():
            v[tf.indexOf(w)] += 1
        size = math.sqrt(sum(x * x for x in v))
        expected[k] = [x / size for x in v]
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_judgements_by_label_equal_judgements_by_rows(spark):
    labels = spark.createDataFrame([(k, None if k == 11 else f"l{k % 3}") for k in range(12)], "id long, label string")
    runs = spark.createDataFrame([(q, (q * 5 + r * 3) % 14, r) for q in (0, 3, 4, 11, 77) for r in range(1, 6)], "query long, item long, rank long")
    asked = spark.createDataFrame([(q,) for q in (0, 3, 4, 7, 11, 77)], "query long")
    own = labels.toDF("query", "l").join(asked, "query")
    qrels = own.join(labels.toDF("item", "l"), "l").filter("query <> item").select("query", "item")
    rows, by = E.judge(runs, qrels.union(spark.createDataFrame([(11, 500), (77, 500)], "query long, item long"))), E.judge_by_label(runs, labels, asked)
    hits = lambda j: sorted((r.query, r.item, r["rank"], r.hit) for r in j.hits.collect())
    assert hits(rows) == hits(by)
    n = {r.query: r.n_rel for r in by.queries.collect()}
    assert n == {0: 3, 3: 3, 4: 3, 7: 3, 11: 0, 77: 0}
    assert {r.query: r.precision for r in E.precision_recall_f1(by).collect()}[0] == {r.query: r.precision for r in E.precision_recall_f1(rows).collect()}[0]


def test_quantiles_of_many_values(spark, monkeypatch):
    from evidex.operators import blocks

    rows = spark.range(500).selectExpr("id % 3 as g", "cast(id * 7 % 100 as double) as v")
    ask = {"mid": lambda n: (n - 1) / 2, "low": lambda n: F.floor(n * 0.1).cast("double")}
    few = sorted(map(tuple, blocks.quantiles(rows, "g", "v", ask).collect()))
    monkeypatch.setattr(blocks, "FEW_VALUES", 10)
    assert sorted(map(tuple, blocks.quantiles(rows, "g", "v", ask).collect())) == few


def test_criteria_limits_and_rejects(spark):
    with pytest.raises(Exception, match="between 0 and 1"):
        M.criteria_from_evidence("id", {}, spark.createDataFrame([(1, "x", 1.5)], "id int, criterion string, value double")).collect()
    targets = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, None)], "id int, confidence double")
    assert [tuple(r) for r in M.criteria_from_evidence("id", {"targets": targets}).collect()] == [(1, "target_confidence", 0.9)]
    bad = spark.createDataFrame([(None, "CC"), (2, " ")], "id int, smiles string")
    with pytest.raises(ValueError):
        C.validate_compounds(bad, "id", "smiles", strict=True)
    assert C.validate_compounds(bad.limit(0), "id", "smiles", strict=True)[0].count() == 0
    t = C.toxicity_explanations(spark.createDataFrame([(0.5, "moderate", 0, None, None, None, ["a", "b"])], "toxicity_score double, toxicity_level string, violations int, mw double, logp double, qed double, alert_names array<string>")).first()
    assert len(t.explanations) == 4 and "2 PAINS/Brenk structural alert(s) detected: a, b." in t.explanations[2] and "0.50 indicates" in t.explanations[3]
    stats = M.ranking_statistics(spark.createDataFrame([(0.5, None), (0.7, "high")], "composite double, level string"), level="level").first()
    assert stats.confidence_distribution == {"high": 1, "unknown": 1}
    gone = W.prune_expired(spark.createDataFrame([(1, None)], "id int, created_at timestamp"), 5, F.current_timestamp())
    assert gone[0].count() == 0 and gone[1].first().evicted == 1


def test_lists_of_sources_are_counted_without_a_second_shuffle(spark):
    """n_sources is the size of the list that is made anyway; null sources don't count."""
    rel = spark.createDataFrame([("A", "has", "B", 0.5, s, t) for t, s in enumerate(["p1", "p2", "p1", None])] + [("C", "has", "D", 0.5, None, 9)], "subject string, verb string, object string, confidence double, source string, ts int")
    none = spark.createDataFrame([], "text string, label string, source string, ts int")
    edges, nodes = G.build_edges(rel, lists=True), G.build_nodes(none, rel, lists=True)
    assert sorted((r.src, r.n_sources, r.all_sources) for r in edges.collect()) == [("a", 2, ["p1", "p2"]), ("c", 0, [])]
    assert sorted((r.id, r.n_sources) for r in nodes.collect()) == [("a", 2), ("b", 2), ("c", 0), ("d", 0)]
    assert edges.schema["n_sources"].dataType == G.build_edges(rel).schema["n_sources"].dataType
    for df in (edges, nodes):
        assert df._jdf.queryExecution().sparkPlan().toString().count("partial_count(") <= 1 and "distinct" not in df._jdf.queryExecution().sparkPlan().toString().lower()


def test_title_dedupe_finds_all_close_titles(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 60))) for _ in range(25)]
    near = []
    for b in base:
        t = list(b)
        for _ in range(max(1, len(t) // 12)):
            t[rng.randrange(len(t))] = "z"
        near.append("".join(t) if rng.random() < 0.6 else "".join(t)[:-1])
    left = spark.createDataFrame([(100 + k, t) for k, t in enumerate(near)], "ord int, title string")
    right = spark.createDataFrame(list(enumerate(base)), "ord int, title string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {(r.ord, r.other) for r in L.title_pairs(left, right).collect()}
    assert got == {(100 + i, j) for i, a in enumerate(near) for j, b in enumerate(base) if 1 - distance(a, b) / max(len(a), len(b)) > 0.9}


def test_title_blocks_find_the_same_and_pass_few(spark, monkeypatch):
    """In blocks of any size; titles of one language share pieces, but only alike ones are passed on."""
    import random

    from evidex.operators import titles

    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "ei", "o", "un ")]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randrange(40, 90))) for _ in range(400)]
    near = [t[:20] + "xy" + t[22:-1] for t in base[:200]]
    table = lambda x: titles._titles(spark.createDataFrame([(t,) for t in x], "title string"))
    name = {hashlib.md5(t.encode()).digest(): k for x in (base, near) for k, t in enumerate(x)}
    for left, right in ((4 << 20, 8 << 20), (3000, 2000)):
        monkeypatch.setattr(titles, "LEFT_CHARS", left)
        monkeypatch.setattr(titles, "RIGHT_CHARS", right)
        monkeypatch.setattr(titles, "MATCHES", left // 64)
        found = [(name[bytes(r.a)], name[bytes(r.b)]) for r in titles.title_candidates(table(near), table(base), 0.9).collect()]
        assert sorted(found) == [(k, k) for k in range(200)]


def test_federated_union_reports_failures(spark):
    a = spark.createDataFrame([(1, "x")], "ord int, title string")
    union, status = L.federated_union({"one": a, "two": a.filter("ord > 5")}, ["one", "two", "three"])
    assert union.count() == 1
    assert {r.source: r.status for r in status.collect()} == {"one": "OK (1 results)", "two": "No results", "three": "Failed: unknown source"}


def test_shortest_path_of_many_steps(spark):
    edges = spark.createDataFrame([("n%02d" % k, "n%02d" % (k + 1)) for k in range(52)], "src string, dst string").coalesce(1)
    row = G.shortest_path(edges, "n00", "n52").first()
    assert (row.found, row.length, row.path) == (True, 52, ["n%02d" % k for k in range(53)])


def test_shortest_path_is_the_least_of_many(spark):
    """Random graphs against a search over all shortest paths."""
    import random
    from collections import deque

    rng = random.Random(12)
    for trial in range(4):
        n = 14
        pairs = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(26)})
        after = {}
        for a, b in pairs:
            after.setdefault(a, []).append(b)
        edges = spark.createDataFrame(pairs, "src string, dst string").coalesce(1)
        best, queue = {"n00": ["n00"]}, deque(["n00"])
        while queue:  # paths of equal length come in order, so the first one is the least
            x = queue.popleft()
            for y in sorted(after.get(x, [])):
                if y not in best:
                    best[y] = [*best[x], y]
                    queue.append(y)
        goal = max(best, key=lambda x: (len(best[x]), x))
        row = G.shortest_path(edges, "n00", goal).first()
        assert (row.found, row.path) == (True, best[goal]) or "n00" not in {x for p in pairs for x in p}


def test_session_stream_returns_the_tail(spark, sf):
    from evidex.plans import q_streams
    from evidex.streaming import streams as X

    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = q_streams.QUERIES["x02_stream_session_windows"](spark, sf)
    batch = X.session_windows(rows, "user_id").select("user_id", F.unix_micros("start"), F.unix_micros("end"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.agg(F.sum("n")).first()[0] == rows.count()


def test_session_state_holds_open_sessions_only(spark, tmp_path):
    """Files come one after the other: closed sessions leave the state, and a later run goes on with open ones."""
    from evidex.streaming import streams as X

    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(name, events):
        rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00") for u, h, m in events]
        spark.createDataFrame(rows, "user long, at string").selectExpr("user", "cast(at as timestamp) as ts").coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema("user long, ts timestamp").option("recursiveFileLookup", "true").parquet(source)
        return sorted((r.key, (r.end - r.start) // 60_000_000, r.n) for r in X.run_sessions(stream, "user", 1800, "10 minutes", path).collect())

    assert arrive("a", [(1, 8, 0), (1, 8, 20), (2, 8, 5), (1, 9, 0), (3, 8, 50)]) == [(1, 30, 1), (1, 50, 2), (2, 30, 1), (3, 30, 1)]
    assert X.open_sessions(spark, path, 1800).count() == 2  # of 1 and 3; the watermark stands at 8:50
    assert arrive("b", [(3, 9, 10), (1, 9, 40), (2, 12, 0), (2, 8, 10)]) == [(1, 30, 1), (1, 30, 1), (1, 50, 2), (2, 30, 1), (2, 30, 1), (3, 50, 2)]
    assert [r.key for r in X.open_sessions(spark, path, 1800).collect()] == [2]  # 8:10 came too late and is dropped


def event_files(spark, folder, n):
    """``n`` files of ten events of two users, in order."""
    for k in range(n):
        rows = spark.range(10).selectExpr(f"id + {10 * k} as event_id", "id % 2 as user_id", f"timestamp_seconds({1000 * k} + id) as ts")
        rows.coalesce(1).write.parquet(folder, mode="append")
    return spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("ttl,kept", [(0, 8), (1, 5)])
def test_last_n_forgets_what_is_too_old(spark, rocksdb, tmp_path, ttl, kept):
    import time

    from evidex.streaming import streams as X

    for n in (2, 1):
        stream = event_files(spark, str(tmp_path / "in"), n)
        got = X.upsert(X.last_n(stream, "user_id", "event_id", 8, ttl), X.replace(["key"]), ["key"], mode="update", path=str(tmp_path / "out"), once=True)
        time.sleep(0.1)
    assert {(r.key, r.kept) for r in got.collect()} == {(0, kept), (1, kept)}


def test_upserts_by_bucket(spark, tmp_path):
    from evidex.streaming import streams as X

    stream = event_files(spark, str(tmp_path / "in"), 5).selectExpr("event_id % 17 as id", "event_id as at")
    first = X.upsert(stream, X.new_only(["id"]), ["id"], lambda b: b.groupBy("id").agg(F.min("at").alias("at")), buckets=4)
    assert {(r.id, r.at) for r in first.collect()} == {(k, k) for k in range(17)}
    last = X.upsert(stream, X.replace(["id"]), ["id"], lambda b: b.groupBy("id").agg(F.max("at").alias("at")), buckets=4)
    assert {(r.id, r.at) for r in last.collect()} == {(k % 17, k) for k in range(33, 50)}


def test_exact_glob_of_a_stream(spark, tmp_path):
    from evidex.streaming import streams as X

    for name in ("events", "events_old"):
        spark.range(3).selectExpr("id as event_id").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert X.run_to_end(X.file_stream(spark, str(tmp_path), "events")).count() == 3


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        G.shared_folder(Session)


def test_update_graph_without_new_papers(spark, tmp_path):
    """A second run over the same papers has a status without rows and publishes nothing."""
    from evidex.sources import store

    schema = "ord long, abstract string, pmid string, doi string, ts timestamp"
    papers = spark.createDataFrame([(1, "Aspirin inhibits cox. Nothing else.", "7", None, None), (2, None, None, "10.1/x", None)], schema)
    patterns = spark.createDataFrame([("DRUG", "aspirin")], "label string, pattern string")
    path, verbs = str(tmp_path / "papers"), {"inhibits": "inhibit"}
    first = G.update_graph(papers, patterns, verbs, path)
    versions = [store.snapshot(spark, f"{path}/{x}")[0] for x in ("nodes", "edges", "ledger")]
    again = G.update_graph(papers, patterns, verbs, path)
    assert sorted((r.ord, r.status, r.n_mentions, r.n_relations) for r in first.collect()) == [(1, "processed", 1, 1), (2, "skipped", 0, 0)]
    assert again.columns == first.columns and again.count() == 0
    assert versions == [1, 1, 1] == [store.snapshot(spark, f"{path}/{x}")[0] for x in ("nodes", "edges", "ledger")]
    assert [(r.src, r.relation, r.dst) for r in G.read_graph(spark, path)[1].collect()] == [("aspirin", "inhibit", "cox")]


def test_papers_of_one_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A table of papers that one task reads is searched by several."""
    import random

    rng = random.Random(16)
    rows = [(k, f"Aspirin inhibits cox{k}. {rng.randbytes(3000).hex()}", str(k), None, None) for k in range(2500)]
    papers = spark.createDataFrame(rows, "ord long, abstract string, pmid string, doi string, ts timestamp").coalesce(1)
    patterns = spark.createDataFrame([("DRUG", "aspirin")], "label string, pattern string")
    parts, search = [], G.extract_svo

    def counted(docs, *args, **named):
        parts.append(docs.select(F.spark_partition_id()).distinct().count())
        return search(docs, *args, **named)

    monkeypatch.setattr(G, "extract_svo", counted)
    status = G.update_graph(papers, patterns, {"inhibits": "inhibit"}, str(tmp_path / "papers"))
    assert parts[0] > 1
    assert status.filter("n_mentions = 1 and n_relations = 1").count() == 2500


def test_svo_in_what_was_found(spark):
    """Groups found in the found stretch are those that are found in the sentence."""
    verbs = {"was": "be", "is": "be", "are": "be"}
    texts = [
        "a b c d was e f g h i", "x is not is y", "It is not was by the old red fox-hound, no", "was was was was was", "is is", "a is", "is b", "not no is by by by", "No one was  by\thim \n again", "Über-été IS 日本語 x1-2 - -",
        "this island wasis is-was are-", "the cat was, is not  are by bye", "a  b   was are no was by x.", "- is -", "a was bywas c", "1 2 3 4 is 5 6 7 8 was 9", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    pattern = r"(?i)((?:[\p{L}\p{N}-]+\s+){1,3}?)((?:is|was|are|were)\s+)?((?:not|no)\s+)?\b(was|are|is)\b(?:\s+by)?\s+((?:[\p{L}\p{N}-]+\s*){1,3})"
    each = docs.select("id", F.posexplode(T.split_sentences(F.col("t"))).alias("n", "s")).filter(F.col("s").rlike(pattern))
    g = lambda k: F.regexp_extract("s", pattern, k)
    whole = each.select("id", "n", T.normalize_text(g(1)), T.normalize_text(g(5)), g(2) != "", g(3) != "")
    got = G.extract_svo(docs, "id", "t", verbs).select("id", "sentence_no", "subject", "object", "passive", "negated")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert got.count() > 10


def test_graph_counts_sources_without_a_distinct_count(spark):
    """Nodes and edges of odd rows, against loops; rows are added up by hash before they are shuffled."""
    import random
    from datetime import datetime

    rng = random.Random(19)
    names = ["a", " A", "a\t b", "A  b", "b\n", " ", "", None, "\u00c4 x", "c", "d  e\x0b"]
    days = [None, datetime(2020, 1, 1), datetime(2021, 1, 1), datetime(2022, 1, 1)]
    pick = lambda: (rng.choice(names), rng.choice(["is", "IS ", " ", None]), rng.choice(names), rng.choice([None, 0.1, 0.5]), rng.choice([None, "p1", "p2", "p3"]), rng.choice(days))
    said, seen = [pick() for _ in range(400)], [(rng.choice(names), rng.choice(["X", "Y", None]), rng.choice([None, "p1", "p9"]), rng.choice(days)) for _ in range(40)]
    rel = spark.createDataFrame(said, "subject string, verb string, object string, confidence double, source string, ts timestamp")
    m = spark.createDataFrame(seen, "text string, label string, source string, ts timestamp")
    norm = lambda x: " ".join(x.split()).lower() or None if x is not None else None
    first = lambda x: (x is not None, x if x is not None else 0)  # nulls come first
    most = lambda xs: max((x for x in xs if x is not None), default=None)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    nodes, edges = {}, {}
    for text, label, source, ts in seen + [(t, "UNKNOWN", r[4], r[5]) for r in said for t in (r[0], r[2])]:
        nodes.setdefault(norm(text), []).append((text, label, source, ts))
    for s, v, o, c, source, ts in said:
        if norm(s) and norm(v) and norm(o):
            edges.setdefault((norm(s), norm(o), norm(v)), []).append((c, source, ts))
    nodes.pop(None)
    n_sources = lambda rows, i: len({r[i] for r in rows} - {None})
    want_nodes = [(k, min(r, key=lambda x: (first(x[3]), x[0]))[0], sorted({x[1] for x in r} - {None}), len(r), least(x[3] for x in r), most(x[3] for x in r), n_sources(r, 2)) for k, r in nodes.items()]
    want_edges = [(*k, most(x[0] for x in r), most(x[2] for x in r), max(r, key=lambda x: (first(x[2]), first(x[1])))[1], len(r), n_sources(r, 1)) for k, r in edges.items()]
    got_nodes, got_edges = G.build_nodes(m, rel), G.build_edges(rel)
    assert got_nodes.columns == ["id", "canonical_name", "labels", "mention_count", "first_seen", "last_seen", "n_sources"]
    assert sorted(map(tuple, got_nodes.collect()), key=str) == sorted(want_nodes, key=str) and len(want_nodes) > 5
    assert sorted(map(tuple, got_edges.collect()), key=str) == sorted(want_edges, key=str) and len(want_edges) > 20
    worded = G.build_edges(rel.withColumn("sentence", F.lit("s")))
    assert sorted(map(tuple, worded.select(*got_edges.columns).collect()), key=str) == sorted(want_edges, key=str)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (got_nodes, got_edges, worded):
        assert "distinct" not in plan(df)
    assert "Join" not in plan(got_nodes.drop("n_sources")) + plan(worded.drop("n_sources"))  # a count that nobody asks for isn't made


def test_overlap_search_in_large_blocks(spark):
    """Rows are copied by how many keys the queries have, not by how many queries there are; few or many shared keys."""
    import random

    import pyarrow as pa

    from evidex.operators import blocks

    rng = random.Random(6)
    for span in (5000, 12):  # few pairs share a key; most do
        sets = {k: rng.sample(range(span), rng.randrange(1, 10)) for k in range(3000)}
        rows = spark.createDataFrame(list(sets.items()), "id long, keys array<long>").repartition(4)
        asked = rows.filter("id % 2 = 0").withColumnRenamed("id", "query")
        table = lambda part, name: pa.table({name: pa.array(part, pa.int64()), "keys": pa.array([sets[k] for k in part], pa.list_(pa.int64()))})  # noqa: E731, B023
        pairs = list(blocks._shared(table(range(0, 3000, 2), "query"), table(range(3000), "id")))
        assert {q is None for q, *_ in pairs} == {span == 12}
        found = blocks.overlap_search(asked, rows, 3, "tanimoto")
        plan = found._jdf.queryExecution().toString()
        assert "sequence(cast(0 as bigint), cast(0 as bigint)" in plan or "sequence(0, 0" in plan or "[0]" in plan
        got = {(r.query, r.rank): (r.id, round(r.score, 9)) for r in found.collect()}
        for q in range(0, 3000, 150):
            s = set(sets[q])
            best = sorted((-len(s & set(x)) / len(s | set(x)), k) for k, x in sets.items() if k != q and s & set(x))[:3]
            assert {r: x for (a, r), x in got.items() if a == q} == {n + 1: (k, round(-v, 9)) for n, (v, k) in enumerate(best)}


def test_a_key_has_one_session_timer():
    """However many sessions are open, one timer stands, and one call emits all that are over."""
    import types

    import pandas as pd

    from evidex.streaming import streams as X

    class Handle:
        def __init__(self):
            self.timers, self.calls, self.held = [], 0, []

        def getListState(self, *_):
            return types.SimpleNamespace(exists=lambda: bool(self.held), get=lambda: iter(self.held), put=lambda x: setattr(self, "held", list(x)), clear=lambda: setattr(self, "held", []))

        def listTimers(self):
            return iter([(t,) for t in self.timers])

        def registerTimer(self, t):
            self.calls += 1
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    handle, sessions = Handle(), X.Sessions(1_000_000)
    sessions.init(handle)
    at = [k * 10_000_000 for k in range(1, 51)]
    list(sessions.handleInputRows((7,), iter([pd.DataFrame({"at": at})]), None))
    assert (handle.timers, handle.calls) == ([11_000], 1)
    list(sessions.handleInputRows((7,), iter([pd.DataFrame({"at": [10_500_000]})]), None))
    assert handle.timers == [11_500]
    handle.timers.clear()  # it expires
    clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 491_500)
    (out,) = sessions.handleExpiredTimer((7,), clock, types.SimpleNamespace(getExpiryTimeInMs=lambda: 11_500))
    assert out.to_numpy().tolist() == [[7, t, t + 1_000_000 + 500_000 * (t == at[0]), 1 + (t == at[0])] for t in at[:49]]
    assert (len(handle.held), handle.timers) == (1, [501_000])


def test_question_support_of_ids_with_several_nodes(spark):
    store = spark.createDataFrame([(1, "b", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "c", [1.0, 0.1]), (3, "d", [0.0, 1.0])], "id long, node string, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query long, vector array<float>")
    edges = spark.createDataFrame([("a", "x"), ("y", "a")], "src string, dst string")
    got = [(r["rank"], r.node, r.neighbors) for r in G.question_support(asked, store, edges, 3).orderBy("rank").collect()]
    assert got == [(1, "a", ["x", "y"]), (2, "b", []), (3, "c", [])]


def test_explanations_round_exact_values(spark):
    """0.0535 and 0.8155 are doubles below and above what they are written as; 12.25 is exactly between."""
    rows = spark.createDataFrame([(1, "a", 0.0535, 12.25), (1, "b", 0.8155, 87.75)], "id int, criterion string, normalized double, weight double")
    scored = spark.createDataFrame([(1, 0.6325), (1, None)], "id int, composite double")
    got = {tuple(r.lines) for r in M.explanations(rows, scored, "id").collect()}
    lines = (f"b: {0.8155:.3f} (weight {87.75:.1f}%)", f"a: {0.0535:.3f} (weight {12.25:.1f}%)")
    assert got == {(f"Overall score {0.6325:.3f}", *lines), ("Overall score null", *lines)}


def test_names_end_where_no_letter_follows(spark):
    """A letter with an accent belongs to the word, in the query and in its SQL."""
    import duckdb

    from evidex.functions import querytext as Q
    from evidex.plans import q_memory

    texts = ["Que\u00ed se \u00f1 ci\u00f3nrrdoos.", "\u00e9Abcd x", "Abc_ x", "Abcd", "x Abcd.", "a-Abc", None]
    rows = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {(r.id, r.intent) for r in Q.detect_intents(rows.selectExpr("conv_id * 1000 + turn as id", "text"), "id", "text").collect()}
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [tuple(r) for r in rows.collect()])
    assert got == set(db.execute(q_memory.SQL["q05_detect_intents"]).fetchall())
    assert {i for i, intent in got if intent == "drug_info"} == {3000, 4000, 5000}


def test_entities_of_texts_without_diseases_are_quick(spark):
    """A long text in which no disease occurs: the patterns around diseases are passed by."""
    rows = spark.createDataFrame([(1, "many words and no more " * 90_000), (2, "a Lung CANCER here"), (3, None), (4, "")], "id int, t string")
    assert str(T.entities_context(F.col("t"))).count("contains(") >= len(T.DISEASES + T.DISEASES_MORE)
    got = {r.id: r.m.get("diseases") for r in rows.select("id", T.entities_context(F.col("t")).alias("m")).collect()}
    assert got == {1: None, 2: ["a Lung CANCER here"], 3: None, 4: None}


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """An encoder, and the search for phrases, never get more than 1000 texts at once, unless the session says so."""
    from pyspark.sql import functions as F

    from evidex.operators import graph as G
    from evidex.operators import vectors as V

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('And the word ', id) as text")
    spark.conf.unset(name)
    sizes = V.embed_with_cache(texts, str(tmp_path / "cache"), "text", F.md5("text"), lambda batch: [[float(len(batch))] for _ in batch], batch_size=5000)[0]
    assert sizes.agg(F.max(F.element_at("vector", 1))).first()[0] <= 1000
    spark.conf.unset(name)
    patterns = spark.createDataFrame([("A", "and THE"), ("B", "word 7"), ("C", "the"), ("D", "7")], "label string, pattern string")
    found = G.extract_mentions(texts, "id", "text", patterns)
    assert spark.conf.get(name) == "1000"
    got = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 3000, "B": 1, "C": 3000, "D": 1}


def test_blank_texts_have_a_vector(spark, tmp_path):
    """Texts that are empty or blank, or differ in white space only, count and are encoded as in the SQL."""
    import duckdb

    from evidex.plans import q_graph

    texts = ["one tree", " one\n tree ", "", "  ", "\n\t", "\x0b", "\u00a0", "\u00a0one tree", "one\x0btree", "one\u2003tree", "e", "E e", "", "x"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [float(k)], k % 2) for k in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("e09_embed_with_cache", "e09_embed_with_cache_vectors", "e17_store_stats_with_cache"):
        df = q_graph.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(db.execute(f"select {', '.join(df.columns)} from ({q_graph.SQL[name]})").fetchall()), name


def test_keys_that_most_rows_share_are_counted_quickly():
    """A thousand million shared keys, counted by a product of matrices beside keys that few share."""
    import numpy as np
    import pyarrow as pa

    from evidex.operators import blocks

    def table(first, n):
        rows = [np.append(np.arange(500), 10_000 + (first + k) % 700) for k in range(n)]
        return pa.table({"keys": pa.array(rows, pa.list_(pa.int64()))})

    began, seen = time.time(), np.zeros((1000, 2000), np.int64)
    for q, r, counts in blocks._shared(table(0, 1000), table(350, 2000)):
        assert q is None
        seen[:, r] = counts
    assert time.time() - began < 10
    assert (seen == 500 + (np.arange(1000)[:, None] % 700 == np.arange(350, 2350)[None] % 700)).all()


def test_only_the_first_like_title_is_compared(spark):
    """Distances equal the table's; with ``first`` a title's least like one comes out, after as few comparisons as that takes."""
    import random

    from evidex.operators import titles

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(12)))
        b = "".join(c for c in a if rng.random() < 0.8) + rng.choice(["", "a", "xyz"])
        want, most = table(a, b), rng.randrange(8)
        assert titles.distance(a, b, most) == (want if want <= most else None)
    base = "a title that is long enough to be like another one of its kind"
    right = spark.createDataFrame([(k, base + "!" * (k % 3)) for k in range(1, 60)] + [(60, "another title that is like none of the others here")], "ord long, title string")
    left = spark.createDataFrame([(100, base + "?"), (101, base.upper()), (102, "nothing like these")], "ord long, title string")
    every = {(r.ord, r.other) for r in titles.title_pairs(left, right).collect()}
    assert every == {(o, k) for o in (100, 101) for k in range(1, 60)}
    assert {(r.ord, r.other) for r in titles.title_pairs(left, right, first=True).collect()} == {(100, 1), (101, 1)}
    plan = titles.title_pairs(left, right, first=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
