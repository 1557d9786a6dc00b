"""Runs, clusters and languages against brute force, exact sequential loops and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidex.llm import centroids, langid, queries, runs

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=runs.LEAST, times=runs.TIMES):
    """(start, length, period) of every run, by looking at every period."""
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(text):
    w = SPLIT.findall(text or "")
    found = brute_runs(w)
    gone = {i for start, size, q in found for i in range(start + q, start + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    return len(w), found, best, " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    w = SPLIT.findall(text or "")
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i if i < a else a + (i - a) % p] for i in range(n))


def run_texts():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)] + ["Über", "日本語", "|"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", " \n", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", " ".join(["x"] * 5000), " ".join(some(900))]
    for q in (1, 2, 7, 8, 9, 16, 17, 50, 120):
        unit = some(q)
        texts += [" ".join(some(5) + unit * 3 + some(4)), " ".join(some(30) + unit * 5 + unit[: q // 2]), " ".join(unit * 3), " ".join((unit * 3)[:-1]), " ".join(unit * 2 + some(40) + unit * 26)]
    nested = (["a", "b"] * 14 + ["c"]) * 4 + ["d"] + (["a", "a", "b"] * 9 + ["c"]) * 3
    return [*texts, " ".join(nested), "\n".join("same line of six words\nanother one" for _ in range(9)), texts[-1]]


@pytest.fixture(scope="module")
def run_docs(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(run_texts())] + [(None, "a b c " * 10, "y", 0), (5, "a " * 24, "z", 1), (5, "a " * 24, "z", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, Period string, start int").repartition(3)


def test_runs_against_brute_force(run_docs):
    rows, docs = run_docs
    got = sorted(((r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], (r.start, r.length, r.period), r.exponent_milli, r.collapsed, r.n_runs) for r in runs.find_runs(docs).collect()), key=repr)
    expected = []
    for doc_id, text, *_ in rows:
        n, found, best, left = brute_document(text)
        expected.append((doc_id, text, n, found, best, 1000 * best[1] // best[2] if found else None, left, len(found)))
    assert got == sorted(expected, key=repr)
    assert runs.find_runs(docs).columns == ["doc_id", "text", "n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "collapsed"]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (13, 3), (9, 4)])
def test_runs_of_small_alphabets(least, times):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            w = []
            while len(w) < rng.randrange(0, 90):
                w += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 6)
            docs.append(w)
        before = np.append(0, np.cumsum([len(d) for d in docs]))
        got = runs.document_runs(np.array([x for d in docs for x in d], np.int64), before, least, times).tolist()
        assert [tuple(r) for r in got] == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d, least, times)]


def test_extensions_of_a_suffix_tree():
    rng = random.Random(8)
    s = [rng.randrange(1, 3) for _ in range(700)] + [0]
    tree = runs.SuffixTree(s, 3)
    tour = tree.tour(tree.symbol)
    assert [s[i:] for i in np.argsort(tour.rank)] == sorted(s[i:] for i in range(len(s)))
    i, j = np.array([(a, b) for a in range(0, 700, 7) for b in range(a + 1, 701, 5)]).T
    brute = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i.tolist(), j.tolist())]
    assert tour.extension(i, j).tolist() == brute


def test_runs_empty_table(empty):
    assert runs.find_runs(empty).count() == 0


def test_op11_on_the_tables(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(source)
    for doc_id, text in source:
        n, found, best, left = brute_document(planted(doc_id, text))
        lines = "".join(f"{s},{x},{q}\n" for s, x, q in found)
        assert got[doc_id] == (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(lines), digest(left), n)


def brute_clusters(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) by every vector with every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(b"2:%d" % r[0]).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own) if o == n] for n in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, c)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in found), key=repr)


def vector_rows(dims):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(dims)]) for i in range(150)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, [0.5] * dims), (200, [0.5] * dims), (201, [0.5] * dims), (202, [-0.001] * dims)]
    return rows + [(300, None), (301, []), (302, [0.1] * (dims + 1)), (303, [None] + [0.1] * (dims - 1)), (304, [math.nan] + [0.1] * (dims - 1)), (305, [math.inf] + [0.1] * (dims - 1))]


@pytest.mark.parametrize("k,rounds", [(1, 2), (2, 3), (7, 4), (40, 5), (400, 2)])
def test_clusters_against_brute_force(spark, k, rounds):
    rows = vector_rows(5)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = sorted((tuple(r) for r in centroids.cluster(df, k, rounds, dims=5).collect()), key=repr)
    assert got == brute_clusters(rows, k, rounds, 5)


def test_clusters_of_equal_vectors(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(0.25), F.lit(-0.5)).alias("embedding"))
    got = centroids.cluster(df, 4, 2, dims=2).select("cluster", "distance", "inertia").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0, 0)]


def test_clusters_empty_table(spark):
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_looks_at_few_centroids():
    rng = np.random.default_rng(4)
    c = rng.integers(-20, 20, (30, 2)) * 100
    v = (c[rng.integers(0, 30, 4000)] + rng.integers(-30, 30, (4000, 2))).astype(np.int64)
    first, second, upper, lower = np.zeros(4000, np.int64), np.ones(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)
    s = centroids.Search(c)
    s.assign(v, first, second, upper, lower)
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    order = np.lexsort((np.broadcast_to(np.arange(30), d.shape), d), axis=1)
    rest = np.sqrt(np.sort(d, axis=1)[:, 1])
    assert (first == order[:, 0]).all() and (lower <= rest * (1 + 1e-12)).all()
    assert (lower == 0).any() and (lower[lower > 0] == rest[lower > 0]).all()  # 0: settled by half the way to the next centroid
    again = s.assign(v, first, second, upper, lower)
    assert again < 4000 * 3 and (first == order[:, 0]).all()


def test_op12_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    theirs = con.execute(queries.oracle_sql()["op12_centroid_clusters"]).fetchall()
    df = queries.op12_centroid_clusters(spark, sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ours = sorted((tuple(r) for r in df.collect()), key=repr)
    assert ours == sorted(theirs, key=repr) == brute_clusters(rows, 40, 5, 64)


def brute_grams(text):
    """Counts of hashed grams of one text, gram by gram."""
    data = b"".join(bytes([b]) if 97 <= b <= 122 or b >= 128 else b" " for b in (text or "").lower().encode())
    data = re.sub(b" +", b" ", data)
    out = np.zeros(langid.BUCKETS, np.int64)
    for size in langid.GRAMS:
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if b" " in gram[1:-1]:
                continue
            h = 0
            for b in gram:
                h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
            out[((h + size) & 0xFFFFFFFF) * 0x9E3779B1 % (1 << 32) >> 20] += 1
    return out


def test_grams_against_loops():
    texts = ["", None, "Hello, World!", "a", " ", "Über  das", "x" * 300, "日本語 テキスト", "one\ntwo 33 four", "a b"]
    got = langid.gram_counts(pa.array(texts))
    for row, text in zip(got, texts):
        assert (row == brute_grams(text)).all(), text


def test_document_frequencies_cover_all_rows(spark, docs, rows):
    n, df = langid.document_frequencies(docs)
    assert n == len(rows) and (df == sum((brute_grams(r[1]) > 0).astype(int) for r in rows)).all()


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    for lang in {r.lang for r in held}:
        own = [r for r in held if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.95 * len(own)
    assert sum(r.accepted for r in held) >= 0.95 * len(held)


def test_language_edge_cases(spark, docs, empty):
    train = spark.createDataFrame([(k, f"the cat and dog {k}", "en") for k in range(30)] + [(100 + k, f"der Hund und die Katze {k}", "de") for k in range(30)] + [(200, "no lang", None), (201, None, "fr"), (202, "123", "fr")], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the dog and cat"), (4, "the dog and cat"), (None, "die Katze und der Hund"), (5, "日本語"), (6, "the " * 100_000)], "doc_id long, text string").withColumn("Score", F.lit("own"))
    got = langid.identify(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    by = sorted(((r.doc_id, r.lang_pred, r.accepted) for r in got.collect()), key=repr)
    assert [x for x in by if x[0] in (1, 2, 3)] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert by.count((4, "en", True)) == 2 and (None, "de", True) in by and (6, "en", True) in [(a, b, True) for a, b, _ in by]
    assert [a for x, _, a in by if x == 5] == [False]
    assert langid.identify(empty, model).count() == 0
    nothing = langid.identify(odd, langid.fit_languages(empty)).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in nothing} == {("und", 0.0, False)}
