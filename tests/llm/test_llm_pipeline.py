"""The pipeline against its stages done by brute force, and how stages treat odd rows."""

import hashlib
import re

import public_tokenizers as P
from test_llm_operators import brute_components, brute_dedup, brute_hits, brute_quality, brute_simhash

import corpus_pipeline
from evidex.llm import byte_bpe

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    import tiktoken

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = {r[0] for r in brute_quality(docs, trusted) if r[-1]}
    docs = [r for r in docs if r[0] in kept]
    lines = brute_dedup(docs, 50)
    deduped = []
    for doc_id, text in docs:
        n, gone, kept = lines[(doc_id, text)]
        if n > gone:
            deduped.append((doc_id, text if not gone else "\n".join(kept)))
    fps = {doc_id: brute_simhash(text) for doc_id, text in deduped}
    root = brute_components(fps.values())
    least = {}
    for doc_id, f in fps.items():
        least[root[f]] = min(least.get(root[f], doc_id), doc_id)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w) for _, t in items for w in windows_of(t)}
    final = [(d, t) for d, t in deduped if least[root[fps[d]]] == d and not any(tuple(w) in windows for w in windows_of(t, True))]
    one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = {(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in final for ids in [one.encode_ordinary(t)]}
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert {g[0] for g in got} == {e[0] for e in expected}
    blank = {g for g in got if g not in expected}  # texts whose lines went keep their blank lines, which the short form above drops
    assert all(lines[(g[0], dict(docs)[g[0]])][1] for g in blank)
    assert len(got) > 100


def windows_of(text, every=False):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if every or len(words) >= 10:
        return [words[k : k + 10] for k in range(len(words) - 9)]
    return [words] if words else []


def test_stages_keep_columns_and_take_odd_rows(spark, docs, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(9, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "own line 2 and then some more words that are ten")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for rows in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == rows.columns
            assert out.count() <= rows.count()


def test_brute_hits_counts_whole_items():
    assert brute_hits("a b c", [(1, "b c")])[:3] == (3, 2, 1)
