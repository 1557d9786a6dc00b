"""Knowledge graph as node and edge tables: extraction, building, merging, queries and reports."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.text import clamp, is_meaningful_label, normalize_text, split_sentences


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may leave it unset, and gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def write_cut(df: DataFrame) -> str:
    """``df`` written to the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that loops don't grow their plan."""
    return df.sparkSession.read.schema(df.schema).parquet(write_cut(df))


#: Rows of a batch of texts that goes to Python: Spark's own 10,000 take hundreds of MB in each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of batches of texts, unless the session sets its own number of rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "-1") == "-1":  # nobody has set it
        spark.conf.set(name, BATCH_ROWS)


def normalize_node_id(c: Column) -> Column:
    return F.lower(normalize_text(c))


def _bare_id(c: Column) -> Column:
    """``normalize_node_id``, but empty where that is null for white space; made in a generator and filtered behind it, it is worked out once a row."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


#: Slots of the filter that phrases of texts pass before they meet the dictionary.
SLOTS = 1 << 20


def extract_mentions(docs: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, label, text, start_char, end_char): exact phrases of a (label, pattern) dictionary.

    Each row of ``docs`` is cut into words by itself, so rows that share a key don't mix and no word is
    shuffled. Its runs of as many words as some pattern has pass a filter of ``SLOTS`` bits, made from
    the patterns' hashes, and only what passes meets the dictionary, by equality. Matching ignores
    case; blank patterns are left out; null texts have no mentions.
    """
    words = F.regexp_extract_all(F.lower("pattern"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = patterns.select("label", words.alias("w")).filter(F.size("w") > 0).select("label", F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).distinct()
    spark = docs.sparkSession
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # a row for each pattern length
    slots = np.zeros(SLOTS, bool)
    slots[[r.slot for r in known.select(F.pmod(F.crc32("gram"), F.lit(SLOTS)).alias("slot")).distinct().collect()]] = True  # SLOTS rows at most
    starts = np.zeros(SLOTS, bool)  # words that some pattern begins with
    starts[[r.slot for r in known.select(F.pmod(F.crc32(F.substring_index("gram", " ", 1)), F.lit(SLOTS)).alias("slot")).distinct().collect()]] = True
    sent = spark.sparkContext.broadcast((np.packbits(slots), np.packbits(starts)))
    small_batches(spark)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        tokens, (passes, begins) = regex.compile(r"[\p{L}\p{N}]+"), [np.unpackbits(x).astype(bool) for x in sent.value]
        at = lambda gram: zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS
        for batch in batches:
            row, grams, counts, starts, ends = [], [], [], [], []
            first: dict[str, bool] = {}  # whether some pattern may begin with a word of the batch
            for i, t in enumerate(batch.column("text").to_pylist()):
                spans = [m.span() for m in tokens.finditer(t or "")]
                own = [t[a:b].lower() for a, b in spans]
                for word in set(own).difference(first):
                    first[word] = bool(begins[at(word)])
                places = [k for k, word in enumerate(own) if first[word]]
                for n in sizes:
                    for k in places:
                        if k + n > len(own):
                            break
                        gram = own[k] if n == 1 else " ".join(own[k : k + n])
                        if passes[at(gram)]:
                            row.append(i)
                            grams.append(gram)
                            counts.append(n)
                            starts.append(spans[k][0])
                            ends.append(spans[k + n - 1][1])
            yield pa.record_batch({"key": batch.column("key").take(pa.array(row, pa.int64())), "gram": pa.array(grams, pa.string()), "n": pa.array(counts, pa.int32()), "start_char": pa.array(starts, pa.int64()), "end_char": pa.array(ends, pa.int64())})

    schema = named.select("key", F.lit("").alias("gram"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("start_char"), F.lit(0).cast("long").alias("end_char")).schema
    salt = F.pmod(F.xxhash64("key", "start_char"), F.lit(SALTS)).alias("salt")  # a frequent phrase is dealt over tasks
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return named.mapInArrow(find, schema).select("*", salt).join(copies, ["gram", "n", "salt"]).select(F.col("key").alias(key), "label", F.col("gram").alias("text"), "start_char", "end_char")


def bucket_entities(mentions: DataFrame, key: str, groups: dict[str, str], least: float = 0.5) -> DataFrame:
    """(key, category, words): words of sure mentions by category, first seen first, each once."""
    category = F.lit("other")
    for name, target in groups.items():
        category = F.when(F.col("group") == name, target).otherwise(category)
    kept = mentions.filter(F.col("score") >= least).select(key, category.alias("category"), "word", "pos")
    first = kept.groupBy(key, "category", "word").agg(F.min("pos").alias("pos"))
    return first.groupBy(key, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def extract_svo(docs: DataFrame, key: str, text: str, verbs: dict[str, str], sentences: bool = False) -> DataFrame:
    """(key, sentence_no, subject, verb, object, passive, negated) by pattern: words around a known verb; with
    ``sentences`` also the sentence.

    The subject and the object are up to three words before and after the verb form; "is" or "was"
    before a form makes it passive, "not" or "no" in the sentence negates it.
    """
    forms = "|".join(sorted(verbs, key=len, reverse=True))
    lemma = F.create_map(*[F.lit(x) for pair in verbs.items() for x in pair])
    pattern = rf"(?i)((?:[\p{{L}}\p{{N}}-]+\s+){{1,3}}?)((?:is|was|are|were)\s+)?((?:not|no)\s+)?\b({forms})\b(?:\s+by)?\s+((?:[\p{{L}}\p{{N}}-]+\s*){{1,3}})"
    each = docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "sentence"))
    found = F.regexp_extract("sentence", pattern, 0)  # never empty; a search in it alone finds the same groups, as none looks beyond its ends
    hit = each.filter(F.col("sentence").rlike(rf"(?i)\b(?:{forms})\b")).withColumn("found", found).filter("found <> ''")  # the first is quick, and most sentences end there
    g = lambda k: F.regexp_extract("found", pattern, k)
    return hit.select(key, "sentence_no", normalize_text(g(1)).alias("subject"), F.element_at(lemma, F.lower(g(4))).alias("verb"), normalize_text(g(5)).alias("object"), (g(2) != "").alias("passive"), (g(3) != "").alias("negated"), *(["sentence"] if sentences else []))


def relation_confidence(prep: Column, passive: Column, negated: Column) -> Column:
    return clamp(F.round(0.75 - 0.15 * prep.cast("int") - 0.05 * passive.cast("int") - 0.20 * negated.cast("int"), 2))


def build_nodes(mentions: DataFrame, relations: DataFrame, lists: bool = False) -> DataFrame:
    """One row for each id; both ends of a relation count as mentions with label UNKNOWN.

    ``mentions``: text, label, source, ts; ``relations``: subject, object, source, ts. With ``lists``
    a node also has its sources as a sorted array, which one row must be able to hold;
    ``node_sources`` has them as rows.
    """
    rows = _ends(mentions, relations)
    if lists:
        return rows.withColumn("id", normalize_node_id(F.col("text"))).filter("id is not null").groupBy("id").agg(
            F.min_by("text", F.struct("ts", "text")).alias("canonical_name"), F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("mention_count"),
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.size(F.collect_set("source")).cast("long").alias("n_sources"), F.array_sort(F.collect_set("source")).alias("sources"),
        )
    # numbers only, so each task adds up its rows by hash before any are sorted or shuffled; sources are told apart in two columns
    spelt = rows.groupBy("text", "label").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or(F.col("ts").isNull()).alias("undated"))
    nodes = spelt.withColumn("id", normalize_node_id(F.col("text"))).filter("id is not null").groupBy("id").agg(
        F.min_by("text", F.struct(F.when(~F.col("undated"), F.col("first")), "text")).alias("canonical_name"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.sum("n").alias("mention_count"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )
    return _with_n_sources(nodes, node_sources(mentions, relations), "id")


def _ends(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.explode(F.array("subject", "object")).alias("text"), F.lit("UNKNOWN").alias("label"), "source", "ts")  # both from one reading
    return mentions.select("text", "label", "source", "ts").union(ends)


def _with_n_sources(rows: DataFrame, sources: DataFrame, *key: str) -> DataFrame:
    """``rows``, one for each key, with how many rows of ``sources`` have it."""
    return rows.join(sources.groupBy(*key).agg(F.count("*").alias("n_sources")), list(key), "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def node_sources(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, source): where each node was seen, a row for each."""
    seen = lambda rows, *names: rows.filter("source is not null").select(F.explode(F.array(*[_bare_id(F.col(n)) for n in names])).alias("id"), "source")
    return seen(mentions, "text").union(seen(relations, "subject", "object")).filter("id <> ''").distinct()


def edge_sources(relations: DataFrame) -> DataFrame:
    """(src, dst, relation, source): where each edge was seen, a row for each."""
    return _full(relations).select("src", "dst", "relation", "source").filter("source is not null").distinct()


def _full(relations: DataFrame) -> DataFrame:
    ids = F.struct(_bare_id(F.col("subject")).alias("src"), _bare_id(F.col("object")).alias("dst"), _bare_id(F.col("verb")).alias("relation"))
    others = [c for c in relations.columns if c not in ("src", "dst", "relation")]
    return relations.select(*others, F.inline(F.array(ids))).filter("src <> '' and dst <> '' and relation <> ''")


def build_edges(relations: DataFrame, lists: bool = False) -> DataFrame:
    """One row for each (src, dst, relation): the highest confidence, the latest source, how often merged.

    Where ``relations`` have sentences, an edge has its first one by time (then in order of text) and
    ``first_at``, when that was. With ``lists`` an edge also has all_sources, a sorted array; ``edge_sources`` has them as rows.
    """
    rows, key = _full(relations), ("src", "dst", "relation")
    said = "sentence" in relations.columns
    if not lists and not said:  # a row for each source first, by hash, as it holds numbers only; then each source counts once
        each = rows.groupBy(*key, "source").agg(F.max("confidence").alias("confidence"), F.max("ts").alias("timestamp"), F.count("*").alias("n"))
        return each.groupBy(*key).agg(
            F.max("confidence").alias("confidence"), F.max("timestamp").alias("timestamp"), F.max_by("source", F.struct("timestamp", "source")).alias("source"),
            F.sum("n").alias("merge_count"), F.count("source").alias("n_sources"),
        )
    more = [F.size(F.collect_set("source")).cast("long").alias("n_sources"), F.array_sort(F.collect_set("source")).alias("all_sources")] if lists else []
    edges = rows.groupBy(*key).agg(
        F.max("confidence").alias("confidence"), F.max("ts").alias("timestamp"), F.max_by("source", F.struct("ts", "source")).alias("source"),
        F.count("*").alias("merge_count"), *more, *(_first_sentence("ts") if said else []),
    )
    return edges if lists else _with_n_sources(edges, edge_sources(relations), *key)


def _first_sentence(at: str) -> list[Column]:
    """The first sentence of a group by time, then by text, and its time; rows without a sentence don't count."""
    has = F.col("sentence").isNotNull()
    return [F.min_by("sentence", F.when(has, F.struct(at, "sentence"))).alias("sentence"), F.min(F.when(has, F.col(at))).alias("first_at")]


def build_summary(relations: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """One row: relations added and skipped, and, of given mentions (text), entities added and skipped."""
    rows = _relation_counts(relations)
    if mentions is None:
        return rows
    blank = normalize_node_id(F.col("text")).isNull()
    return mentions.agg(F.count_if(~blank).alias("entities_added"), F.count_if(blank).alias("entities_skipped")).crossJoin(rows)  # two tables of one row


def _relation_counts(relations: DataFrame) -> DataFrame:
    bad = normalize_node_id(F.col("subject")).isNull() | normalize_node_id(F.col("object")).isNull() | normalize_text(F.col("verb")).isNull()
    return relations.agg(F.count_if(~bad).alias("relations_added"), F.count_if(bad).alias("relations_skipped"))


def remove_entity(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    gone = " ".join(name.split()).lower()
    return nodes.filter(F.col("id") != gone), edges.filter((F.col("src") != gone) & (F.col("dst") != gone))


def _united(name: str) -> Column:
    """The sorted distinct elements of the arrays of a group; here one for each of two tables."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two edge tables as one, by the rules that build them.

    Where both have all_sources, so has the result, with n_sources; otherwise sources can't be told
    apart by their number, and n_sources is left to ``edge_sources``.
    """
    rows = a.unionByName(b, allowMissingColumns=True)
    lists = "all_sources" in a.columns and "all_sources" in b.columns
    merged = rows.groupBy("src", "dst", "relation").agg(
        F.max("confidence").alias("confidence"), F.max("timestamp").alias("timestamp"), F.max_by("source", F.struct("timestamp", "source")).alias("source"), F.sum("merge_count").alias("merge_count"), *([_united("all_sources").alias("all_sources")] if lists else []),
        *(_first_sentence("first_at") if "sentence" in rows.columns else []),
    )
    return merged.withColumn("n_sources", F.size("all_sources").cast("long")) if lists else merged


def merge_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two node tables as one: the first name, all labels, added mentions, first and last sight; sources as in merge_edges."""
    rows = a.unionByName(b, allowMissingColumns=True)
    lists = "sources" in a.columns and "sources" in b.columns
    merged = rows.groupBy("id").agg(
        F.min_by("canonical_name", F.struct("first_seen", "canonical_name")).alias("canonical_name"), _united("labels").alias("labels"), F.sum("mention_count").alias("mention_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *([_united("sources").alias("sources")] if lists else []),
    )
    return merged.withColumn("n_sources", F.size("sources").cast("long")) if lists else merged


def paper_source(papers: DataFrame) -> Column:
    return F.coalesce("pmid", "doi", F.lit("unknown"))


def process_papers(papers: DataFrame, patterns: DataFrame, verbs: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, status) of papers (ord, abstract, pmid, doi, ts): mentions and relations found, built into a graph.

    status is (ord, source, status, n_mentions, n_relations); a paper with a blank abstract is skipped.
    Edges have the first sentence that says so.
    """
    return _processed(_landed(papers), patterns, verbs)


def _landed(papers: DataFrame) -> DataFrame:
    """(ord, source, ts, abstract, blank) written, dealt over tasks: a table of papers may be one file of one row group, which a single task would read."""
    source = papers.select("ord", paper_source(papers).alias("source"), "ts", "abstract", (~F.coalesce(F.col("abstract").rlike(r"\S"), F.lit(False))).alias("blank"))
    return cut(source.repartition("ord"))  # read for mentions, for relations and for the status


def _processed(source: DataFrame, patterns: DataFrame, verbs: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = source.filter("not blank").select("ord", "abstract")
    about = source.select("ord", "source", "ts")
    mentions = cut(extract_mentions(texts, "ord", "abstract", patterns))
    found = extract_svo(texts, "ord", "abstract", verbs, sentences=True)
    relations = cut(found.withColumn("confidence", relation_confidence(F.lit(False), F.col("passive"), F.col("negated"))))
    counts = lambda rows, name: rows.groupBy("ord").agg(F.count("*").alias(name))
    status = source.join(counts(mentions, "n_mentions"), "ord", "left").join(counts(relations, "n_relations"), "ord", "left")
    status = status.select("ord", "source", F.when(F.col("blank"), "skipped").otherwise("processed").alias("status"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_mentions", "n_relations")])
    named, said = mentions.join(about, "ord"), relations.join(about, "ord")
    return build_nodes(named, said), build_edges(said), status


def update_graph(papers: DataFrame, patterns: DataFrame, verbs: dict[str, str], path: str) -> DataFrame:
    """Adds to the graph at ``path`` what papers say that it hasn't seen, and gives their status; see ``process_papers``.

    Nodes, edges and the ledger of papers are versioned stores. Papers of the ledger aren't processed again,
    and the batch's name depends on its papers alone; so a run that stopped half way and runs again goes on
    with the stores that it hasn't reached, and a run without new papers adds nothing.
    """
    from evidex.sources import store

    spark = papers.sparkSession
    seen = store.read_version(spark, f"{path}/ledger", store.snapshot(spark, f"{path}/ledger")[1])
    fresh = _landed(papers if seen is None else papers.join(seen.select("ord"), "ord", "left_anti"))
    n, mark = fresh.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("ord")), F.lit(0))).first()
    if not n and seen is not None:  # nothing new: the status has no rows
        return seen.limit(0)
    nodes, edges, status = _processed(fresh, patterns, verbs)
    if n:
        batch = f"{n}-{mark & (1 << 64) - 1:x}"
        edge_id = F.sha2(F.concat_ws("|", "src", "relation", "dst"), 256).alias("edge_id")
        store.upsert_store(cut(nodes.drop("n_sources")), f"{path}/nodes", "id", batch=batch, merge=merge_nodes)
        merge = lambda held, new: merge_edges(held, new).select("*", edge_id)
        store.upsert_store(cut(edges.drop("n_sources").select("*", edge_id)), f"{path}/edges", "edge_id", batch=batch, merge=merge)
        store.upsert_store(cut(status), f"{path}/ledger", "ord", batch=batch)
    return status


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ledger) that ``update_graph`` has made."""
    from evidex.sources import store

    nodes, edges, ledger = (store.read_store(spark, f"{path}/{x}") for x in ("nodes", "edges", "ledger"))
    return nodes, edges.drop("edge_id"), ledger


def node_exists(nodes: DataFrame, names: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct().withColumn("found", F.lit(True))
    return names.withColumn("id", normalize_node_id(F.col("name"))).join(ids, "id", "left").select("name", F.coalesce("found", F.lit(False)).alias("exists"))


def edge_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    known = edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    asked = pairs.withColumns({"src": normalize_node_id(F.col("a")), "dst": normalize_node_id(F.col("b"))})
    return asked.join(known, ["src", "dst"], "left").select("a", "b", F.coalesce("found", F.lit(False)).alias("exists"))


def get_targets(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities.select(normalize_node_id(F.col("name")).alias("src")).distinct(), "src", "left_semi")


def get_sources(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities.select(normalize_node_id(F.col("name")).alias("dst")).distinct(), "dst", "left_semi").withColumnRenamed("src", "source_entity")


def find_relation(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.filter((F.col("src") == a.lower()) & (F.col("dst") == b.lower()))


def neighbors(edges: DataFrame) -> DataFrame:
    """(id, predecessors, successors): how many distinct ones each node has."""
    distinct = edges.select("src", "dst").distinct()
    out = distinct.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("successors"))
    into = distinct.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("predecessors"))
    return out.join(into, "id", "full").select("id", F.coalesce("predecessors", F.lit(0)).alias("predecessors"), F.coalesce("successors", F.lit(0)).alias("successors"))


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(found, path, length): breadth first from both ends; among shortest paths the least by its nodes in order.

    A round extends the side with the smaller frontier by one step. Its rows are a node and, on the side of
    ``b``, the least next node on the way there, so they have one size at any depth. Where the sides meet,
    the nodes of the other side that lie on a shortest path get their next nodes level by level, and the
    least path is read off from ``a`` on.
    """
    spark = edges.sparkSession
    a, b = normalize_of(a), normalize_of(b)
    schema = "found boolean, path array<string>, length int"
    links = edges.select("src", "dst").distinct()
    known = links.filter((F.col("src").isin(a, b)) | F.col("dst").isin(a, b)).selectExpr("explode(array(src, dst)) as id").filter(F.col("id").isin(a, b)).distinct().count()
    none = spark.createDataFrame([(False, [], 0)], schema)
    if known < len({a, b}):
        return none
    if a == b:
        return spark.createDataFrame([(True, [a], 0)], schema)
    links = cut(links)
    level = lambda path: spark.read.schema("id string, next string").parquet(path)
    fore, back = ([write_cut(spark.createDataFrame([(end, None)], "id string, next string"))] for end in (a, b))
    size = {0: 1, 1: 1}
    while True:
        side = int(size[1] < size[0])
        own, other = (back, fore) if side else (fore, back)
        here, there = ("dst", "src") if side else ("src", "dst")
        reached = links.join(level(own[-1]).select(F.col("id").alias(here)), here).groupBy(F.col(there).alias("id")).agg(F.min(here).alias("next"))
        seen = spark.read.schema("id string").parquet(*own)
        own.append(write_cut(reached.join(seen, "id", "left_anti")))
        size[side], met = level(own[-1]).join(level(other[-1]).select("id", F.lit(1).alias("met")), "id", "left").agg(F.count("*"), F.count("met")).first()
        if met:
            break
        if not size[side]:
            return none
    good = level(fore[-1]).join(level(back[-1]).select("id"), "id", "left_semi")  # all that are half way on a shortest path
    ways = [level(x) for x in back[-2::-1]] if len(back) > 1 else []  # the next nodes from level to level, after the meeting
    first = level(back[-1]).join(good.select("id"), "id", "left_semi")
    before = []
    for x in fore[-2::-1]:
        step = links.join(good.select(F.col("id").alias("dst")), "dst").join(level(x).select(F.col("id").alias("src")), "src")
        good = cut(step.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next")))
        before.append(good)
    path, steps = [a], [*before[::-1], first, *ways]
    for k in range(0, len(steps), READ_OFF):
        at = spark.createDataFrame([(path[-1],)], "n0 string")
        some = steps[k : k + READ_OFF]
        for i, step in enumerate(some):
            at = step.select(F.col("id").alias(f"n{i}"), F.col("next").alias(f"n{i + 1}")).join(F.broadcast(at), f"n{i}")  # a row of names
        row = at.select(*[f"n{i + 1}" for i in range(len(some))]).first()
        path += [x for x in row if x is not None]
    return spark.createDataFrame([(True, path, len(path) - 1)], schema)


#: Steps of a path that are read off in one job.
READ_OFF = 6


#: Parts that the rows of one component, or of one phrase, are dealt into when they look up what it has.
SALTS = 16


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected, by the least id.

    Each round hands a node, and also its root, the least root of a root among itself and its
    neighbours, so whole trees hook onto smaller ones beside them; rounds go on until nothing changes.
    """
    links = edges.select("src", "dst").distinct()
    both = cut(links.union(links.select("dst", "src")).toDF("id", "other").filter("id <> other"))
    state = cut(nodes.select("id", F.col("id").alias("root")).distinct())
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    while True:
        jump = state.filter("root <> id").select(F.col("id").alias("root"), F.col("root").alias("beyond"), salts.alias("salt"))
        dealt = state.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        grand = dealt.join(jump, ["root", "salt"], "left").select("id", "root", F.coalesce("beyond", "root").alias("grand"))
        near = both.join(grand.select(F.col("id").alias("other"), F.col("grand").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        low = grand.join(near, "id", "left").select("id", F.col("root").alias("was"), F.least("grand", F.coalesce("c", "grand")).alias("low"))
        own, hook = F.struct("id", "was", "low"), F.struct(F.col("was").alias("id"), F.lit(None).cast("string").alias("was"), "low")
        moved = cut(low.select(F.inline(F.array(own, hook))).groupBy("id").agg(F.min("low").alias("root"), F.max("was").alias("was")))
        if moved.filter("root <> was").isEmpty():
            return moved.select("id", F.col("root").alias("component"))
        state = moved.select("id", "root")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; zeros for an empty graph."""
    nodes, edges = cut(nodes.select("id")), cut(edges.select("src", "dst"))  # read many times
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    parts = connected_components(nodes, edges).agg(F.count_distinct("component").alias("n_components"))
    top = degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id"))), lambda x: x["id"]).alias("top"))
    one = n.crossJoin(m).crossJoin(parts).crossJoin(top)  # four tables of one row
    x, y = F.col("n_nodes"), F.col("n_edges")
    return one.select("n_nodes", "n_edges", F.coalesce(F.round(F.try_divide(y, x * (x - 1)), 4), F.lit(0.0)).alias("density"), "n_components", (F.col("n_components") == 1).alias("connected"), F.coalesce(F.round(F.try_divide(y, x), 4), F.lit(0.0)).alias("edges_per_node"), "top")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    return degrees(nodes, edges).crossJoin(n).select("id", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def node_importance(nodes: DataFrame, edges: DataFrame, weight: str = "mention_count", compat: bool = False) -> DataFrame:
    """(id, importance): centrality and the share of the highest weight; with ``compat`` every weight is 1."""
    w = F.lit(1.0) if compat else F.col(weight).cast("double")
    weighed = nodes.select("id", w.alias("w"))
    most = F.broadcast(weighed.agg(F.max("w").alias("most")))
    return degree_centrality(nodes, edges).join(weighed, "id").crossJoin(most).select("id", F.round(0.6 * F.col("centrality") + 0.4 * F.coalesce(F.try_divide(F.col("w"), F.col("most")), F.lit(0.0)), 9).alias("importance"))


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 50, max_edges: int = 100, least: float = 0.0, weight: str = "mention_count") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) worth showing: real labels, the ``max_nodes`` most important nodes, the ``max_edges``
    strongest edges between them, and five important ones without edges. Ties go by id; parallel edges
    are one. The screens that this was made for ask for 50 and 100 at most."""
    edges = cut(edges.select("src", "dst", "confidence"))  # both are read many times
    named = cut(nodes.filter(is_meaningful_label(F.col("canonical_name"))).select("id", weight))
    scored = node_importance(named, edges.join(named.select(F.col("id").alias("src")), "src", "left_semi").join(named.select(F.col("id").alias("dst")), "dst", "left_semi"), weight)
    enough = scored.filter(F.col("importance") >= least)
    scored = scored if enough.isEmpty() else enough
    top = cut(scored.orderBy(F.desc("importance"), "id").limit(max_nodes))
    a, b = top.toDF("src", "ia"), top.toDF("dst", "ib")
    pairs = edges.groupBy("src", "dst").agg(F.max("confidence").alias("weight"))
    shown = pairs.join(a, "src").join(b, "dst").withColumn("score", F.round(F.col("ia") + F.col("ib") + F.col("weight"), 6))
    shown = cut(shown.orderBy(F.desc("score"), "src", "dst").limit(max_edges).select("src", "dst", "score"))
    linked = shown.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = top.join(linked, "id", "left_anti").orderBy(F.desc("importance"), "id").limit(5)
    return top.join(linked, "id", "left_semi").union(alone), shown


def first_present(attributes: Column, keys, default: str) -> Column:
    """The first filled value of ``keys`` in a map of strings, trimmed and in small letters."""
    values = [F.nullif(F.trim(F.element_at(attributes, k)), F.lit("")) for k in keys]
    return F.lower(F.coalesce(*values, F.lit(default)))


def node_type(attributes: Column, default: str = "default") -> Column:
    return first_present(attributes, ("type", "entity_type", "label_type", "category", "ner_type"), default)


def edge_label(attributes: Column, default: str = "related_to") -> Column:
    return first_present(attributes, ("relation", "relation_type", "label", "predicate", "type"), default)


def typed(nodes: DataFrame) -> DataFrame:
    """(id, type): a node's first label as its type."""
    return nodes.select("id", node_type(F.create_map(F.lit("type"), F.get("labels", F.lit(0)))).alias("type"))


def _info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, importance, degree, type) of every node, written once for a report."""
    nodes = cut(nodes.select("id", "labels", "mention_count"))
    return cut(node_importance(nodes, edges).join(degrees(nodes, edges), "id").join(typed(nodes), "id"))


def _least(rows: DataFrame, name: str, most: int) -> DataFrame:
    """One row: the first ``most`` values in order, as an array."""
    return rows.select(name).distinct().orderBy(name).limit(most).agg(F.array_sort(F.collect_list(name)).alias(name))


def entity_pair_report(nodes: DataFrame, edges: DataFrame, a: str, b: str, most: int = 10, top: int = 20) -> DataFrame:
    """One row about two entities: degree, importance, type and up to ``most`` successors of both, up to
    ``most`` shared ones, the shortest path, the ``top`` entities by importance, and the graph's size.
    What an entity that the graph lacks would have is null or empty."""
    edges = cut(edges.select("src", "dst"))  # read many times
    ends, info = {"a": normalize_of(a), "b": normalize_of(b)}, _info(nodes, edges)
    after = {k: edges.filter(F.col("src") == e).select("dst").distinct() for k, e in ends.items()}
    own = info.agg(*[F.max(F.when(F.col("id") == e, F.col(c))).alias(f"{c}_{k}") for k, e in ends.items() for c in ("degree", "importance", "type")], F.count("*").alias("total_nodes"))
    best = info.orderBy(F.desc("importance"), "id").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "id"))).alias("top"))
    parts = [_least(after["a"].join(after["b"], "dst"), "dst", most).toDF("shared"), _least(after["a"], "dst", most).toDF("neighbors_a"), _least(after["b"], "dst", most).toDF("neighbors_b")]
    parts += [best.select(F.transform("top", lambda x: x["id"]).alias("top_entities")), edges.agg(F.count("*").alias("total_edges")), shortest_path(edges, a, b)]
    for part in parts:
        own = own.crossJoin(part)  # tables of one row
    return own


def normalize_of(name: str) -> str:
    return " ".join(name.split()).lower()


def neighbor_report(nodes: DataFrame, edges: DataFrame, name: str, top: int = 20) -> DataFrame:
    """(degree, dst, type, relation, importance): the entity's degree and up to ``top`` successors, the most important first."""
    edges = cut(edges.select("src", "dst", "relation"))  # read many times
    entity, info = normalize_of(name), _info(nodes, edges)
    own = info.filter(F.col("id") == entity).select("degree")
    out = edges.filter(F.col("src") == entity).select("dst", "relation").join(info.drop("degree").withColumnRenamed("id", "dst"), "dst")
    return out.orderBy(F.desc("importance"), "dst", "relation").limit(top).crossJoin(own).select("degree", "dst", "type", "relation", "importance")  # a table of one row


def cluster_report(clusters: DataFrame) -> DataFrame:
    """(leader, size) of clusters (id, leader) with more than one member."""
    return clusters.groupBy("leader").agg(F.count("*").alias("size")).filter("size > 1")


def label_texts(nodes: DataFrame) -> DataFrame:
    """(text): each node as "name (type)"."""
    return nodes.select(F.format_string("%s (%s)", "canonical_name", node_type(F.create_map(F.lit("type"), F.get("labels", F.lit(0))))).alias("text"))


def relation_texts(edges: DataFrame) -> DataFrame:
    """(text, key): each edge as "subject relation object", and the string that names it, "subject|relation|object"."""
    return edges.select(F.concat_ws(" ", "src", "relation", "dst").alias("text"), F.concat_ws("|", "src", "relation", "dst").alias("key"))


def sync_embeddings(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_id, text) of graph labels or relations that the store lacks; source_id is the hash of the
    text, or of its key where ``texts`` has one."""
    named = F.col("key") if "key" in texts.columns else F.col("text")
    rows = texts.select(F.sha2(normalize_text(named), 256).alias("source_id"), "text").filter("source_id is not null").dropDuplicates(["source_id"])
    return rows.join(stored.select("source_id").distinct(), "source_id", "left_anti")


def question_support(questions: DataFrame, store: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(query, node, score, rank, neighbors): the ``top`` nodes for each question, with their sorted neighbours, either way.

    ``questions`` are (query, vector), ``store`` has (id, node, vector) of nodes. An id has one vector and may
    stand for several nodes, each of which is a hit by itself; scores tie by id, then node. Only edges of
    nodes that were hit are gathered, once for each such node.
    """
    from evidex.operators.vectors import vector_search

    found = vector_search(store.select("id", "vector").distinct(), questions, top, exclude_self=False).drop("rank")
    named = found.join(store.select(F.col("id").cast("long").alias("id"), "node"), "id")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id", "node")
    hits = cut(named.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top))
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("n")).union(edges.select("dst", "src"))
    near = links.join(hits.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("n")).alias("neighbors"))
    return hits.join(near, "node", "left").select("query", "node", "score", "rank", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))
