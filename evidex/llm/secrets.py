"""Secret scans in built-in functions only: fixed patterns, and windows of high entropy.

Candidate strings are long runs of characters that keys are made of. Over each candidate a window
slides one character at a time; the counts of the characters in it change by one in and one out, and
with them the sum of c log2 c, from which the window's Shannon entropy follows. A candidate whose
highest window passes the limit of its character class is a secret, unless the allow-list names it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import let, without

#: Kind, pattern, group that has the length, least length of it; in the order of kinds.
PATTERNS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Quick tests that each text with a kept match passes.
HINTS = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}")

#: Candidates for entropy are runs of these characters, of a window's length at least; the allow-list asks for a digit.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Character class, what a candidate of it matches, and the least entropy of its highest window; first match counts.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("lower", r"^[0-9a-z]+$", 3.5), ("mixed", r"^.*$", 3.8))
WINDOW = 20

#: Allow-list: a candidate that one of these matches is no secret.
ALLOW = (r"(?i)example|placeholder|changeme", r"(^|[^A-Za-z])(?i:sample|dummy)([^A-Za-z]|$)", r"^(.)\1+$", r"^[^0-9]+$", r"^[0-9]+$", r"(?i)0123456789|abcdefghij", r"(/[a-z_-]{3,}){2}")


#: Matches of a text that are gone through at a time.
PIECE = 1024


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, order, end, kind, value) of the pattern's matches, leftmost first, that are long enough.

    A match's start is the length of all parts and matches before it, in code points. Matches are gone
    through in pieces, so that what is found is copied once for a piece and not once for a match.
    """
    parts = let(F.split(text, pattern, -1), lambda p: F.transform(p, F.length))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), F.length(g).alias("g")))
    rows = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), found, lambda p, f: F.struct(p.alias("gap"), f.alias("f")))
    start = F.struct(F.lit(0).alias("at"), F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))), lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        end = begin + row["f"]["n"]
        new = F.struct(begin.alias("start"), end.alias("end"), row["f"]["m"].alias("value"))
        kept = F.when(row["f"]["g"] >= least, F.concat(acc["out"], F.array(new))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    none = start["out"]

    def piece(acc: Column, k: Column, rows: Column) -> Column:
        done = F.aggregate(F.slice(rows, k * PIECE + 1, PIECE), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def pieces(rows: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.filter(F.array(none), lambda x: F.lit(False)).alias("outs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(rows) / PIECE).cast("int")), begin, lambda acc, k: piece(acc, k, rows))["outs"])

    out = let(rows, pieces)
    return F.transform(out, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any ``window`` neighbouring characters of ``ALPHABET``.

    A shorter string is one window. Characters outside the alphabet count as one more symbol.
    """
    size = len(ALPHABET) + 1
    number = lambda c: let(F.instr(F.lit(ALPHABET), c), lambda k: F.when(k > 0, k).otherwise(size))
    return _entropy(value, window, size, number)


def _entropy(value: Column, window: int, size: int, number) -> Column:
    logs = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    table = F.array(*[F.lit(x) for x in logs])
    term = lambda t, c: F.element_at(t, c + 1)

    def scan(bound: Column) -> Column:
        symbols, t, width = bound["s"], bound["t"], bound["w"]
        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))

        def step(acc: Column, come: Column) -> Column:
            gone = F.when(acc["i"] >= width, F.element_at(symbols, F.greatest(acc["i"] - width + 1, F.lit(1)))).otherwise(F.lit(0))
            less = F.when(gone > 0, F.element_at(acc["counts"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
            more = F.element_at(acc["counts"], come) - F.when(gone == come, 1).otherwise(0)
            total = acc["sum"] - term(t, less) + F.when(less > 0, term(t, F.greatest(less - 1, F.lit(0)))).otherwise(F.lit(0.0)) + term(t, more + 1) - term(t, more)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0))
            full = acc["i"] + 1 >= width
            entropy = F.log2(width.cast("double")) - total / width
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(full, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"), (acc["i"] + 1).alias("i"))

        return F.aggregate(symbols, start, step)["best"]

    symbols = F.transform(F.split(value, ""), number)
    bound = F.struct(symbols.alias("s"), table.alias("t"), F.least(F.length(value), F.lit(window)).alias("w"))
    return let(bound, scan)


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_entropy (long), base_sha256 and spans (strings).

    A span is kind:start:end in code points, end exclusive; spans stand by start, then kind, joined by
    commas. Kind ``entropy`` is what the method adds: candidates that overlap no span of the patterns,
    pass their class's limit and aren't on the allow-list, which by default lets all without a digit pass
    as words, or with nothing else as numbers. Null texts count as empty and have none.
    Columns with the names of results are replaced; repeated rows each get their result.
    """
    names = ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")
    docs = without(docs, *names)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    found = [F.when(text.rlike(hint), spans(text, kind, k, pattern, group, least)).otherwise(none) for k, ((kind, pattern, group, least), hint) in enumerate(zip(PATTERNS, HINTS))]
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text_name = f"c{docs.columns.index('text')}"
    named = named.select("*", F.col(text_name).alias("text"))
    rows = named.select(*[c for c in named.columns if c != "text"], "text", *[f.alias(kind) for f, (kind, *_) in zip(found, PATTERNS)])
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumn("base", base)

    allowed = lambda v: F.lit(False) if not allow else _any([v.rlike(a) for a in allow])

    highest = lambda v: highest_entropy(v, window)
    candidate = CANDIDATE % window
    candidates = F.when(text.rlike(candidate), spans(text, "entropy", len(PATTERNS), candidate, 0, window)).otherwise(none)
    fresh = F.filter(candidates, lambda x: ~allowed(x["value"]))
    fresh = let(F.struct(fresh.alias("f"), F.col("base").alias("b")), lambda z: F.filter(z["f"], lambda x: ~F.exists(z["b"], lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))))
    added = F.filter(fresh, lambda x: highest(x["value"]) >= _limit(x["value"]))
    rows = rows.withColumn("added", added)
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda c: F.size(c).cast("long")
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("added").alias("n_entropy"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _limit(value: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, shape, limit in reversed(CLASSES[:-1]):
        out = F.when(value.rlike(shape), F.lit(limit)).otherwise(out)
    return out
