"""Periodic runs of words: stretches that repeat with a period three times or more, found by suffix trees.

A run's length is 24 words at least and three periods at least. Each run has a Lyndon root, which is the
longest Lyndon word at its place in the order of words or in the opposite one; so the longest Lyndon
words of both orders are all candidates there are, and each is extended to both sides by the longest
common extension of its two ends: the string depth of a lowest common ancestor in the suffix tree of the
text (to the right) or of its reversal (to the left). Both are found in constant time on an Euler tour.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import SPACES, coded, slices, small_batches, without, word_table, words_of

WORDS = word_table(other_than=SPACES)
#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Words of a gram that must come back within a period before a stretch is searched.
GRAM = 8
#: Words of stretches that share a tree; a longer stretch has its own.
TREE_WORDS = 4000


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers below ``symbols`` whose last one occurs once."""

    def __init__(self, s: list[int], symbols: int):
        n = len(s)
        start, stop, link, depth, suffix = [0] * (2 * n), [n] * (2 * n), [0] * (2 * n), [0] * (2 * n), [-1] * (2 * n)
        child: dict[int, int] = {}
        node = edge = size = left = 0
        new = 1  # the next node's number
        for i, c in enumerate(s):
            split = 0  # the inner node that still lacks its link
            left += 1
            while left:
                if not size:
                    edge = i
                key = node * symbols + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = new
                    if split:
                        link[split], split = node, 0
                else:
                    first = start[below]
                    whole = stop[below] - first
                    if size >= whole:
                        edge, size, node = edge + whole, size - whole, below
                        continue
                    at = first + size
                    if s[at] == c:
                        size += 1
                        if split:
                            link[split] = node
                        break
                    start[new], stop[new], depth[new] = first, at, depth[node] + size
                    child[key] = new
                    start[below] = at
                    child[new * symbols + s[at]] = below
                    if split:
                        link[split] = new
                    split = new
                    new += 1
                    child[split * symbols + c] = new
                start[new], suffix[new] = i, i - left + 1
                new += 1
                left -= 1
                if node:
                    node = link[node]
                elif size:
                    size, edge = size - 1, i - left + 1
        keys, self.below = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        self.above, self.symbol = np.divmod(keys, symbols)
        self.n, self.symbols, self.nodes = n, symbols, new
        self.suffix, self.depth = np.array(suffix[:new]), np.array(depth[:new])

    def tour(self, key: np.ndarray) -> "Tour":
        """The Euler tour, each node's children in order of ``key``, a number below ``symbols`` for each edge."""
        order = np.argsort(self.above * self.symbols + (self.symbols - 1 - key))  # last first, as a stack takes them
        above, below = self.above[order], self.below[order]
        counts = np.bincount(above, minlength=self.nodes)
        ends = np.cumsum(counts)
        flat = below.tolist()
        children = [flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
        stack, met = [0], []
        while stack:
            node = stack.pop()
            met.append(node)
            stack += children[node]
        place = np.empty(self.nodes, np.int64)
        place[met] = np.arange(self.nodes)
        leaf = self.suffix[met] >= 0
        leaves = np.cumsum(leaf) - leaf  # before each place
        later = np.ones(len(below), bool)
        later[ends[counts > 0] - 1] = False  # all but first children: the tour comes to them from their parent
        turns = np.zeros(self.n, np.int64)
        turns[leaves[place[below[later]]]] = self.depth[above[later]]
        return Tour(turns, self.suffix[met][leaf])


class Tour:
    """An Euler tour by its turning points: the lowest node between each leaf and the leaf before it.

    The least string depth between two leaves, that of their lowest common ancestor, is found in
    constant time by blocks and a sparse table over blocks.
    """

    BLOCK = 16

    def __init__(self, turns: np.ndarray, leaves: np.ndarray):
        b, most = self.BLOCK, np.iinfo(np.int32).max
        self.rank = np.empty(len(leaves), np.int64)  # of each suffix
        self.rank[leaves] = np.arange(len(leaves))
        self.flat = np.full((len(turns) // b + 2) * b, most, np.int32)
        self.flat[: len(turns)] = turns
        rows = self.flat.reshape(-1, b)
        self.ahead = np.minimum.accumulate(rows, axis=1).ravel()
        self.behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 1 << len(self.table) <= len(rows):
            last, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-step], last[step:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from ``i`` and ``j`` on, two different places of the sequence."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        p, q = a // self.BLOCK, b // self.BLOCK
        out = np.minimum(self.behind[a], self.ahead[b])
        same = np.flatnonzero(p == q)
        if len(same):
            at = a[same, None] + np.arange(self.BLOCK)
            out[same] = np.where(at <= b[same, None], self.flat[at], np.iinfo(np.int32).max).min(axis=1)
        gap = q - p - 1
        level = np.frexp(np.maximum(gap, 1))[1] - 1
        for k in np.unique(level[gap > 0]).tolist():
            own = np.flatnonzero((gap > 0) & (level == k))
            t = self.table[k]
            out[own] = np.minimum(out[own], np.minimum(t[p[own] + 1], t[q[own] - (1 << k)]))
        return out.astype(np.int64)


def lyndon_ends(ranks: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at each place ends: at the next suffix that is smaller."""
    order, out, stack = ranks.tolist(), [0] * len(ranks), []
    for i in range(len(order) - 1, -1, -1):
        r = order[i]
        while stack and order[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] if stack else len(order)
        stack.append(i)
    return np.array(out)


def runs_of(stretches: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(stretch, start, length, period) of every run in each of some sequences of word numbers, in order.

    All go into one pair of trees, apart by numbers that occur once and come before all words in both
    orders, so nothing extends across an end.
    """
    m = len(stretches) + 1
    distinct, flat = np.unique(np.concatenate(stretches), return_inverse=True)
    sizes = np.array([len(x) for x in stretches])
    ends = np.append(0, np.cumsum(sizes + 1))  # places of the separators
    s = np.zeros(ends[-1] + 1, np.int64)
    s[ends] = np.arange(m)
    inner = np.ones(len(s), bool)
    inner[ends] = False
    s[inner] = flat.ravel() + m
    n, symbols = len(s), m + len(distinct)
    tree = SuffixTree(s.tolist(), symbols)
    ahead = tree.tour(tree.symbol)
    opposite = tree.tour(np.where(tree.symbol < m, tree.symbol, m + symbols - 1 - tree.symbol))
    del tree
    i = np.flatnonzero(inner)
    i, j = np.divmod(np.unique(np.concatenate([i * (n + 1) + lyndon_ends(t.rank)[i] for t in (ahead, opposite)])), n + 1)
    tree = SuffixTree(s[::-1].tolist(), symbols)
    behind = tree.tour(tree.symbol)
    period = j - i
    end, start = j.copy(), i.copy()
    on = j < n
    end[on] += ahead.extension(i[on], j[on])
    start -= behind.extension(n - i, n - j)  # a separator stands before i, so neither place is past the end
    length = end - start
    kept = length >= np.maximum(least, times * period)
    rows = np.unique(np.stack([start[kept], period[kept], length[kept]], axis=1), axis=0)
    where = np.searchsorted(ends, rows[:, 0]) - 1
    return np.stack([where, rows[:, 0] - ends[where] - 1, rows[:, 2], rows[:, 1]], axis=1)


def repetitive(codes: np.ndarray, before: np.ndarray, least: int = LEAST, times: int = TIMES, gram: int = GRAM) -> np.ndarray:
    """(document, begin, end) of stretches that hold every run whole, with the words that end it.

    In a run of period q each gram after the first q comes back from at most q words before, and there
    are (times - 1) q - gram + 1 such grams in a row, or more where the least length asks for more. So a
    scale for each power of two asks for grams that come back within it, as many in a row as its runs
    have. Grams are told apart by a hash, which can only add stretches.
    """
    none = np.zeros((0, 3), np.int64)
    n = len(codes)
    gram = max(1, min(gram, least // times))
    if n < least:
        return none
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    h, size = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while size < gram:  # of twice as many words, or as many as lack
        step = min(size, gram - size)
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        size += step
    whole = np.flatnonzero(doc[: n - gram + 1] == doc[gram - 1 :])
    h = (h[whole] ^ doc[whole].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(64 - max(10, int(n).bit_length() + 1))
    slot = (h >> bits).astype(np.int64)
    twice = np.flatnonzero(np.bincount(slot)[slot] > 1)  # a gram alone in its slot doesn't come back
    h, whole = h[twice], whole[twice]
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    at, back = whole[order[again + 1]], whole[order[again + 1]] - whole[order[again]]
    sort = np.argsort(at)
    at, back = at[sort], back[sort]
    found, scale = [], 1
    while len(at) and scale // 2 < n:
        low = scale // 2 + 1  # the smallest period of this scale; the row is shortest for it, or for the largest below least / times
        need = max(1, min(max(least, times * q) - q for q in (low, scale, min(max(low, least // times), scale))) - gram + 1)
        near = at[back <= scale]
        heads = np.flatnonzero(np.append(True, np.diff(near) != 1)) if len(near) else near
        tails = np.append(heads[1:], len(near))
        long = tails - heads >= need
        first, last = near[heads[long]], near[tails[long] - 1]
        own = doc[first]
        found.append(np.stack([own, np.maximum(first - scale - 1, before[own]), np.minimum(last + gram + 1, before[own + 1])], axis=1))
        scale *= 2
    rows = np.concatenate(found) if found else none
    if not len(rows):
        return none
    rows = rows[np.argsort(rows[:, 1], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 2])
    heads = np.flatnonzero(np.append(True, rows[1:, 1] >= reach[:-1]))
    return np.stack([rows[heads, 0], rows[heads, 1], reach[np.append(heads[1:], len(rows)) - 1]], axis=1)


def document_runs(codes: np.ndarray, before: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(document, start, length, period) of all runs of many documents, by document, start and period."""
    places = repetitive(codes, before, least, times)
    group = (np.cumsum(places[:, 2] - places[:, 1]) // TREE_WORDS) if len(places) else np.zeros(0, np.int64)
    out = [np.zeros((0, 4), np.int64)]
    for g in np.unique(group).tolist():
        own = places[group == g]
        rows = runs_of([codes[a:b] for _, a, b in own.tolist()], least, times)
        rows[:, 1] += (own[:, 1] - before[own[:, 0]])[rows[:, 0]]
        rows[:, 0] = own[rows[:, 0], 0]
        out.append(rows)
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _strongest(runs: np.ndarray) -> np.ndarray:
    """Of the runs of one document that with the greatest length by period; ties: least start, then period."""
    ratio = runs[:, 2] / runs[:, 3]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)]
    best = max(Fraction(x, p) for x, p in near[:, 2:].tolist())
    return next(r for r in near if Fraction(*r[2:].tolist()) == best)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with n_words, n_runs, runs, start, length, period, exponent_milli and collapsed.

    ``runs`` are all periodic runs of the text's words (start, length, period; by start, then period);
    the four numbers are those of the strongest one, null where there is none; ``collapsed`` are the
    words that no run has after its first period, joined by one space. Null texts have no words. Each
    row is a document of its own, repeated rows and null ids too; columns of the results' names are
    replaced. A task holds some megabytes of text, or one longer document; trees are built for the
    stretches in which grams come back, so their memory grows with a document's longest such stretch.
    """
    small_batches(docs.sparkSession)
    names = ("n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "collapsed")
    docs = without(docs, *names)
    text = f"c{docs.columns.index('text')}"
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                words, before = words_of(part.column(text), WORDS)
                rows = document_runs(coded(words)[0], before, least, times)
                n = len(part)
                counts = np.bincount(rows[:, 0], minlength=n)
                ends = np.append(0, np.cumsum(counts))
                best = np.zeros((n, 4), np.int64)
                for d in np.flatnonzero(counts).tolist():
                    best[d] = _strongest(rows[ends[d] : ends[d + 1]])
                change = np.zeros(len(words) + 1, np.int64)
                at = before[rows[:, 0]] + rows[:, 1]
                np.add.at(change, at + rows[:, 3], 1)
                np.add.at(change, at + rows[:, 2], -1)
                kept = np.cumsum(change[:-1]) == 0
                held = np.append(0, np.cumsum(kept))[before]
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(held), words.filter(pa.array(kept))), pa.scalar(b" ", pa.large_binary()))
                no = counts == 0
                whole = lambda x: pa.array(x.astype(np.int64), mask=no)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(run)))
                new = {
                    "n_words": pa.array(np.diff(before).astype(np.int64)), "n_runs": pa.array(counts.astype(np.int64)), "runs": listed,
                    "start": whole(best[:, 1]), "length": whole(best[:, 2]), "period": whole(best[:, 3]), "exponent_milli": whole(1000 * best[:, 2] // np.maximum(best[:, 3], 1)),
                    "collapsed": joined.cast(pa.large_string()).cast(pa.string()),
                }
                yield pa.record_batch({c: part.column(c) for c in part.schema.names} | new)

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    shape = {"n_words": zero, "n_runs": zero, "runs": F.array(F.struct(*[zero.alias(x) for x in ("start", "length", "period")])), "start": none, "length": none, "period": none, "exponent_milli": none, "collapsed": F.lit("")}
    return named.mapInArrow(find, named.withColumns(shape).schema).toDF(*docs.columns, *names)
