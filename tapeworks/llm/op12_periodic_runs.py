"""Periodic runs of words: suffix trees of a text and of its reversal, and Lyndon roots extended in both directions.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` words long, which no neighbouring
word extends. Every run has a root that is the longest Lyndon word at its place, in the order of the symbols or in the
opposite one, so the candidates are the longest Lyndon words at all places:

1. Ukkonen's algorithm builds the suffix tree. The order of its leaves gives the ranks of the suffixes, and the next
   smaller rank the Lyndon words, once for each order of the symbols.
2. Between one leaf and the next the Euler tour turns at their lowest common ancestor, so the depths of the turning
   points under a sparse table answer the longest common extension of any two places in constant time.
3. The tree of the text extends candidates forward, the tree of the reversal backward, all candidates at once.

Only stretches where a run can be go into the trees: all words of a run lie in ``least // 2`` words in a row that occur
again in the text, whatever its period. Hashes find these words, and a chance match only adds a stretch; from there on
words are compared as numbers of a dictionary, exactly. A task holds one stretch at a time, about 500 bytes a word;
there is no shuffle.

Defined results: null and empty texts have no words and no runs; rows are kept one to one, whatever ids they have
or repeat; an empty table gives no rows; only ``keep``, the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeworks.llm.shared import table
from tapeworks.llm.words import batch_of, slices

LEAST = 12
RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Longest common extensions and suffix ranks of a sequence of positive ints."""

    def __init__(self, symbols: list[int]) -> None:
        self.n = len(symbols)
        self._build([*symbols, 0])

    def _build(self, text: list[int]) -> None:
        # the closing 0 occurs once, so every suffix gets a leaf; an edge has the key node * width + first symbol
        n, width = len(text), max(text) + 1
        edges: dict[int, int] = {}
        start, stop, link, suffix = [0], [0], [0], [-1]
        node = length = waiting = edge = 0
        for i, symbol in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    begin, end = start[child], stop[child]
                    if length >= end - begin:
                        edge += end - begin
                        length -= end - begin
                        node = child
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(start)
                    start.append(begin), stop.append(begin + length), link.append(0), suffix.append(-1)
                    edges[key] = split
                    edges[split * width + symbol] = split + 1
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    start[child] = begin + length
                    edges[split * width + text[begin + length]] = child
                    if made:
                        link[made] = split
                    made = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges, np.int64, len(edges))
        self._child = np.fromiter(edges.values(), np.int64, len(edges))
        self._parent, self._symbol = keys // width, keys % width
        self._edge = np.array(stop) - np.array(start)
        self._suffix = np.array(suffix)
        self._tour()

    def _preorder(self, symbol: np.ndarray) -> np.ndarray:
        """Nodes as a depth-first walk meets them, children by ``symbol``."""
        order = np.lexsort((-symbol, self._parent))
        kids = self._child[order].tolist()
        first = np.searchsorted(self._parent[order], np.arange(len(self._edge) + 1)).tolist()
        walk, stack = [], [0]
        while stack:
            node = stack.pop()
            walk.append(node)
            stack += kids[first[node] : first[node + 1]]
        return np.array(walk)

    def _tour(self) -> None:
        walk = self._preorder(self._symbol)
        up = np.zeros(len(walk), np.int64)
        up[self._child] = self._parent
        depth, of_parent, edge = [0] * len(walk), up.tolist(), self._edge.tolist()
        for node in walk.tolist()[1:]:
            depth[node] = depth[of_parent[node]] + edge[node]
        leaves = np.flatnonzero(self._suffix[walk] >= 0)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[self._suffix[walk[leaves]]] = np.arange(self.n + 1)
        # after a leaf the tour turns at the parent of the next node it enters
        turns = np.array(depth)[up[walk[leaves[:-1] + 1]]].astype(np.int32)
        self._least = [turns]
        while 2 << (len(self._least) - 1) <= len(turns):
            half, last = 1 << (len(self._least) - 1), self._least[-1]
            self._least.append(np.minimum(last[:-half], last[half:]))

    def opposite_rank(self) -> np.ndarray:
        """Ranks of the suffixes where symbols are in the opposite order; a prefix still comes first."""
        walk = self._preorder(np.where(self._symbol, -self._symbol, -(1 << 62)))
        own = self._suffix[walk]
        rank = np.empty(self.n + 1, np.int64)
        rank[own[own >= 0]] = np.arange(self.n + 1)
        return rank

    def extension(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many symbols from the places ``i`` and ``k`` (different, at most n) are the same."""
        a, b = self.rank[i], self.rank[k]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for own in np.unique(level):
            at = np.flatnonzero(level == own)
            least = self._least[own]
            out[at] = np.minimum(least[low[at]], least[high[at] - (1 << own)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix. The last rank is the empty one's."""
    ranks, out, stack = rank.tolist(), [0] * (len(rank) - 1), [len(rank) - 1]
    for i in range(len(rank) - 2, -1, -1):
        own = ranks[i]
        while ranks[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] - i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period."""
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    tree = SuffixTree(symbols)
    place = np.tile(np.arange(n), 2)
    period = np.concatenate([lyndon_lengths(tree.rank), lyndon_lengths(tree.opposite_rank())])
    fits = 2 * period <= n
    place, period = place[fits], period[fits]
    forward = tree.extension(place, place + period)
    # less than a period lies before the first root of a run
    enough = forward > np.maximum(least - 2 * period, 0)
    place, period, forward = place[enough], period[enough], forward[enough]
    if not len(place):
        return none
    del tree
    back = SuffixTree(symbols[::-1])
    backward = back.extension(n - place, n - place - period)
    length = backward + period + forward
    found = length >= np.maximum(least, 2 * period)
    rows = np.column_stack([place - backward, length, period])[found]
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(symbols: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches covered by ``width`` words in a row that occur twice or more; hash matches count as equal."""
    n = len(symbols) - width + 1
    if n < 2:
        return []
    values = symbols.astype(np.uint64) * _STEP
    values ^= values >> np.uint64(29)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams = grams * _STEP + values[k : k + n]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    edges = np.zeros(len(symbols) + 1, np.int64)
    again = np.flatnonzero(twice[at] == grams)
    edges[: n] += np.bincount(again, minlength=n)
    edges[width : width + n] -= np.bincount(again, minlength=n)
    flags = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(flags))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def text_runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of a whole text, found stretch by stretch."""
    out = []
    for start, stop in stretches(symbols, least // 2):
        # small numbers for the symbols of the stretch
        rows = runs_of((np.unique(symbols[start:stop], return_inverse=True)[1] + 1).tolist(), least)
        out.append(rows + np.array([start, 0, 0]))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def repeated(n_words: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that some run contains after its first period."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def find_runs(
    docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, doc_id: str = "doc_id",
    rewrite: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the text without repetitions of periods.

    ``rewrite(id, n)`` may give the number of the original word that stands at each place instead.
    """
    if least < 4:
        raise ValueError("runs shorter than four words are not looked for")
    out_schema = StructType([docs.schema[name] for name in keep] + StructType.fromDDL(RUNS).fields)
    arrow = to_arrow_schema(out_schema)

    def result(own, raw: str | None) -> tuple:
        words = (raw or "").encode().split()
        numbers: dict[bytes, int] = {}
        symbols = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
        order = rewrite(own, len(words)) if rewrite else None
        if order is not None:
            symbols, words = symbols[order], [words[i] for i in order.tolist()]
        runs = text_runs(symbols, least)
        if len(runs):
            words = [words[i] for i in np.flatnonzero(~repeated(len(words), runs)).tolist()]
        rows = [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()]
        return len(symbols), rows, b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                ids, texts = part.column(doc_id).to_pylist(), part.column(text).to_pylist()
                rows = list(map(result, ids, texts))
                yield batch_of([*(part.column(name) for name in keep), *zip(*rows, strict=True)], arrow)

    read = list(dict.fromkeys([*keep, doc_id, text]))
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, out_schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the query's contract: a tenth of the documents repeat one stretch to their end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % period)


def _longest(runs: str) -> Column:
    """The longest run; of equally long ones the first, then that of the smallest period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, for every document."""
    found = find_runs(table(spark, sf_dir, "documents"), ["doc_id"], rewrite=planted).withColumn("best", _longest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
