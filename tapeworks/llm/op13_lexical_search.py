"""Ranked lexical search by dual trees: hierarchies over items and over documents that hold coordinate maxima.

A document's score for an item is a sum over terms of the item's part (its count of the term, times the term's weight)
and the document's part (the saturated number of occurrences), none of them negative. So the sum over coordinate maxima
of a group of items and a group of documents bounds every score between the two.

1. The items come first, in blocks of at most ``block_terms`` words. Their terms are the coordinates. One pass turns the
   texts into vectors over these terms (a fraction of the text); counts of all documents follow from the vectors.
2. On the driver, items that share their heaviest term become leaves of the item tree; a parent holds the maxima.
3. Each task reads vectors, sorts ``HELD`` entries' worth of documents by their heaviest term, and builds a document tree
   over neighbours. A pair of nodes is opened only while its bound reaches the weakest k-th score of the node's items;
   pairs of leaves are scored exactly. K-th scores stay with the task, so later batches lose more pairs.
4. Every task gives k rows an item; two rounds of ranking, the first within salts, leave the best k.

Scores are whole numbers below 2^53, so products of float64 matrices give them exactly. Equal bounds are opened, since
ties go to the smaller id. Texts are read in ``PIECE`` bytes. Only items, weights and one tree an item block go to tasks.

Defined results: null texts have no terms; an item without terms or matches has no rows; rows of an item whose id occurs
twice are ranked for each row; rows of documents without an id count in the statistics but are not ranked; repeated
ids are ranked row by row; empty tables give no rows; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.shared import table
from tapeworks.llm.words import batch_of, slices
from tapeworks.session import staged

# fixed values of the score: the share of a document's length in m, and the scale of saturation
BASE, LENGTH_SHARE, SCALE, SATURATION = 100, 75, 1_000_000_000, 8
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text cut at once, entries of vectors sorted at once, and cells of one matrix of documents.
PIECE, HELD, CELLS = 1 << 20, 1 << 21, 1 << 21
LEAF_DOCS, LEAF_ITEMS, FAN = 16, 4, 4
VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> Counter:
    """Terms of a text, in UTF-8, and how often each occurs."""
    raw, out, at = (text or "").encode().translate(_LOWER), Counter(), 0
    while at < len(raw):
        border = _BETWEEN.search(raw, at + PIECE)
        to = border.end() if border else len(raw)
        out.update(TERM.findall(raw, at, to))
        at = to
    return out


@dataclass
class Node:
    """A group of items: columns (terms) with the largest part of any of them."""

    columns: np.ndarray
    parts: np.ndarray
    items: np.ndarray
    children: list[Node] = field(default_factory=list)
    matrix: np.ndarray | None = None  # leaves: columns x items


def _join(nodes: list[Node]) -> Node:
    columns = np.unique(np.concatenate([n.columns for n in nodes]))
    parts = np.zeros(len(columns))
    for n in nodes:
        at = np.searchsorted(columns, n.columns)
        parts[at] = np.maximum(parts[at], n.parts)
    return Node(columns, parts, np.concatenate([n.items for n in nodes]), nodes)


def item_tree(items: list[Counter], weights: np.ndarray) -> Node | None:
    """The tree over items (counts by term number); items without a weighted term are left out."""
    leaves, known = [], []
    for number, counts in enumerate(items):
        columns = np.array(sorted(t for t in counts if weights[t] > 0), np.int64)
        if len(columns):
            parts = np.array([counts[t] for t in columns.tolist()]) * weights[columns]
            known.append((int(columns[np.argmax(weights[columns])]), number, columns, parts))
    known.sort(key=lambda row: row[:2])
    for at in range(0, len(known), LEAF_ITEMS):
        own = known[at : at + LEAF_ITEMS]
        leaf = _join([Node(columns, parts, np.array([number])) for _, number, columns, parts in own])
        leaf.children, leaf.matrix = [], np.zeros((len(leaf.columns), len(own)))
        for k, (_, _, columns, parts) in enumerate(own):
            leaf.matrix[np.searchsorted(leaf.columns, columns), k] = parts
        leaves.append(leaf)
    while len(leaves) > 1:
        leaves = [_join(leaves[at : at + FAN]) for at in range(0, len(leaves), FAN)]
    return leaves[0] if leaves else None


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64)] * n_items, [np.zeros(0, np.int64)] * n_items
        self.kth = np.zeros(n_items)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.kth[item]))
        if not len(good):
            return
        scores = np.concatenate([self.scores[item], scores[good]])
        ids = np.concatenate([self.ids[item], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[item] = scores[order[-1]]


def _maxima(rows: np.ndarray, width: int) -> np.ndarray:
    return np.maximum.reduceat(rows, np.arange(0, len(rows), width), axis=0)


class DocTree:
    """Levels of coordinate maxima over neighbouring documents; level 0 holds the documents themselves."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.ids, self.levels = ids, [rows]
        while len(self.levels[-1]) > 1:
            self.levels.append(_maxima(self.levels[-1], LEAF_DOCS if len(self.levels) == 1 else FAN))
        self.opened = 0

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        fan = LEAF_DOCS if level == 1 else FAN
        kids = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return kids[kids < len(self.levels[level - 1])]

    def search(self, items: Node, level: int, nodes: np.ndarray, best: Best) -> None:
        """Open the pairs of ``items`` and ``nodes`` whose bound reaches the weakest k-th score."""
        bounds = self.levels[level][np.ix_(nodes, items.columns)] @ items.parts
        open_ = (bounds > 0) & (bounds >= best.kth[items.items].min())
        nodes, bounds = nodes[open_], bounds[open_]
        if not len(nodes):
            return
        if level > 1 or (level and items.children):
            # the largest bounds first, so that k-th scores grow early
            nodes = nodes[np.argsort(-bounds, kind="stable")]
            for child in items.children or [items]:
                self.search(child, level - 1, self.below(level, nodes), best) if level > 1 else self.search(child, 1, nodes, best)
            return
        if items.children:
            for child in items.children:
                self.search(child, level, nodes, best)
            return
        rows = self.below(1, nodes) if level else nodes
        self.opened += len(rows) * len(items.items)
        scores = (self.levels[0][np.ix_(rows, items.columns)] @ items.matrix).astype(np.int64)
        for k, item in enumerate(items.items.tolist()):
            best.offer(item, scores[:, k], self.ids[rows])

    def root(self, items: Node, best: Best) -> None:
        self.search(items, len(self.levels) - 1, np.zeros(1, np.int64), best)


def doc_parts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The document's part of a term's score: saturated occurrences, less in longer documents."""
    m = BASE - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (SCALE * counts) // (1000 * counts + SATURATION * m)


def term_weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def search_vectors(
    doc_id: np.ndarray, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray,
    n_docs: int, n_terms: int, items: Node, best: Best,
) -> int:
    """Search documents given as lists of terms one after the other; the number of scores that were worked out."""
    parts = doc_parts(counts, np.repeat(n, sizes), n_docs, n_terms)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    gain = weights[terms] * parts
    # documents with the same heaviest term become neighbours
    order = np.lexsort((-gain, owner))
    first = np.flatnonzero(np.diff(owner[order], prepend=-1))
    lead = np.full(len(sizes), -1, np.int64)
    lead[owner[order[first]]] = terms[order[first]]
    docs = np.lexsort((doc_id, lead))
    docs = docs[lead[docs] >= 0]
    place = np.full(len(sizes), -1, np.int64)
    place[docs] = np.arange(len(docs))
    entry = np.argsort(place[owner], kind="stable")
    bounds = np.searchsorted(place[owner][entry], np.arange(len(docs) + 1))
    width = int(max(LEAF_DOCS, min(2048, CELLS // max(1, len(weights)))))
    opened = 0
    for at in range(0, len(docs), width):
        own = docs[at : at + width]
        cells = entry[bounds[at] : bounds[at + len(own)]]
        rows = np.zeros((len(own), len(weights)))
        rows[place[owner[cells]] - at, terms[cells]] = parts[cells]
        tree = DocTree(rows, doc_id[own])
        tree.root(items, best)
        opened += tree.opened
    return opened


def doc_vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Documents with a term: id, number of terms, and the counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for own, raw in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts = terms_of(raw)
                    if counts:
                        hits = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                        rows.append((own, counts.total(), [t for t, _ in hits], [c for _, c in hits]))
                if rows:
                    yield batch_of(list(zip(*rows, strict=True)), arrow)

    out = docs.sparkSession.createDataFrame([], VECTOR).schema
    arrow = to_arrow_schema(out)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.where("text is not null").mapInArrow(run, out)


def _search(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, tree: Node, n_items: int, k: int) -> DataFrame:
    """The k best documents of each item within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(n_items, k), [], 0

        def work() -> None:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                search_vectors(*columns, weights, n_docs, n_terms, tree, best)
                held.clear()

        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((
                batch.column(0).to_numpy(), batch.column(1).to_numpy(), terms.flatten().to_numpy().astype(np.int64),
                counts.flatten().to_numpy().astype(np.int64), sizes.astype(np.int64),
            ))
            size += int(sizes.sum())
            if size > HELD:
                work()
                size = 0
        work()
        for item in range(n_items):
            if n := len(best.ids[item]):
                yield batch_of([np.full(n, item), best.ids[item], best.scores[item]], arrow)

    out = vectors.sparkSession.createDataFrame([], FOUND).schema
    arrow = to_arrow_schema(out)
    return vectors.where("doc_id is not null").mapInArrow(run, out)


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[list[tuple]]:
    """Rows ``number, id, text`` of the items, fetched in blocks of about ``block_terms`` words (by bytes, two a word)."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_terms)))
    spread = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r["id"], r["text"]) for r in spread.where(F.col("block") == b).collect()]


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = 500_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items``."""
    spark, id_type = docs.sparkSession, items.schema[item_id].dataType
    out = None
    for block in _blocks(items, item_id, item_text, block_terms):
        counted = [terms_of(raw) for _, raw in block]
        vocabulary = {t: i for i, t in enumerate(sorted({t for own in counted for t in own}))}
        if not vocabulary:
            continue
        vectors = staged(doc_vectors(docs, vocabulary, doc_id, text), "search-vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in holding:
            weights[row["term"]] = term_weight(n_docs, row["count"])
        tree = item_tree([Counter({vocabulary[t]: c for t, c in own.items()}) for own in counted], weights)
        if tree is None:
            continue
        found = _search(vectors, weights, n_docs, n_terms, tree, len(block), k)
        found = _best(found.withColumn("salt", F.spark_partition_id() % 64), ["item", "salt"], k).drop("rank", "salt")
        found = _best(found, ["item"], k)
        names = spark.createDataFrame(
            [(i, own) for i, (own, _) in enumerate(block)], f"item int, item_id {id_type.simpleString()}"
        )
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, w, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
t AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM t, c GROUP BY term, nd),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN v USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
