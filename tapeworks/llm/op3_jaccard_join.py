"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Documents become sets of hashes of word shingles. In one global order of shingles, rare ones first, two sets that link
share one of the first ``n - ceil(t n) + 1``. Sets are collapsed twice: equal sets are one class, and classes with equal
prefixes and sizes are one group that sends its prefix once.

1. A sketch of fixed size counts, over all documents, how many documents have a shingle of each bucket; it only
   orders shingles, any order gives the same links.
2. Groups that share a shingle are sorted under it, the one with the fewest rarer shingles first. The first, the leader, is
   paired with the others: as many pairs as rows, never all pairs. A stream over sorted rows does it in constant
   memory, and shingles that the sketch calls frequent are dealt out to several tasks with a leader each.
3. Pairs pass the length and positional bounds, are expanded to the groups' classes, and verified with whole sets.
   Links give components.
4. What a leader did not settle is made complete: under every shingle that still has groups of several
   components, all pairs of groups of different components that pass the bounds are expanded and verified too.
   Pairs inside one component are not checked: a link there changes no component. So the links themselves, and their
   number per document, are not results of this operator; it returns components only.

Defined results: null texts and texts without words have no shingles and no links; rows without an id are never
linked and have no component; rows that share an id are one document; extra columns are ignored by
``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.links import components
from tapeworks.llm.shared import fresh, table
from tapeworks.llm.words import Words, find_words, signed, slices
from tapeworks.session import staged, temporary_scratch

SKETCH_BITS, SKETCH_PARTS = 21, 128
#: Rows under one shingle that one task may well stream.
SALT_ROWS = 50_000


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all of them."""
    hashes = words.hashes()
    at, runs = words.windows(hashes, width)
    whole, counts = words.whole(hashes), words.counts
    bounds = np.searchsorted(words.text[at], np.arange(len(counts) + 1))
    none = np.zeros(0, np.uint64)
    return [
        np.unique(runs[bounds[i] : bounds[i + 1]]) if n >= width else whole[i : i + 1] if n else none
        for i, n in enumerate(counts)
    ]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Number of documents for each bucket of shingles, over all ``text`` of ``rows``."""
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype("<u4").tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                for one in shingle_sets(find_words(part.column("text"), lower=True), width):
                    np.add.at(total, _bucket(one), 1)
        if total.any():
            parts = [packed(total[i * size : (i + 1) * size]) for i in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts)], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(data), "<u4")
                sums[part] = sums[part] + counts if part in sums else counts.astype(np.uint64)
        if sums:
            parts = [packed(np.minimum(s, 0xFFFFFFFF)) for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts)], schema=schema)

    out = "part int, counts binary"
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    found = rows.select("text").mapInArrow(count, out).repartition("part").mapInArrow(add, out)
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in found.collect():
        total[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    return total


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def document_sets(rows: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """``id, n, class, grp, tokens, salts``: keys of equal sets and of equal prefixes, and the ordered prefix."""
    known = rows.sparkSession.sparkContext.broadcast(sketch)
    usual = 2 * int(sketch.mean()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, classes, groups, tokens, salts = [], [], [], [], []
                for one in shingle_sets(find_words(part.column("text"), lower=True), width):
                    seen = counts[_bucket(one)].astype(np.int64)
                    first = np.lexsort((one, seen))[: prefix_length(len(one), percent) if len(one) else 0]
                    prefix = one[first]
                    sizes.append(len(one))
                    classes.append(hashlib.md5(one.tobytes()).digest())
                    groups.append(hashlib.md5(prefix.tobytes() + len(one).to_bytes(8, "little")).digest())
                    tokens.append(signed(prefix))
                    salts.append((1 + np.maximum(seen[first] - usual, 0) // SALT_ROWS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(sizes, pa.int32()), pa.array(classes), pa.array(groups),
                    pa.array(tokens, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32())),
                ], schema=schema)

    out = rows.sparkSession.createDataFrame(
        [], "id long, n int, class binary, grp binary, tokens array<long>, salts array<int>"
    ).schema
    schema = to_arrow_schema(out)
    return rows.select("id", "text").mapInArrow(run, out)


def _led(tokens: DataFrame) -> DataFrame:
    """Rows of shingles that several groups share, each with the leader of its shingle (and salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            table_ = {name: batch.column(name).to_numpy() for name in ("token", "salt", "pos", "node", "n", "salts")}
            if last is not None:
                table_ = {k: np.concatenate([last[0][k], v]) for k, v in table_.items()}
            n = len(table_["token"])
            new = np.ones(n, bool)
            new[1:] = (table_["token"][1:] != table_["token"][:-1]) | (table_["salt"][1:] != table_["salt"][:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            leads = {k: table_[k][start] for k in ("pos", "node", "n")}
            if last is not None:
                # the run of the carried row began earlier
                run_end = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
                for k in leads:
                    leads[k][:run_end] = last[1][k]
            shared = ~new
            shared[:-1] |= ~new[1:]
            shared |= table_["salts"] > 1
            keep = shared.copy()
            if last is not None and last[2]:
                keep[0] = False
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([
                pa.array(table_["token"][at]), pa.array(table_["pos"][at]), pa.array(table_["node"][at]),
                pa.array(table_["n"][at]), pa.array(leads["pos"][at]), pa.array(leads["node"][at]),
                pa.array(leads["n"][at]),
            ], schema=schema)
            last = {k: v[-1:] for k, v in table_.items()}, {k: v[-1] for k, v in leads.items()}, bool(shared[-1])

    out = tokens.sparkSession.createDataFrame(
        [], "token long, pos int, node long, n int, lead_pos int, lead long, lead_n int"
    ).schema
    schema = to_arrow_schema(out)
    rows = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "node")
    return rows.mapInArrow(run, out)


def _may_link(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Length bound, and the positional bound at a shingle that both have at these places."""
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    most = 1 + F.least(n - pos - 1, other_n - other_pos - 1)
    return sizes & ((100 + percent) * most >= percent * (n + other_n))


def packed_set(hashes: np.ndarray) -> bytes:
    """A sorted set of 64-bit numbers, whole: the first bytes as a bitmap of steps, the other seven as they are."""
    n = len(hashes)
    steps = np.zeros(n + 256, bool)
    steps[(hashes >> np.uint64(56)).astype(np.int64) + np.arange(n)] = True
    low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return n.to_bytes(4, "little") + np.packbits(steps).tobytes() + low.tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(data, np.uint8)
    split = 4 + (n + 256 + 7) // 8
    top = np.flatnonzero(np.unpackbits(raw[4:split], count=n + 256)) - np.arange(n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7], wide[:, 7] = raw[split:].reshape(-1, 7), top
    return wide.view("<u8").ravel()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link. Each side's set travels once for each pair it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(at, 500) for part in batches for at in range(0, part.num_rows, 500)):
            a, b = [], []
            for node, other, one, two in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = unpacked_set(one), unpacked_set(two)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(node)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("one"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("two"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return rows.mapInArrow(run, "a long, b long")


def _sets_of(rows: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """``id, hashes``: whole shingle sets of the needed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(find_words(part.column("text"), lower=True), width)
                data = pa.array([packed_set(one) for one in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), data], names=["id", "hashes"])

    # shuffled at any size, so that the plan and its cost don't turn over as the needed ids grow
    return rows.join(needed.hint("merge"), "id").select("id", "text").mapInArrow(run, "id long, hashes binary")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``, as a stored table; all others are deleted.

    Components only: links inside a component are not all computed.
    """
    with temporary_scratch():
        return staged(_components_of(docs, doc_id, text, width, percent), "near-duplicates", keep=True)


def _components_of(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = staged(document_sets(rows, shingle_sketch(rows, width), width, percent), "sets")
    real = sets.where("id is not null and n > 0")
    classes = staged(
        real.groupBy("class").agg(F.min("id").alias("node"), F.first("grp").alias("grp"), F.first("n").alias("n")),
        "set-classes",
    )
    # equal prefixes and sizes: one group, which sends the prefix of its smallest id
    groups = real.groupBy("grp").agg(
        F.min("id").alias("node"), F.first("n").alias("n"),
        F.min_by(F.struct("tokens", "salts"), "id").alias("prefix"),
    )
    tokens = groups.select(
        "node", "n", F.posexplode(F.arrays_zip(F.col("prefix.tokens").alias("t"), F.col("prefix.salts").alias("s")))
    ).select(
        "node", "n", "pos", F.col("col.t").alias("token"), F.col("col.s").alias("salts"),
        F.when(F.col("col.s") > 1, F.pmod(F.xxhash64("node"), F.col("col.s")).cast("int")).otherwise(0).alias("salt"),
    )
    shared = staged(_led(tokens), "shared-shingles")
    # classes beside the first of their group
    heads = classes.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    members = staged(classes.join(heads.where("members > 1"), "grp").select("head", "node", "n"), "set-members")
    led = shared.where("node != lead").where(
        _may_link(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), percent)
    )
    pairs = led.select(F.col("node").alias("a"), F.col("lead").alias("b")).unionByName(
        members.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    )
    pairs = staged(pairs.distinct(), "set-pairs")
    # only sets of pairs that the bounds leave open are built
    whole = staged(_sets_of(rows, _ids_in(pairs), width), "whole-sets")
    links = staged(_verified(pairs, whole, percent), "set-links")
    roots = staged(components(links), "set-roots")
    more = staged(_unsettled(shared, members, roots, pairs, percent), "set-pairs")
    if not more.isEmpty():
        new = _ids_in(more).join(_ids_in(pairs), "id", "left_anti")
        added = staged(_sets_of(rows, new, width), "whole-sets")
        found = _verified(more, whole.unionByName(added), percent)
        roots = staged(components(links.unionByName(found)), "set-roots")
    placed = classes.select("class", "node").join(roots, "node", "left").select(
        "class", F.coalesce("root", "node").alias("root")
    )
    placed = staged(placed, "set-components")
    return sets.select("id", "n", "class").join(placed, "class", "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))


def _ids_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _unsettled(shared: DataFrame, members: DataFrame, roots: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a shingle and pass the bounds, without the known ones."""

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return rows.join(named, node, "left").withColumn(root, F.coalesce(root, node))

    placed = rooted(members, "node", "root")
    spread = placed.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rows = rooted(shared.select("token", "pos", "node", "n"), "node", "root")
    rows = rows.join(spread.withColumnRenamed("head", "node"), "node", "left").select(
        "token", "pos", "node", "n", F.coalesce("low", "root").alias("low"), F.coalesce("high", "root").alias("high")
    )
    rows = staged(rows, "rooted-shingles")
    split = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    rows = staged(rows.join(split.where("least != most").select("token"), "token"), "open-shingles")
    other = rows.select("token", *[F.col(c).alias(f"{c}_2") for c in ("pos", "node", "n", "low", "high")])
    apart = ~((F.col("low") == F.col("high")) & (F.col("low_2") == F.col("high_2")) & (F.col("low") == F.col("low_2")))
    near = _may_link(F.col("n"), F.col("pos"), F.col("n_2"), F.col("pos_2"), percent)
    groups = rows.join(other, "token").where((F.col("node") < F.col("node_2")) & apart & near)
    groups = groups.select(F.col("node").alias("g"), F.col("node_2").alias("h")).distinct()
    inside = spread.where("low != high").select(F.col("head").alias("g"), F.col("head").alias("h"))
    groups = groups.unionByName(inside)
    # expand both groups to their classes; most have one, which is the group itself
    one = placed.select(F.col("head").alias("g"), F.col("node").alias("a"))
    two = placed.select(F.col("head").alias("h"), F.col("node").alias("b"))
    pairs = groups.join(one, "g", "left").join(two, "h", "left").select(
        F.coalesce("a", "g").alias("a"), F.coalesce("b", "h").alias("b")
    ).where("a != b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = rooted(rooted(pairs, "a", "root_a"), "b", "root_b").where("root_a != root_b").select("a", "b")
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The document with the smallest id of each component, with its own columns; rows without an id all stay."""
    found = near_duplicates(docs, doc_id, text, width, percent)
    named, several = fresh(docs, "_doc_key"), fresh(docs, "_rows")
    keep = found.where("id = component_id").groupBy("id").agg(F.count("*").alias("rows"))
    keep = staged(keep.select(F.col("id").alias(named), (F.col("rows") > 1).alias(several)), "kept-ids")
    kept = docs.join(keep, docs[doc_id].cast("long") == keep[named])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = kept.where(~F.col(several)).select(columns).unionByName(docs.where(F.col(doc_id).isNull()))
    if keep.where(F.col(several)).isEmpty():
        return parts
    return parts.unionByName(kept.where(F.col(several)).dropDuplicates([named]).select(columns))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ')) AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
c AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) m ON m.node = d.doc_id
"""
