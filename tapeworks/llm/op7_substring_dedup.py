"""Substring dedup: suffix automata of reference shards, matching statistics of all other documents against them.

A window is ``width`` consecutive words of one document. Words go that are covered by a window which also starts in a
document with a smaller id. Here every document is a reference for the later ones, so the set of all automata
has no bound and can't be broadcast whole; each automaton is sent where its documents are instead:

1. One pass finds each text's digest and, for every window, its least hash of an 8-word run. Equal windows have
   equal least hashes, and neighbouring windows mostly share theirs, so a text has one row per
   twenty words. Of texts with equal words only the smallest id goes on: the others lose every window.
2. Runs whose hash occurs in several ids are candidates; the smallest such id is the reference of that hash.
3. A reference shard is the candidate part of one reference document, at most ``shard_words`` long. Its suffix
   automaton is built in the tasks that stream the other documents' candidate segments through it (a
   reference with many of them is copied to several tasks). A window is found where the
   matching statistic reaches ``width``: word hashes are compared one by one, not window hashes.
4. Windows left over (their place differs from the reference, but perhaps equals a third document) and reference windows
   beyond a shard's length are compared exactly by 128-bit hashes in one aggregate and one join. No window
   is lost: equal windows have one reference, so either all of them were found there or all come here.

Defined results: null texts have no words; rows without an id are never touched and remove nothing; rows that share id
and words share their result; rows that share an id only are not compared with each other. Extra columns are kept
by ``remove_repeats``, which cuts the spans out of the text and leaves all other characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.shared import fresh, table
from tapeworks.llm.words import Words, batch_of, find_words, mix, signed, slices
from tapeworks.session import staged, temporary_scratch

GRAM = 8
INFO = "id long, n_words long, digest binary, seq long, anchors array<long>, firsts array<int>, lasts array<int>"
SEGMENT = "ref long, salt int, stream boolean, id long, seq long, start int, words binary"
FOUND = "id long, seq long, first int, last int, h1 long, h2 long"


class SuffixAutomaton:
    """All substrings of some sequences of ints."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last, self.sequences = [-1], [0], 0, 0

    def add(self, words: list[int]) -> None:
        nexts, links, lengths = self.next, self.link, self.length
        # words are hashes of 64 bits; a larger number keeps sequences apart
        self.sequences += 1
        for word in [*words, (1 << 64) + self.sequences]:
            state, at = len(nexts), self.last
            nexts.append({})
            lengths.append(lengths[at] + 1)
            links.append(0)
            while at >= 0 and word not in nexts[at]:
                nexts[at][word] = state
                at = links[at]
            if at >= 0:
                target = nexts[at][word]
                if lengths[target] == lengths[at] + 1:
                    links[state] = target
                else:
                    copy = len(nexts)
                    nexts.append(nexts[target].copy())
                    lengths.append(lengths[at] + 1)
                    links.append(links[target])
                    while at >= 0 and nexts[at].get(word) == target:
                        nexts[at][word] = copy
                        at = links[at]
                    links[target] = links[state] = copy
            self.last = state

    def long_matches(self, words: list[int], width: int) -> np.ndarray:
        """Whether the ``width`` words from each place are a substring; one flag for each window."""
        nexts, links, lengths = self.next, self.link, self.length
        found = np.zeros(max(0, len(words) - width + 1), bool)
        state = matched = 0
        for i, word in enumerate(words):
            to = nexts[state].get(word)
            while to is None and state:
                state = links[state]
                matched = lengths[state]
                to = nexts[state].get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= width:
                found[i - width + 1] = True
        return found


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchor_runs(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Text, least hash, first and last window start of all runs of windows with one least hash."""
    empty = np.zeros(0, np.int64)
    n = len(hashes)
    if n < width:
        return empty, empty.astype(np.uint64), empty, empty
    grams = np.full(n - GRAM + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    at, run = words.windows(hashes, GRAM)
    grams[at] = run
    least = sliding_min(grams, width - GRAM + 1)[: n - width + 1]
    whole = np.flatnonzero(words.text[: n - width + 1] == words.text[width - 1 :])
    least, text = least[whole], words.text[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    start = words.first[text[first]]
    return text[first], least[first], whole[first] - start, whole[last] - start


def _digests(column: pa.Array) -> list[bytes]:
    """SHA-256 of each text's words, joined by one space."""
    views = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    return [hashlib.sha256(b" ".join((raw or b"").split())).digest() for raw in views.to_pylist()]


def _seqs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def text_infos(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """One row for each document: number of words, digest, and the runs of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = find_words(part.column("text"))
                of, least, first, last = anchor_runs(words, words.hashes(), width)
                counts = np.bincount(of, minlength=part.num_rows)
                digests = _digests(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(words.counts), pa.array(digests, pa.binary()), pa.array(_seqs(digests)),
                    _lists(signed(least), counts, pa.int64()), _lists(first, counts, pa.int32()),
                    _lists(last, counts, pa.int32()),
                ], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.sparkSession.createDataFrame([], INFO).schema
    schema = to_arrow_schema(out)
    return rows.mapInArrow(run, out)


def _segments(rows: DataFrame, width: int, shard_words: int) -> DataFrame:
    """Candidate segments of joined texts; ``runs`` are structs of ref, salts, first and last window start."""

    def merged(runs: list[dict]) -> Iterator[tuple[int, int, int, int]]:
        open_run = None
        for r in sorted(runs, key=lambda r: (r["ref"], r["first"])):
            if open_run and open_run[0] == r["ref"] and r["first"] <= open_run[3] + 1:
                open_run[3] = max(open_run[3], r["last"])
                continue
            if open_run:
                yield tuple(open_run)
            open_run = [r["ref"], r["salts"], r["first"], r["last"]]
        if open_run:
            yield tuple(open_run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = find_words(part.column("text"))
                hashes = signed(words.hashes())
                seqs = _seqs(_digests(part.column("text")))
                ids, known = part.column("id").to_pylist(), part.column("seq").to_pylist()
                out = []
                for i, runs in enumerate(part.column("runs").to_pylist()):
                    if known[i] != seqs[i]:
                        continue
                    own, base = ids[i], words.first[i]
                    for ref, salts, first, last in merged(runs):
                        # long segments go in parts that share width - 1 words
                        for start in range(first, last + 1, shard_words):
                            stop = min(last + 1, start + shard_words)
                            data = hashes[base + start : base + stop + width - 1].tobytes()
                            for salt in range(salts) if ref == own else (own % salts,):
                                out.append((ref, salt, ref != own, own, known[i], start, data))
                        if len(out) >= 2000:
                            yield batch_of(list(zip(*out, strict=True)), schema)
                            out = []
                if out:
                    yield batch_of(list(zip(*out, strict=True)), schema)

    out_schema = rows.sparkSession.createDataFrame([], SEGMENT).schema
    schema = to_arrow_schema(out_schema)
    return rows.mapInArrow(run, out_schema)


def _window_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole = Words(None, None, None, None, np.zeros(len(words), np.int32), np.array([0, len(words)]))
    values = words.view(np.uint64)
    _, one = whole.windows(values, width)
    _, two = whole.windows(mix(values ^ np.uint64(0x5851F42D4C957F2D)), width)
    return signed(one), signed(two)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _matched(segments: DataFrame, width: int, shard_words: int) -> DataFrame:
    """Stream segments through the automaton of their reference, which comes first in each sorted group.

    Rows out: runs of windows that were found (hashes null), and single windows that were not.
    """

    def emit(ids, seqs, firsts, lasts, ones, twos):
        return batch_of([ids, seqs, firsts, lasts, ones, twos], schema)

    def left_over(own, seq, start, words, missing):
        one, two = _window_hashes(words, width)
        n = len(missing)
        places = missing + start
        return emit(np.full(n, own), np.full(n, seq), places, places, one[missing], two[missing])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, held = None, None, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for ref, salt, stream, own, seq, start, data in zip(*columns, strict=True):
                if (ref, salt) != group:
                    group, automaton, held = (ref, salt), SuffixAutomaton(), 0
                words = np.frombuffer(data, np.int64)
                if not stream:
                    if held and held + len(words) > shard_words:
                        if salt == 0:
                            yield left_over(own, seq, start, words, np.arange(len(words) - width + 1))
                        continue
                    held += len(words)
                    automaton.add(words.tolist())
                    continue
                found = automaton.long_matches(words.tolist(), width)
                first, last = _spans(found)
                if len(first):
                    n, none = len(first), pa.nulls(len(first), pa.int64())
                    yield emit(
                        np.full(n, own), np.full(n, seq), first + start, last + start, none, none
                    )
                missing = np.flatnonzero(~found)
                if len(missing):
                    yield left_over(own, seq, start, words, missing)

    out_schema = segments.sparkSession.createDataFrame([], FOUND).schema
    schema = to_arrow_schema(out_schema)
    ordered = segments.repartition("ref", "salt").sortWithinPartitions("ref", "salt", "stream", "id", "start")
    return ordered.mapInArrow(run, out_schema)


def repeated_windows(
    docs: DataFrame, infos: DataFrame, doc_id: str, text: str, width: int, shard_words: int, salt_rows: int
) -> DataFrame:
    """``id, seq, copy, firsts, lasts``: runs of windows to remove, for all documents that lose some."""
    with_windows = infos.where(F.col("id").isNotNull() & (F.col("n_words") >= width))
    smallest = staged(with_windows.groupBy("digest").agg(F.min("id").alias("smallest"), F.count("*").alias("n"))
                      .where("n > 1").drop("n"), "repeat-copies")
    known = with_windows.join(smallest, "digest", "left")
    copies = known.where("id > smallest").select(
        "id", "seq", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("firsts"),
        F.array().cast("array<int>").alias("lasts"),
    ).distinct()
    runs = known.where("smallest is null or id = smallest").select(
        "id", "seq", F.inline(F.arrays_zip(
            F.col("anchors").alias("anchor"), F.col("firsts").alias("first"), F.col("lasts").alias("last")
        )),
    ).toDF("id", "seq", "anchor", "first", "last")
    anchors = staged(runs.groupBy("anchor").agg(
        F.min("id").alias("ref"), F.max("id").alias("_most"), F.count("*").alias("n")
    ).where("ref < _most").drop("_most"), "repeat-anchors")
    # as many copies of a reference as its most frequent run asks for
    salts = anchors.groupBy("ref").agg((F.floor(F.max("n") / salt_rows) + 1).cast("int").alias("salts"))
    salts = staged(salts.where("salts > 1"), "repeat-salts")
    anchors = anchors.drop("n").join(salts, "ref", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    candidates = runs.join(anchors, "anchor").groupBy("id", "seq").agg(
        F.collect_list(F.struct("ref", "salts", "first", "last")).alias("runs")
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # shuffled at any size, here and below, so that the plan doesn't turn over as the input grows
    segments = _segments(texts.join(candidates.hint("merge"), "id"), width, shard_words)
    found = staged(_matched(segments, width, shard_words), "repeat-windows")
    rest = found.where("h1 is not null")
    again = staged(rest.groupBy("h1", "h2").agg(F.min("id").alias("ref"), F.max("id").alias("_most"))
                   .where("ref < _most").drop("_most"), "repeat-rest")
    late = rest.join(again, ["h1", "h2"]).where("id > ref").select("id", "seq", "first", "last")
    spans = found.where("h1 is null").select("id", "seq", "first", "last").unionByName(late)
    spans = spans.groupBy("id", "seq").agg(
        F.lit(False).alias("copy"), F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )
    return spans.unionByName(copies)


def _covered(n_words: int, copy: bool, firsts, lasts, width: int) -> np.ndarray:
    """Flags of the words to remove."""
    if copy:
        return np.ones(n_words, bool)
    edges = np.zeros(n_words + 1, np.int32)
    np.add.at(edges, np.asarray(firsts, np.int64), 1)
    np.add.at(edges, np.asarray(lasts, np.int64) + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _by_id(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("id").agg(
        F.collect_list(F.struct("seq", "copy", "firsts", "lasts")).alias("repeats")
    )


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """``raw`` without the spans of removed words; what stands between two removed words goes too."""
    first, last = _spans(gone)
    pieces, at = [], 0
    for a, b in zip(first, last, strict=True):
        pieces.append(raw[at : start[a]])
        at = end[b]
    return b"".join([*pieces, raw[at:]])


def removal_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, shard_words: int = 100_000,
    salt_rows: int = 200,
) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` for every row of ``docs``."""
    with temporary_scratch():
        infos = staged(text_infos(docs, doc_id, text, width), "repeat-infos")
        repeats = repeated_windows(docs, infos, doc_id, text, width, shard_words, salt_rows)
        repeats = staged(repeats, "repeats", keep=True)
        infos = staged(infos.drop("anchors", "firsts", "lasts"), "repeat-digests", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, out = find_words(part.column("text")), []
                seqs = _seqs(_digests(part.column("text")))
                raws, ids = part.column("text").to_pylist(), part.column("id").to_pylist()
                for i, repeats in enumerate(part.column("repeats").to_pylist()):
                    for r in repeats:
                        if r["seq"] != seqs[i]:
                            continue
                        gone = _covered(int(words.counts[i]), False, r["firsts"], r["lasts"], width)
                        kept = [w for w, g in zip((raws[i] or "").encode().split(), gone, strict=True) if not g]
                        out.append((ids[i], int(seqs[i]), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
                if out:
                    yield batch_of(list(zip(*out, strict=True)), schema)

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    out_schema = docs.sparkSession.createDataFrame([], "id long, seq long, n_cut long, kept string").schema
    schema = to_arrow_schema(out_schema)
    partly = texts.join(_by_id(repeats.where("not copy")).hint("merge"), "id").mapInArrow(run, out_schema).distinct()
    copies = repeats.where("copy").select("id", "seq", F.lit(True).alias("copy"))
    rows = infos.join(partly, ["id", "seq"], "left").join(
        copies, ["id", "seq"], "left"
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, shard_words: int = 100_000,
    salt_rows: int = 200,
) -> DataFrame:
    """``docs`` with the spans of repeated windows cut out of the text; all rows and columns are kept."""
    with temporary_scratch():
        infos = staged(text_infos(docs, doc_id, text, width), "repeat-infos")
        repeats = repeated_windows(docs, infos, doc_id, text, width, shard_words, salt_rows)
        repeats = staged(_by_id(repeats), "repeats", keep=True)
    named, found = fresh(docs, "_doc_key"), fresh(docs, "_repeats")
    repeats = repeats.select(F.col("id").alias(named), F.col("repeats").alias(found))
    joined = docs.join(repeats.hint("merge"), docs[doc_id].cast("long") == repeats[named], "left").drop(named)
    place, width_of = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(place)
                changed = texts.to_pylist()
                touched = [i for i, r in enumerate(part.column(width_of).to_pylist()) if r]
                if touched:
                    own = texts.take(pa.array(touched))
                    words, seqs = find_words(own), _seqs(_digests(own))
                    lists = part.column(width_of).take(pa.array(touched)).to_pylist()
                    for k, i in enumerate(touched):
                        for r in lists[k]:
                            if r["seq"] != seqs[k]:
                                continue
                            raw = (changed[i] or "").encode()
                            a, b = words.first[k], words.first[k + 1]
                            gone = _covered(int(b - a), r["copy"], r["firsts"], r["lasts"], width)
                            base = words.bounds[k]
                            changed[i] = _cut(raw, words.start[a:b] - base, words.end[a:b] - base, gone).decode()
                            break
                columns = [part.column(i) for i in range(width_of)]
                columns[place] = pa.array(changed, schema.field(place).type)
                yield batch_of(columns, schema)

    schema = to_arrow_schema(docs.schema)
    return joined.mapInArrow(run, docs.schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removal_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
s AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE doc_id > least),
g AS (SELECT r, list(p) AS gone FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN (
  SELECT u.r, string_agg(u.x, ' ' ORDER BY u.p) AS kept
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u LEFT JOIN s ON s.r = u.r AND s.p = u.p
  WHERE s.p IS NULL GROUP BY u.r) k USING (r)
"""
