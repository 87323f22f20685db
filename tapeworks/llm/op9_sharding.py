"""Sharding by histogram sort: exact byte counts below candidate keys, refined until the splitters are good enough.

Rows are ordered by a key of two longs (for texts: a hash of the text, then the id), so equal texts are neighbours. A
group of equal texts lies in one shard; only one that is larger than a shard is cut, between ids. Each round counts rows
and bytes of all ranges between the current probes in one aggregate over narrow staged keys; only ranges that may hide a
heavy group, hold a splitter, or have too many rows for one sort get new probes. Groups over a ``heavy`` part of a
shard (at most ``shards / heavy`` of them) are dealt first, the heaviest to the emptiest shard; splitters then cut
the rest in key order into what each shard has left. The driver sees range counts only, at most
``most_counts`` in a round. Afterwards rows are exchanged once, by range, and numbered there.

Defined results: null texts weigh as empty ones; a null id sorts before all others; rows with equal ids and
texts stay together and share their order arbitrarily (they are alike); extra columns are left alone; an empty
table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import table
from tapeworks.session import staged

#: The first probes cut the high half of the key by its top bits.
TOP_BITS = 12
LEAST_LONG = -(1 << 63)


@dataclass(frozen=True)
class Range:
    """Rows whose keys lie between two keys that occur."""

    first: tuple[int, int]
    last: tuple[int, int]
    rows: int
    weight: int

    @property
    def group(self) -> int | None:
        """The high half of the key, if all rows share it."""
        return self.first[0] if self.first[0] == self.last[0] else None


def _counted(rows: DataFrame, by: list[Column]) -> list[tuple[int | None, Range]]:
    key = F.struct("high", "low")
    found = rows.groupBy(*by).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"), F.sum("weight").alias("w")
    ).collect()
    ranges = [(r["of"], Range(tuple(r["first"]), tuple(r["last"]), r["n"], r["w"])) for r in found]
    return sorted(ranges, key=lambda pair: pair[1].first)


def _probed(keys: DataFrame, ranges: list[Range], bins: int) -> dict[int, list[Range]]:
    """Cut each range evenly into ``bins`` between its own first and last key, and count the parts."""
    rows = []
    for i, r in enumerate(ranges):
        on_low = r.first[0] == r.last[0]
        start, end = (r.first[1], r.last[1]) if on_low else (r.first[0], r.last[0])
        rows.append((i, r.first[0] >> (64 - TOP_BITS), *r.first, *r.last, on_low, (end - start) / bins))
    probes = keys.sparkSession.createDataFrame(
        rows, "of int, top long, h0 long, l0 long, h1 long, l1 long, on_low boolean, width double"
    )
    key = F.struct("high", "low")
    inside = (key >= F.struct("h0", "l0")) & (key <= F.struct("h1", "l1"))
    # exact for the high half, whose ranges lie below one top; ids that are equal as doubles only meet in one part
    place = F.when(F.col("on_low"), F.col("low").cast("double") - F.col("l0").cast("double")).otherwise(
        (F.col("high") - F.col("h0")).cast("double")
    )
    parts = keys.withColumn("top", F.shiftright("high", 64 - TOP_BITS)).join(F.broadcast(probes), "top").where(inside)
    part = F.least(F.lit(bins - 1), F.floor(place / F.col("width")).cast("int")).alias("part")
    counted: dict[int, list[Range]] = {}
    for i, r in _counted(parts, [F.col("of"), part]):
        counted.setdefault(i, []).append(r)
    return counted


def _units(ranges: list[Range]) -> list[list[int]]:
    """Numbers of ranges that go to a shard together, in key order: the parts of one group, or one range."""
    return [
        list(numbers) for _, numbers in
        groupby(range(len(ranges)), lambda i: (ranges[i].group, i if ranges[i].group is None else -1))
    ]


def _level(loads: list[int], rest: int) -> float:
    """Up to where ``rest`` fills shards that hold ``loads`` already."""
    filled, low = 0, sorted(loads)
    for k, load in enumerate(low):
        filled += load
        if k + 1 == len(low) or (filled + rest) <= low[k + 1] * (k + 1):
            return (filled + rest) / (k + 1)
    return 0.0


@dataclass(frozen=True)
class Deal:
    """Shards of the ranges, and which ranges of those in key order hold a splitter."""

    shard: list[int]
    split: set[int]


def _dealt(ranges: list[Range], shards: int, heavy: float) -> Deal:
    total = sum(r.weight for r in ranges)
    placed, whole, flow = [0] * len(ranges), [], []
    for unit in _units(ranges):
        weight = sum(ranges[i].weight for i in unit)
        if ranges[unit[0]].group is None or weight * shards <= heavy * total:
            flow.append((unit, weight))
        elif weight * shards <= total:
            whole.append((weight, unit))
        else:  # larger than a shard: cut between ids
            flow += [([i], ranges[i].weight) for i in unit]
    loads, emptiest = [0] * shards, [(0, s) for s in range(shards)]
    for weight, unit in sorted(whole, key=lambda pair: (-pair[0], pair[1])):
        load, s = heapq.heappop(emptiest)
        loads[s] = load + weight
        heapq.heappush(emptiest, (loads[s], s))
        for i in unit:
            placed[i] = s
    level = _level(loads, sum(weight for _, weight in flow))
    ends = list(accumulate(max(0.0, level - load) for load in loads))
    last = max((s for s in range(shards) if loads[s] < level), default=0)
    below, split = 0, set()
    for unit, weight in flow:
        s = min(last, bisect_right(ends, below + weight / 2))
        for i in unit:
            placed[i] = s
        if bisect_right(ends, below) != bisect_right(ends, below + weight - 1):
            split.update(unit)
        below += weight
    return Deal(placed, split)


def _joined(ranges: list[Range], shards: list[int], most_rows: int) -> list[tuple[Range, int]]:
    """Neighbours below one top that go to one shard, as one range while it has at most ``most_rows`` rows."""
    out: list[tuple[Range, int]] = []
    for r, shard in zip(ranges, shards, strict=True):
        if out:
            before, its = out[-1]
            near = before.first[0] >> (64 - TOP_BITS) == r.first[0] >> (64 - TOP_BITS)
            if near and its == shard and before.rows + r.rows <= most_rows:
                out[-1] = Range(before.first, r.last, before.rows + r.rows, before.weight + r.weight), shard
                continue
        out.append((r, shard))
    return out


def histogram_ranges(
    keys: DataFrame, shards: int, tolerance: float = 0.001, heavy: float = 0.01, bins: int = 256,
    most_rows: int = 2_000_000, most_counts: int = 500_000,
) -> list[tuple[Range, int]]:
    """Ranges in key order with their shards, from a table of longs ``high``, ``low`` and ``weight``.

    A range that holds a splitter weighs at most ``tolerance`` of a shard, has one key, or is a group of at most
    ``heavy`` of a shard, which is not cut; no range has over ``most_rows`` rows of different keys (a 20,000th of all
    rows, if that is more).
    """
    ranges = [r for _, r in _counted(keys, [F.lit(0).alias("of"), F.shiftright("high", 64 - TOP_BITS).alias("top")])]
    total = sum(r.weight for r in ranges)
    most_rows = max(most_rows, sum(r.rows for r in ranges) // 20_000)
    while True:
        # ranges that may hide a heavy group come first: splitters depend on what these groups leave of each shard
        wide = [i for i, r in enumerate(ranges) if r.group is None and r.weight * shards > heavy * total]
        if not wide:
            deal = _dealt(ranges, shards, heavy)
            too_large = {u[0] for u in _units(ranges) if sum(ranges[i].weight for i in u) * shards > total}
            cut = {ranges[i].group for i in too_large}
            wide = [
                i for i, r in enumerate(ranges) if r.first != r.last and (
                    r.rows > most_rows
                    or i in deal.split and r.weight * shards > tolerance * total and (r.group is None or r.group in cut)
                )
            ]
        if not wide:
            return _joined(ranges, deal.shard, most_rows)
        # a round brings at most about ``most_counts`` counts to the driver
        parts = _probed(keys, [ranges[i] for i in wide], max(4, min(bins, most_counts // len(wide))))
        at = {i: parts[k] for k, i in enumerate(wide)}
        ranges = [part for i, r in enumerate(ranges) for part in at.get(i, [r])]


def in_ranges(rows: DataFrame, placed: list[tuple[Range, int]]) -> DataFrame:
    """``rows`` (with longs ``high`` and ``low``) with ``range``, ``shard`` and the range's first ``offset`` in it."""
    table_rows, used = [], {}
    for i, (r, shard) in enumerate(placed):
        table_rows.append((i, r.first[0] >> (64 - TOP_BITS), *r.first, *r.last, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + r.rows
    known = rows.sparkSession.createDataFrame(
        table_rows, "range int, top long, h0 long, l0 long, h1 long, l1 long, shard int, offset long"
    )
    key = F.struct("high", "low")
    return (
        rows.withColumn("top", F.shiftright("high", 64 - TOP_BITS))
        .join(F.broadcast(known), "top")
        .where((key >= F.struct("h0", "l0")) & (key <= F.struct("h1", "l1")))
        .drop("top", "h0", "l0", "h1", "l1")
    )


def shard_rows(keys: DataFrame, shards: int, **options) -> DataFrame:
    """``keys`` with ``shard`` and the gapless ``slot`` of each row in its shard, in key order there."""
    placed = histogram_ranges(keys, shards, **options)
    order = Window.partitionBy("range").orderBy("high", "low")
    slot = F.col("offset") + F.row_number().over(order) - 1
    return in_ranges(keys, placed).withColumn("slot", slot.cast("long")).drop("range", "offset")


def text_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows of documents: id, ``size``, ``text_crc32`` and the sort key."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 16
    return docs.select(
        F.col(doc_id), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("high"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_LONG)).alias("low"),
        size.alias("weight"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = staged(text_keys(table(spark, sf_dir, "documents")), "shard-keys")
    return shard_rows(keys, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
