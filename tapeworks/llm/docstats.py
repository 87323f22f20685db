"""Statistics of whole texts, computed for many texts at once.

The first five are exact counts (see ``COUNTS``); the rest are shares that models read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeworks.llm.words import BYTE_VALUES, PLACE, Words, batch_of, find_words, mix, run_hashes, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "top_word_share",
    "echo_share", "upper_share", "mark_share", "digit_share", "stop_share", "long_word_share", "wide_share",
    "odd_share", "words_per_line", "capital_word_share",
]
SYMBOLS = b"#*$%&|<>"


def _flags(members: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


_IS_SYMBOL, _IS_DIGIT = _flags(SYMBOLS), _flags(b"0123456789")
_IS_UPPER, _IS_LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_IS_MARK, _IS_STOP = _flags(b"!?"), _flags(b".,;:")
_IS_ODD = _flags(b"#*$%&|<>{}[]\\/=+^~_@`")
_IS_CHAR = ~_flags(bytes(range(0x80, 0xC0)))


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + text.astype(np.uint64) * PLACE)


def _repeat_words(words: Words, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    at, runs = words.windows(hashes, width)
    _, group, counts = np.unique(_in_text(runs, words.text[at]), return_inverse=True, return_counts=True)
    twice = at[counts[group] > 1]
    edges = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return _per_text(np.cumsum(edges[:-1]) > 0, words.first)


def _dup_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word equal to an earlier line, and lines with a word, of each text."""
    n, breaks = len(words.bounds) - 1, np.flatnonzero(words.data == 0x0A)
    # a line ends at each line break and at the end of its text
    ends = np.concatenate([breaks, words.bounds[1:]])
    text = np.concatenate([np.searchsorted(words.bounds[1:], breaks, "right"), np.arange(n)])
    order = np.lexsort((ends, text))
    ends, text = ends[order], text[order]
    starts = words.bounds[:-1][text]
    starts[1:] = np.maximum(starts[1:], np.where(text[1:] == text[:-1], ends[:-1] + 1, 0))
    starts = np.minimum(starts, ends)
    has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    lines = _in_text(run_hashes(BYTE_VALUES[words.data], starts, ends), text)
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[first] = False
    return np.bincount(text[again], minlength=n), np.bincount(text, minlength=n)


def stats_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of some texts."""
    words = find_words(texts)
    hashes, data, bounds, n = words.hashes(), words.data, words.bounds, words.counts
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IS_CHAR[data], out=chars[1:])
    lengths = chars[words.end] - chars[words.start]
    long_sums = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=long_sums[1:])
    word_chars = long_sums[words.first[1:]] - long_sums[words.first[:-1]]
    dup_lines, lines = _dup_lines(words)
    repeats = _repeat_words(words, hashes)
    symbols = _per_text(_IS_SYMBOL[data], bounds)
    keys, group, counts = np.unique(_in_text(hashes, words.text), return_inverse=True, return_counts=True)
    first_seen = np.zeros(len(hashes), bool)
    first_seen[np.unique(group, return_index=True)[1]] = True
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, words.text, counts[group])
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    some, all_chars = np.maximum(n, 1), np.maximum(chars[bounds[1:]] - chars[bounds[:-1]], 1)
    upper, lower = _per_text(_IS_UPPER[data], bounds), _per_text(_IS_LOWER[data], bounds)
    capital = _IS_UPPER[data[words.start]] if len(hashes) else np.zeros(0, bool)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "log_words": np.log1p(n),
        "mean_word": word_chars / some,
        "symbols_per_word": symbols / some,
        "dup_line_share": dup_lines / np.maximum(lines, 1),
        "repeat_share": repeats / some,
        "distinct_share": _per_text(first_seen, words.first) / some,
        "top_word_share": top / some,
        "echo_share": _per_text(echo, words.first) / some,
        "upper_share": upper / np.maximum(upper + lower, 1),
        "mark_share": _per_text(_IS_MARK[data], bounds) / some,
        "digit_share": _per_text(_IS_DIGIT[data], bounds) / all_chars,
        "stop_share": _per_text(_IS_STOP[data], bounds) / some,
        "long_word_share": _per_text(lengths > 14, words.first) / some,
        "wide_share": _per_text(data >= 0xC0, bounds) / all_chars,
        "odd_share": _per_text(_IS_ODD[data], bounds) / all_chars,
        "words_per_line": np.log1p(n / np.maximum(lines, 1)),
        "capital_word_share": _per_text(capital, words.first) / some,
    }


def matrix(stats: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(stats[name], np.float64) for name in names])


def map_stats(docs: DataFrame, text: str, keep: list[str], schema: str, build) -> DataFrame:
    """Rows of ``keep`` beside ``build(stats) -> {column: array}`` for every text of ``docs``.

    Runs inside the tasks that read the texts; no shuffle. Empty partitions give no rows.
    """
    fields = [docs.schema[name] for name in keep] + StructType.fromDDL(schema).fields
    out_schema = StructType(fields)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = build(stats_of(part.column(text)))
                columns = [part.column(name) for name in keep] + [pa.array(new[f.name]) for f in fields[len(keep) :]]
                yield batch_of(columns, arrow)

    read = [*keep, *([text] if text not in keep else [])]
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, out_schema)


def sample_by_hash(rows: DataFrame, columns: list[str], most: int, seed: int = 17) -> DataFrame:
    """At most ``most`` different rows of ``columns``: those whose hash lies below a limit, the same in every run.

    All of them where there are no more; otherwise within about a thousandth of ``most``. The limit comes from
    counts alone (of all rows, then of 4,096 equal steps of hashes), so no task sorts or holds a sample, and a row
    repeated any number of times counts once.
    """
    bits, steps = 53, 4096
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - bits)
    rows = rows.select(*columns)
    total, share = rows.count(), 1.0
    if total > 2 * most:
        share = 2 * most / total
    while True:
        width = max(1, int(share * 2**bits) // steps)
        below = rows if share >= 1 else rows.where(place < width * steps)
        step = F.floor(place / width).cast("int")
        counts = dict(map(tuple, below.distinct().groupBy(step).count().collect()))
        if share >= 1 and sum(counts.values()) <= most:
            return below.distinct()
        if share >= 1 or sum(counts.values()) >= most:
            break
        share = min(1.0, 2 * share)  # many rows are repeats of few
    end, taken = 0, 0
    while end < steps and taken + counts.get(end, 0) <= most:
        taken += counts.get(end, 0)
        end += 1
    return below.where(step < end).distinct()
