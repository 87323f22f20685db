"""Benchmark decontamination: a set join on the rarest shingle of each benchmark window.

Every window (13 words of an item; a shorter item is one window) must occur in a document with all its shingles, so
looking for one of them is enough: its rarest shingle by the number of places in all documents. Windows whose
rarest shingle occurs nowhere are out. A found shingle fixes where the window would start; starts outside
the document are out (length and position), the others are verified word by word. Shingles have three
words, fewer only for items of one or two words.

Words are compared in a Unicode lower case while searching, which can only find more, and in the ASCII lower case of
the contract while verifying. The prefix table is broadcast in blocks of at most ``block_bytes``; each block is one more
pass over the documents. Documents are exploded in place and only hits and one row per document are shuffled.

Defined results: null texts have no words, no hits, and the digest of an empty list; null item ids are left
out of the lists but their windows hit; rows of documents are kept one to one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.shared import fresh, table
from tapeworks.session import staged

ITEM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW, SHINGLE = 13, 3
#: Files of tables that hold a row or so per benchmark window; they are merged into few after the aggregates.
FILES = 8


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ITEM_WORD), F.lit(0))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _shingle(words: str, at: Column, width: int) -> Column:
    """Hash of ``width`` words from the 0-based place ``at``; null where they run over the end."""
    parts = [F.lower(F.get(F.col(words), at + i)) for i in range(width)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(width), *parts))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int = WINDOW) -> DataFrame:
    """Distinct windows: ``window`` (its words in lower case), ``length``, and the ids of its items."""
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), item_words(ascii_lower(F.col(text))).alias("words")
    ).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.lit(width), F.size("words")))
    items = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    window = F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window")
    return items.groupBy(window, "length").agg(F.collect_set("item").alias("items"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """All shingles of the windows: ``window, length, items, offset, shingle``."""
    rows = windows.withColumn("words", F.split("window", " "))
    size = F.least(F.lit(SHINGLE), F.col("length"))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("length") - size)))
    shingle = F.coalesce(*[
        F.when(F.col("length") == n, _shingle("words", F.col("offset"), n)) for n in range(1, SHINGLE)
    ], _shingle("words", F.col("offset"), SHINGLE))
    return rows.withColumn("shingle", shingle).withColumn("width", size).drop("words")


def _shingled(docs: DataFrame, words: str, widths: list[int]) -> DataFrame:
    """Documents with one row for each word place ``pos`` (null without words) and width, with its ``shingle``."""
    rows = docs.select("*", F.posexplode_outer(words).alias("pos", "_word"))
    found = [_shingle(words, F.col("pos"), n) for n in widths]
    if len(found) == 1:
        return rows.withColumn("shingle", found[0]).drop("_word")
    return rows.withColumn("shingle", F.explode(F.array(*found))).drop("_word")


def rarest_shingles(docs: DataFrame, windows: DataFrame, text: str, block_bytes: int) -> tuple[DataFrame, list[int], int]:
    """The prefix table (each window with its rarest shingle), the shingle widths in use, and the number of blocks."""
    shingles = staged(window_shingles(windows).repartition(FILES), "window-shingles")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())
    if not widths:
        return shingles.where("false"), [], 1
    names = staged(shingles.select("shingle").distinct().repartition(FILES), "shingles")
    blocks = -(-names.count() * 16 // block_bytes)
    words = docs.select(item_words(F.col(text)).alias("_words"))
    places = None
    for b in range(blocks):
        wanted = names.where(F.pmod("shingle", F.lit(blocks)) == b)
        found = _shingled(words, "_words", widths).join(F.broadcast(wanted), "shingle", "left_semi")
        found = found.groupBy("shingle").agg(F.count("*").alias("places"))
        places = found if places is None else places.unionByName(found)
    least = F.min_by(F.struct("offset", "shingle"), F.struct("places", "shingle", "offset")).alias("rarest")
    # a shingle without places is missing from the join: its window occurs nowhere
    known = shingles.join(staged(places.repartition(FILES), "shingle-places"), "shingle", "left")
    prefix = known.groupBy("window", "length").agg(
        F.min(F.coalesce("places", F.lit(0))).alias("_least"), F.first("items").alias("items"), least
    ).where("_least > 0")
    prefix = staged(prefix.select("window", "length", "items", "rarest.*").repartition(FILES), "window-prefix")
    size = F.sum(F.octet_length("window") + F.coalesce(F.octet_length(F.array_join("items", ",")), F.lit(0)) + 64)
    bytes_ = prefix.agg(size).first()[0] or 0
    return prefix, widths, max(1, -(-bytes_ // block_bytes))


def window_hits(
    docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WINDOW, block_bytes: int = 48 << 20,
) -> DataFrame:
    """Per group of ``keys`` (columns of ``docs``): ``n_words``, ``n_hit`` and the sorted ``items``."""
    windows = benchmark_windows(benchmark, item_id, item_text, width)
    prefix, widths, blocks = rarest_shingles(docs, windows, text, block_bytes)
    rows = docs.select(*keys, item_words(F.col(text)).alias("_words"))
    rows = rows.withColumn("n_words", F.size("_words"))
    if not widths:
        return rows.groupBy(*keys).agg(
            F.max("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("items"),
        )
    hits = None
    for b in range(blocks):
        block = prefix.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        found = _shingled(rows, "_words", widths).join(F.broadcast(block), "shingle", "left")
        start = F.col("pos") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
        same = ascii_lower(F.array_join(F.slice("_words", start + 1, F.col("length")), " ")) == F.col("window")
        # the first place of a document stays as the row that carries its number of words
        first = (F.coalesce("pos", F.lit(0)) == 0) if b == 0 else F.lit(False)
        hit = F.col("window").isNotNull() & F.when(fits, same).otherwise(False)
        found = found.where(F.col("window").isNotNull() | first).withColumn("_hit", hit).where(F.col("_hit") | first)
        found = found.select(
            *keys, "n_words", F.when(F.col("_hit"), F.struct(start.alias("start"), "length")).alias("span"),
            F.when(F.col("_hit"), F.col("items")).alias("items"),
        )
        hits = found if hits is None else hits.unionByName(found)
    covered = F.array_distinct(F.flatten(F.transform(
        F.collect_set("span"), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)
    )))
    return hits.groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def is_contaminated(percent: int = 5) -> Column:
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    key, named = fresh(docs, "_text_key"), fresh(docs, "_doc_key")
    rows = docs.withColumn(key, F.xxhash64(text))
    narrow = rows.select(F.col(doc_id).alias(named), key, F.col(text).alias("_text"))
    bad = window_hits(narrow, benchmark, [named, key], "_text").where(is_contaminated()).select(
        F.col(named), F.col(key).alias("_bad_key")
    )
    same = rows[doc_id].eqNullSafe(bad[named]) & (rows[key] == bad["_bad_key"])
    return rows.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    found = window_hits(docs, table(spark, sf_dir, "benchmark"), ["_row", "doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""
