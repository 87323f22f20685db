"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule accepts or blocks train one variable-order Markov model each: the probability of a character after its
longest known context of up to three characters, smoothed towards shorter contexts by Witten and Bell's
weights. A URL without a rule is allowed if its log-likelihood ratio per character reaches a threshold
that was calibrated on labelled URLs kept out of the counts.

Everything is a DataFrame expression: n-grams are exploded, counted by gram and class, smoothed level by level in
joins of gram tables, and scored by one broadcast join. The gram table has at most ``len(SYMBOLS) ** 4``
rows whatever the input, which bounds the broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is scored as an empty
string. If no URL is accepted, or none blocked, or none is left for calibration, the models allow everything
without a rule. Rows are kept one to one; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.shared import table
from tapeworks.session import staged

#: Verdict, host and path of each rule (fixed values).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: What URLs are written in for the models; anything else is "~", and "^" and "$" mark the ends.
LETTERS = string.ascii_lowercase + string.digits + "-./_"
SYMBOLS = LETTERS + "~^$"
ORDER = 4


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path`` and ``rest`` (all after ``://``)."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    df = df.withColumn("rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("_host", F.regexp_extract("rest", "^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(_host) + 1)"), "^[^?#]*", 0))
    return df.withColumn("host", ascii_lower(F.col("_host"))).drop("_host")


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``, else nulls."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        for _, host, path in longest
    ]

    def first(values):
        return F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)])

    return df.withColumn("rule", first([host + path for _, host, path in longest])).withColumn(
        "rule_verdict", first([verdict for verdict, _, _ in longest])
    )


def grams(df: DataFrame) -> DataFrame:
    """One row for each character of ``rest``: ``gram``, the character after its three predecessors."""
    folded = F.regexp_replace(ascii_lower(F.col("rest")), r"[^a-z0-9\-./_]", "~")
    marked = F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$"))
    df = df.withColumn("_marked", marked).drop("rest")
    df = df.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_marked") - (ORDER - 1))))
    return df.withColumn("gram", F.expr(f"substring(_marked, _at, {ORDER})")).drop("_marked", "_at")


def gram_ratios(counts: DataFrame) -> DataFrame:
    """``gram`` and ``ratio``, the log of its probability among accepted over that among blocked URLs.

    ``counts`` has every gram that will be looked up, with its counts ``a`` and ``b`` (0 where not trained).
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.expr("substring(gram, 2)").alias("gram")
        levels[k] = levels[k + 1].groupBy(shorter).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chance = None
    for k in range(1, ORDER + 1):
        context = F.expr(f"substring(gram, 1, {k - 1})").alias("context")
        stats = levels[k].groupBy(context).agg(*[
            f.alias(f"{name}_{c}")
            for c in "ab"
            for name, f in (("n", F.sum(c)), ("t", F.sum(F.when(F.col(c) > 0, 1).otherwise(0))))
        ])
        now = levels[k].withColumn("context", context).join(stats, "context")
        if chance is None:
            now = now.withColumn("p_a", F.lit(1 / len(SYMBOLS))).withColumn("p_b", F.lit(1 / len(SYMBOLS)))
        else:
            now = now.withColumn("lower", F.expr("substring(gram, 2)")).join(
                chance.withColumnRenamed("gram", "lower"), "lower"
            )
        for c in "ab":
            n, t = F.col(f"n_{c}"), F.col(f"t_{c}")
            seen = (F.col(c) + t * F.col(f"p_{c}")) / (n + t)
            now = now.withColumn(f"p_{c}", F.when(n > 0, seen).otherwise(F.col(f"p_{c}")))
        chance = now.select("gram", "p_a", "p_b")
    return chance.select("gram", (F.ln("p_a") - F.ln("p_b")).alias("ratio"))


def mean_ratios(rows: DataFrame, ratios: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the mean ``score`` of the characters of each row; ``keep`` must tell rows apart."""
    return grams(rows).join(F.broadcast(ratios), "gram").groupBy(*keep).agg(F.avg("ratio").alias("score"))


def calibrated(scores: DataFrame, bins: int = 2000, span: float = 10.0) -> float:
    """The threshold with the best mean of both classes' accuracy, from a histogram; lowest possible if a class is
    missing."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") + span) / (2 * span) * bins)))
    found = scores.groupBy(place.cast("int").alias("bin")).agg(
        F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad")
    ).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    if not good or not bad:
        return float("-inf")
    best, value, below_good, below_bad, last = -span, -1.0, 0, 0, -1
    for r in found:
        accuracy = (good - below_good) / good + below_bad / bad
        if accuracy > value + 1e-12:
            # between the last score below and the first above
            best, value = ((last + 1 + r["bin"]) / 2) / bins * 2 * span - span, accuracy
        below_good, below_bad, last = below_good + r["good"], below_bad + r["bad"], r["bin"]
    return best


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``."""
    urls = apply_rules(split_url(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url"), rules)
    urls = urls.drop("url").withColumn("_row", F.monotonically_increasing_id())
    held = F.pmod(F.xxhash64("rest"), F.lit(5)) == 0
    trains = F.col("rule_verdict").isNotNull() & ~held
    marked = urls.select(
        "rest", (trains & (F.col("rule_verdict") == "allow")).cast("int").alias("a"),
        (trains & (F.col("rule_verdict") == "block")).cast("int").alias("b"),
    ).na.fill(0, ["a", "b"])
    counts = staged(grams(marked).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-grams")
    trained = counts.agg((F.sum("a") > 0) & (F.sum("b") > 0)).first()[0]
    if not trained:
        verdict = F.coalesce("rule_verdict", F.lit("allow")).alias("verdict")
        return urls.select("page_id", "host", "path", "rule", verdict, F.lit(0.0).alias("score"))
    ratios = staged(gram_ratios(counts), "url-ratios")
    labelled = urls.where(held & F.col("rule_verdict").isNotNull())
    labelled = labelled.select("_row", "rest", (F.col("rule_verdict") == "allow").alias("good"))
    threshold = calibrated(mean_ratios(labelled, ratios, ["_row", "good"]))
    scored = mean_ratios(urls, ratios, ["_row", "page_id", "host", "path", "rule", "rule_verdict"])
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", judged).alias("verdict"), "score"
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
