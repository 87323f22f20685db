"""Landed API responses and crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.text import or_blank
from tapeworks.functions.times import trading_date
from tapeworks.sources.messages import Fields, typed

# The paths under which a response keeps its rows, first match wins.
ROW_PATHS = ["$.RepeatedInfo", "$.dataList", "$.data", "$.data.dataList", "$.datalist"]


def response_rows(responses: DataFrame, body: str, row_schema: str, *keep: str) -> DataFrame:
    """One row per record of a response body: a JSON list, or an object that holds one.

    Records come back typed by ``row_schema``; a response without records contributes nothing.
    """
    filled_list = r"^\s*\[\s*[^\]\s]"
    texts = [F.col(body), *[F.get_json_object(body, path) for path in ROW_PATHS]]
    rows_text = F.coalesce(*[F.when(text.rlike(filled_list), text) for text in texts])
    rows = F.from_json(rows_text, f"array<struct<{row_schema}>>")
    return responses.select(*keep, F.explode(rows).alias("_row")).select(*keep, "_row.*")


def load_rows(rows: DataFrame, fields: Fields, code: str, *keep: str) -> DataFrame:
    """Typed columns of response records read as text, with the reason for each rejected record.

    ``code`` is the wire name of the identifying field. A record without it, or with a date that
    cannot be read, is rejected; an empty date is NULL.
    """
    date_text = F.trim(F.col("TradingDate"))
    bad_date = (date_text != "") & trading_date(date_text).isNull()
    reason = F.when(or_blank(F.col(code)).isNull(), "no code").when(bad_date, "bad date")
    return rows.select(
        *keep,
        *[typed(F.trim(F.col(wire)), kind).alias(column) for wire, column, kind in fields],  # an empty number is no number
        reason.alias("reject_reason"),
    )


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where("reject_reason is null").drop("reject_reason")


def html_rows(
    pages: DataFrame, html: str, columns: list[str], row_tag: str, cell_tag: str, *keep: str,
    container: str | None = None,
) -> DataFrame:
    """Rows of markup tables: the cell texts of every row element with enough cells.

    Rows with fewer cells than ``columns`` are skipped and surplus cells ignored. Rows are taken from the first
    ``container`` element of a page, or from the whole page without one. Tags match in any case.
    """
    element = lambda tag: rf"(?si)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    row_body, cell_body = element(row_tag), element(cell_tag)
    searched = F.regexp_extract(html, element(container), 1) if container else F.col(html)
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(searched, F.lit(row_body), 1)).alias("row_no", "_row"))
    cells = rows.withColumn("_cells", F.regexp_extract_all("_row", F.lit(cell_body), 1))
    wide = cells.where(F.size("_cells") >= len(columns))
    return wide.select(
        *keep, "row_no", *[cell_text(F.col("_cells")[i]).alias(name) for i, name in enumerate(columns)]
    )


def cell_text(markup: Column) -> Column:
    """Text of a cell: no tags, no surrounding white space, the five basic entities resolved."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    # The basic entities; the ampersand last.
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def load_sectors(rows: DataFrame) -> DataFrame:
    """Sector rows from CSV of either header: ``Sector`` or ``Brand`` names the sector."""
    name = next(c for c in ("Sector", "Brand") if c in rows.columns)
    return rows.select(
        F.trim(name).alias("sector_name"), F.trim("Symbol").alias("symbol_id"), F.trim("Market").alias("market_name")
    )


def index_list_rows(items: DataFrame, *keep: str) -> DataFrame:
    """Index list records with trimmed names; the code stands in for a blank name, no code rejects."""
    code = or_blank(F.col("IndexCode"))
    named = items.select(
        *keep,
        F.trim("Exchange").alias("exchange"),
        code.alias("indexlist_id"),
        F.coalesce(or_blank(F.col("IndexName")), code).alias("index_name"),
        code.alias("index_code"),
    )
    return named.where("index_code is not null")
