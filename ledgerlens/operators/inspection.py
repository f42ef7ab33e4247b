"""Extraction checks: pages, tables and texts of converted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SCALE, as_float, collapse, number_tokens


def page_blobs(texts: DataFrame, by: list[str], order: str, text_col: str = "text", cells: DataFrame | None = None) -> DataFrame:
    """One collapsed string per page: its texts in order, then the cell texts of its tables (cell_texts) in order."""
    rows = texts.select(*by, F.lit(0).alias("__kind"), F.col(order).cast("long").alias("__order"), F.col(text_col).alias("__text"))
    if cells is not None:
        rows = rows.unionByName(cells.select(*by, F.lit(1).alias("__kind"), F.col("table_ordinal").cast("long").alias("__order"), F.col("cells_text").alias("__text")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__kind", "__order", "__text"))), lambda s: s["__text"])
    return rows.groupBy(*by).agg(collapse(F.array_join(ordered, " ")).alias("blob"))


def cell_texts(cells: DataFrame, by: list[str], order: list[str], text_col: str = "text") -> DataFrame:
    """cells_text of each table: its cells in order, joined by blanks."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text_col, F.lit("")).alias("__text")))), lambda s: s["__text"])
    return cells.groupBy(*by).agg(F.array_join(ordered, " ").alias("cells_text"))


def _page_shares(evidence: DataFrame, pages: DataFrame, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence with its token set's key, sets, shares of (set, page) at the floor or above).

    Evidence with the same tokens is one set. A page with the floor's share of a set's n tokens has one of any
    n - ceil(floor n) + 1 of them, so a page is a candidate only by the set's rarest ones; candidates are then counted whole.
    """
    wanted = evidence.select("e_id", F.array_sort(number_tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0).withColumn("key", F.md5(F.array_join("tokens", " ")))
    sets = wanted.groupBy("key").agg(F.first("tokens").alias("tokens"))
    each = sets.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    held = pages.select("page_id", F.explode(number_tokens(F.col("blob"))).alias("token")).join(each.select("token").distinct(), "token", "left_semi")
    counted = each.join(held.groupBy("token").agg(F.count("*").alias("pages")), "token")
    rarest = F.row_number().over(Window.partitionBy("key").orderBy("pages", "token"))
    # Tokens that no page has are the rarest of all, and lead to no page.
    absent = F.col("n") - F.count("*").over(Window.partitionBy("key"))
    led = counted.withColumn("place", rarest + absent).where(F.col("place") <= F.col("n") - F.ceil(F.lit(floor) * F.col("n")) + 1)
    candidates = held.join(led.select("key", "token"), "token").select("key", "page_id").distinct()
    whole = candidates.join(each, "key").join(held, ["page_id", "token"])
    shares = whole.groupBy("key", "page_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("share")).where(F.col("share") >= floor)
    return wanted, sets, shares


def evidence_pages(evidence: DataFrame, pages: DataFrame, top: int = 3, floor: float = 0.3) -> DataFrame:
    """The pages that hold most of an evidence's numeric tokens: (e_id, page_id, share, place); a page without any is not listed.

    evidence: (e_id, text); pages: (page_id, blob). The floor decides nothing about what is listed: pages at it are found by
    rare tokens, and only where there are fewer than top of them the others are counted too. Whether a page matches at all is
    for the reader of the first place to say (evidence_report).
    """
    wanted, sets, shares = _page_shares(evidence, pages, floor)
    shares = shares.select("key", "page_id", "share")
    if top > 1:
        short = sets.join(shares.groupBy("key").agg(F.count("*").alias("found")), "key", "left").where(F.coalesce("found", F.lit(0)) < top).drop("found")
        each = short.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        held = pages.select("page_id", F.explode(number_tokens(F.col("blob"))).alias("token"))
        rest = held.join(each, "token").groupBy("key", "page_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("share"))
        shares = shares.unionByName(rest.where(F.col("share") < floor))
    order = Window.partitionBy("key").orderBy(F.desc("share"), F.desc("page_id"))
    best = shares.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return wanted.select("e_id", "key").join(best, "key").select("e_id", "page_id", "share", "place")


def evidence_report(evidence: DataFrame, pages: DataFrame, floor: float = 0.3) -> DataFrame:
    """Of each evidence (e_id, text, label, answer): best page, whether it is another than the label, how many of its n numbers
    are on it, the missing ones (15 at most), and of the answer's values on which pages they stand.

    Columns: e_id, n, best_page, share, is_offset, recovered, missing, answers (array of value, on_page, first six pages). Without
    a page at the floor everything after n is null.
    """
    best = evidence_pages(evidence, pages, 1, floor).where(F.col("share") >= floor).select("e_id", F.col("page_id").alias("best_page"), "share")
    asked = evidence.select("e_id", F.col("label").cast("string").alias("label"), number_tokens(F.col("text")).alias("wanted"), number_tokens(F.col("answer")).alias("said"))
    held = pages.select(F.col("page_id").alias("best_page"), number_tokens(F.col("blob")).alias("held"))
    found = asked.where(F.size("wanted") > 0).join(best, "e_id", "left").join(held, "best_page", "left")
    missing = F.array_sort(F.array_except("wanted", "held"))
    report = found.select("e_id", F.size("wanted").alias("n"), "best_page", "share", (F.col("best_page").cast("string") != F.col("label")).alias("is_offset"), (F.size("wanted") - F.size(missing)).alias("recovered"), F.slice(missing, 1, 15).alias("missing"))
    report = report.withColumn("recovered", F.when(F.col("best_page").isNotNull(), F.col("recovered")))
    values = asked.join(best, "e_id").select("e_id", "best_page", F.explode(F.array_distinct(F.transform("said", as_float))).alias("value"))
    where = pages.select("page_id", F.explode(F.array_distinct(F.transform(number_tokens(F.col("blob")), as_float))).alias("value"))
    where = where.join(values.select("value").distinct(), "value", "left_semi")
    # Of the pages with a value only the first six are shown, beside whether the best page is one of them.
    first = where.withColumn("place", F.row_number().over(Window.partitionBy("value").orderBy("page_id"))).where("place <= 6").groupBy("value").agg(F.array_sort(F.collect_list("page_id")).alias("pages"))
    here = where.select("value", F.col("page_id").alias("best_page"), F.lit(True).alias("here"))
    none = F.array().cast(pages.schema["page_id"].dataType.simpleString().join(("array<", ">")))
    placed = values.join(here, ["value", "best_page"], "left").join(first, "value", "left")
    placed = placed.select("e_id", F.struct("value", F.coalesce("here", F.lit(False)).alias("on_page"), F.coalesce("pages", none).alias("pages")).alias("a"))
    return report.join(placed.groupBy("e_id").agg(F.array_sort(F.collect_list("a")).alias("answers")), "e_id", "left")


def table_fragments(tables: DataFrame, doc: str = "doc_id", page: str = "page", columns: str = "num_cols", headed: str = "has_header") -> DataFrame:
    """Headless tables that continue one with a header on the page before, with as many columns: (doc, page, continues)."""
    heads = tables.where(F.col(headed)).select(doc, (F.col(page) + 1).alias(page), columns, F.col(page).alias("continues"))
    return tables.where(~F.col(headed)).join(heads.distinct(), [doc, page, columns]).select(doc, page, "continues")


def marked_elsewhere(tables: DataFrame, texts: DataFrame, keys: list[str], pattern: str, table_text: str = "table_text", text_col: str = "text") -> DataFrame:
    """Tables whose page has a text with the scale marker while they have none themselves."""
    marked = texts.where(F.regexp_like(text_col, F.lit(pattern))).select(*keys).distinct()
    return tables.where(~F.regexp_like(table_text, F.lit(pattern))).join(marked, keys, "left_semi")


def containing(texts: DataFrame, needle: str, text_col: str = "text") -> DataFrame:
    return texts.where(F.contains(F.lower(F.col(text_col)), F.lit(needle.lower())))


def overview(texts: DataFrame, by: str, page: str, headed: Column) -> DataFrame:
    """Counts of texts, pages and headless tables per document, and the last page."""
    return texts.groupBy(by).agg(F.count("*").alias("n_texts"), F.count_distinct(page).alias("n_pages"), F.count_if(~headed).alias("n_headless"), F.max(page).alias("last_page"))


def document_overview(tables: DataFrame, texts: DataFrame, pages: DataFrame, shown: int = 20) -> DataFrame:
    """One row per document: how many pages, tables and texts it has, and what its tables lack.

    tables: doc_id, table_ordinal, page, num_cols, has_header, cells_text, bottom (share of the page's height or null); texts:
    doc_id, page, text; pages: doc_id. Columns: doc_id, n_pages, n_tables, n_texts, n_headless and the first of them, fragments
    (pairs of a table with a header and one without that goes on from it a page later, as wide as it), lowest, n_marked and the
    first tables with a scale in their cells, and the first that have it only elsewhere on their page (marked_elsewhere).
    """
    marked = F.regexp_like(F.coalesce("cells_text", F.lit("")), F.lit(SCALE))
    first = lambda test: F.slice(F.array_sort(F.collect_list(F.when(test, F.col("table_ordinal")))), 1, shown)
    counted = tables.groupBy("doc_id").agg(
        F.count("*").alias("n_tables"), F.count_if(~F.col("has_header")).alias("n_headless"), first(~F.col("has_header")).alias("headless"),
        F.max(F.when(F.col("bottom") != 0, F.col("bottom"))).alias("lowest"), F.count_if(marked).alias("n_marked"), first(marked).alias("marked"),
    )
    heads = tables.where("has_header").select("doc_id", (F.col("page") + 1).alias("page"), "num_cols", F.col("table_ordinal").alias("from"))
    pairs = tables.where("not has_header").join(heads, ["doc_id", "page", "num_cols"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("from"), F.col("table_ordinal").alias("to")))).alias("fragments"))
    elsewhere = marked_elsewhere(tables.withColumn("cells_text", F.coalesce("cells_text", F.lit(""))), texts.withColumn("text", F.coalesce("text", F.lit(""))), ["doc_id", "page"], SCALE, "cells_text")
    elsewhere = elsewhere.groupBy("doc_id").agg(first(F.lit(True)).alias("marked_elsewhere"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    for more in (counted, texts.groupBy("doc_id").agg(F.count("*").alias("n_texts")), pairs, elsewhere):
        out = out.join(more, "doc_id", "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n_tables", "n_headless", "n_marked", "n_texts")}
    kinds = dict(out.dtypes)
    return out.withColumns(none | {c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("headless", "marked", "fragments", "marked_elsewhere")})


def table_overview(tables: DataFrame, by: str = "doc_id") -> DataFrame:
    """Tables of each document: how many, how many without a header, the lowest bottom, and which carry a scale marker themselves.

    tables: doc, table_ordinal, page, has_header, bottom (share of the page height, or null), cells_text. A bottom of 0 is none.
    """
    marked = F.regexp_like(F.coalesce("cells_text", F.lit("")), F.lit(SCALE))
    return tables.groupBy(by).agg(
        F.count("*").alias("n_tables"), F.count_if(~F.col("has_header")).alias("n_headless"), F.max(F.when(F.col("bottom") != 0, F.col("bottom"))).alias("lowest"), F.count_if(marked).alias("n_marked"), F.array_sort(F.collect_list(F.when(marked, F.col("table_ordinal")))).alias("marked")
    )


def tables_by_page(tables: DataFrame, by: str = "doc_id") -> DataFrame:
    """(doc, page, tables): the table ordinals of each page, in order."""
    return tables.groupBy(by, "page").agg(F.array_sort(F.collect_list("table_ordinal")).alias("tables"))


def kind_counts(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """How many prose and table chunks each document has."""
    return chunks.groupBy(by).agg(F.count_if(F.col("kind") == "prose").alias("prose"), F.count_if(F.col("kind") == "table").alias("tables"))


def only_table(rows: DataFrame, ordinal: int) -> DataFrame:
    """Rows of one table."""
    return rows.where(F.col("table_ordinal") == ordinal)


def vertical_extent(top: Column, bottom: Column, height: Column, origin: Column) -> Column:
    """(from, to) of a box as shares of the page height, counted from the top whatever the origin."""
    from_bottom = F.endswith(origin, F.lit("BOTTOMLEFT"))
    a = F.when(from_bottom, 1 - F.try_divide(top, height)).otherwise(F.try_divide(top, height))
    b = F.when(from_bottom, 1 - F.try_divide(bottom, height)).otherwise(F.try_divide(bottom, height))
    return F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))
