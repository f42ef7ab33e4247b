"""Derived metrics whose inputs all stand in one table of one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finance import LINE_ITEMS, METRICS, Metric, show


def item_places(label: Column, patterns: dict[str, list[str]]) -> Column:
    """(key, place) of each key whose patterns fit a label: place is that of the first pattern that fits. No shuffle, no join."""
    found = []
    for key, listed in patterns.items():
        place = reduce(lambda rest, n: F.when(label.ilike(listed[n]), F.lit(n)).otherwise(rest), reversed(range(len(listed))), F.lit(None).cast("int"))
        found.append(F.struct(F.lit(key).alias("key"), place.alias("place")))
    return F.filter(F.array(*found), lambda x: x["place"].isNotNull())


def line_items(facts: DataFrame, patterns: dict[str, list[str]] | None = None, label_col: str = "row_label") -> DataFrame:
    """facts with each key whose patterns fit the label, and the place of the best fitting pattern. Equal facts stay as they are."""
    made = facts.withColumn("__item", F.explode(item_places(F.col(label_col), patterns or LINE_ITEMS)))
    return made.select(*facts.columns, "__item.key", "__item.place")


def table_inputs(candidates: DataFrame, group: list[str], inputs: tuple[str, ...]) -> DataFrame:
    """One row per group (doc, table) that holds every input: its values, and the sum of the places.

    candidates: (*group, key, place, label_length, fact_id, value). Of several facts for a key the best place, then the
    shortest label, then the smallest id counts.
    """
    best = lambda key: F.min_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.struct("place", "label_length", "fact_id")))
    place = lambda key: F.min(F.when(F.col("key") == key, F.col("place")))
    named = candidates.where(F.col("key").isin(*inputs)).groupBy(*group)
    wide = named.agg(F.count_distinct("key").alias("n_keys"), *[best(k).alias(k) for k in inputs], sum((place(k) for k in inputs), F.lit(0)).alias("places"))
    return wide.where(F.col("n_keys") == len(inputs)).drop("n_keys")


def with_metric(tables: DataFrame, metric: Metric, out: str = "value", shown: str | None = None) -> DataFrame:
    """tables with the metric's value; null where it is not computable."""
    made = tables.withColumn(out, metric.formula(*[F.col(c) for c in metric.inputs]))
    return made.withColumn(shown, show(F.col(out), metric)) if shown else made


def _fits(lowered: Column, listed: list[str]) -> Column:
    return reduce(Column.__or__, [lowered.like(p.lower()) for p in listed])


def in_whole_tables(facts: DataFrame, names: tuple[str, ...], patterns: dict[str, list[str]], group: list[str]) -> DataFrame:
    """facts of the groups (tables) that hold every input of one of the metrics.

    A label is a number with a bit for each key that it fits, and a table the bits of its labels: far less work than to choose
    among the facts of all tables, most of which lack an input.
    """
    bit = {key: 1 << n for n, key in enumerate(patterns)}
    fits = lambda listed: _fits(F.col("__label"), listed)
    bits = reduce(Column.bitwiseOR, [F.when(fits(listed), F.lit(bit[key])).otherwise(F.lit(0)) for key, listed in patterns.items()])
    held = F.bit_or("__bits").over(Window.partitionBy(*group))
    needed = [sum({bit[key] for key in METRICS[name].inputs}) for name in names]
    marked = facts.withColumn("__label", F.lower("row_label")).withColumn("__bits", bits).withColumn("__held", held)
    return marked.where(reduce(Column.__or__, [F.col("__held").bitwiseAND(F.lit(n)) == n for n in needed])).select(*facts.columns)


INPUT = "struct<key string, fact_id long, label string, value double, page int, doc_name string>"


def compute(facts: DataFrame, names: tuple[str, ...] = tuple(METRICS), by: tuple[str, ...] = ("company", "fiscal_year")) -> DataFrame:
    """Metrics of every (company, year), in one pass over the facts: (*by, metric, doc_id, table_ordinal, value, shown, note, scale, inputs).

    facts: fact_id, doc_id, doc_name, table_ordinal, row_label, column_label, signed, scale, page, company, fiscal_year. Only
    columns whose header has the year count. A table must hold every input; of those that do, the one with the best label
    places is taken, ties by document and table, and if a division by zero makes that one not computable there is no result.
    The scale is the first input's. inputs are in the order of the metric's definition.
    """
    wanted = {key: LINE_ITEMS[key] for name in names for key in METRICS[name].inputs}
    dated = facts.where(F.expr("contains(column_label, cast(fiscal_year as string))"))
    dated = dated.where(_fits(F.lower("row_label"), list(dict.fromkeys(p for listed in wanted.values() for p in listed))))  # the others are no input
    found = line_items(in_whole_tables(dated, names, wanted, ["doc_id", "table_ordinal", *by]), wanted)  # numbers first: rows are put in order by them
    order = F.struct("place", F.length("row_label").alias("length"), "fact_id")
    entry = F.struct("key", "fact_id", F.col("row_label").alias("label"), F.col("signed").cast("double").alias("value"), "page", "doc_name", "place", "scale")
    best = found.groupBy(*by, "doc_id", "table_ordinal", "key").agg(F.min_by(entry, order).alias("entry"))
    tables = best.groupBy(*by, "doc_id", "table_ordinal").agg(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("items"))

    def entries(name: str) -> list[Column]:
        return [F.try_element_at("items", F.lit(key)) for key in METRICS[name].inputs]

    def places(name: str) -> Column:
        return reduce(Column.__add__, [e["place"] for e in entries(name)])  # null where an input is missing

    def made(name: str) -> Column:
        metric, own = METRICS[name], entries(name)
        value = metric.formula(*[e["value"] for e in own])
        inputs = F.array(*[F.struct(*[e[c].alias(c) for c in ("key", "fact_id", "label", "value", "page", "doc_name")]) for e in own])
        return F.when(F.col("metric") == name, F.struct(value.alias("value"), show(value, metric).alias("shown"), F.lit(metric.note).alias("note"), own[0]["scale"].alias("scale"), inputs.alias("inputs")))

    # The best table is chosen by places alone; the rest is made of that one only.
    fitting = F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), places(n).alias("places")) for n in names]), lambda x: x["places"].isNotNull())
    rows = tables.select(*by, "doc_id", "table_ordinal", "items", F.explode(fitting).alias("m"))
    best_table = rows.groupBy(*by, F.col("m.metric").alias("metric")).agg(F.min_by(F.struct("doc_id", "table_ordinal", "items"), F.struct("m.places", "doc_id", "table_ordinal")).alias("t"))
    out = best_table.select(*by, "metric", "t.doc_id", "t.table_ordinal", "t.items").withColumn("m", F.coalesce(*[made(n) for n in names]))
    out = out.select(*by, "metric", "doc_id", "table_ordinal", *[F.col(f"m.{c}").alias(c) for c in ("value", "shown", "note", "scale", "inputs")])
    return out.where("value is not null")
