"""Readers and writers: question and document files, result tables, reports, catalogue views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one, on a single machine only."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="ledgerlens-")).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and cut off from its plan, by a checkpoint in the folder that spark.checkpoint.dir names.

    Plans that use a result several times stay small so. Where the setting is missing, a single machine gets a folder of its own,
    and on a cluster df is kept in memory instead.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master != "local" and not context.master.startswith("local["):
            return df.persist()
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="ledgerlens-"))
    return df.checkpoint()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written once, by columns, under the shared folder: for a large table that a plan reads several times, a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schemas.QUESTIONS).alias("q")).select("q.*")



def question_by_id(questions: DataFrame, qid: str) -> DataFrame:
    return questions.where(F.col("financebench_id") == qid).limit(1)


def read_converted(spark: SparkSession, path: str) -> DataFrame:
    """Converted documents, one JSON file each, with the file's stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(schemas.CONVERTED).json(path, multiLine=True).withColumn("stem", stem)


def stems(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Names without folder and suffix of the files that fit the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))


def table_cells(converted: DataFrame) -> DataFrame:
    """One row per table cell: stem, table_ordinal, page, num_cols and the cell."""
    tables = converted.select("stem", F.posexplode("tables").alias("table_ordinal", "t"))
    head = tables.select("stem", "table_ordinal", F.try_element_at("t.prov", F.lit(1))["page_no"].alias("page"), F.col("t.data.num_cols").alias("num_cols"), F.explode("t.data.table_cells").alias("c"))
    return head.select("stem", "table_ordinal", "page", "num_cols", "c.*")


def merge_parts(parts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Arrays of a document's parts, end to end in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return parts.groupBy(key).agg(F.flatten(ordered).alias(value))


def table_grid(cells: DataFrame) -> DataFrame:
    """A table's cells as rows of a grid: stem, table_ordinal, row and an array of the texts of columns 0, 1, ...; gaps are empty."""
    rows = cells.groupBy("stem", "table_ordinal", F.col("start_row_offset_idx").alias("row"), "num_cols").agg(F.map_from_entries(F.collect_list(F.struct("start_col_offset_idx", F.coalesce("text", F.lit(""))))).alias("by_column"))
    columns = F.sequence(F.lit(0), F.greatest(F.col("num_cols") - 1, F.lit(0)))
    return rows.select("stem", "table_ordinal", "row", F.transform(columns, lambda c: F.coalesce(F.try_element_at("by_column", c), F.lit(""))).alias("cells"))


def write_table_csv(grid: DataFrame, width: int, path: str) -> None:
    """One table's grid (table_grid) as CSV of width columns, in the order of its rows; a table is small, so it is one file."""
    rows = grid.coalesce(1).sortWithinPartitions("row")
    rows.select(*[F.get("cells", F.lit(c)).alias(f"c{c}") for c in range(width)]).write.mode("overwrite").option("header", False).csv(path)


def write_csv(rows: DataFrame, fields: list[str], path: str, mode: str = "overwrite") -> None:
    """The fields only, under a header; mode append keeps the results of earlier batches. Quotes in a field are doubled."""
    rows.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_csv wrote; a field may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv_in_parts(rows: DataFrame, key: str, fields: list[str], path: str, run: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """run(rows) part by part, each part's results written before the next one begins; returns what is written so far.

    Called again after a failure it goes on with the rows whose key is not written yet.
    """
    spark = rows.sparkSession
    schema = run(rows.limit(0)).select(*fields).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for part in range(parts):
        there = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path))
        own = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        own = own.join(read_csv(spark, path, schema).select(key), key, "left_anti") if there else own
        write_csv(run(own), fields, path, "append")
    return read_csv(spark, path, schema)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, decimals: int = 3) -> str:
    """An aggregated table as a markdown section. Only for tables of a few rows, such as a group x condition grid."""
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows.collect()]) + "\n"


def report(title: str, notes: list[str], sections: dict[str, DataFrame]) -> str:
    """A markdown report: title, notes, then a table for each section that has rows."""
    parts = [f"# {title}", "", *notes, ""]
    return "\n".join(parts + [markdown(rows, name) for name, rows in sections.items() if not rows.isEmpty()])


def create_tables(spark: SparkSession, folder: str) -> None:
    """Creates the three tables, empty, where they are not there yet, and their views; existing tables stay as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, schema in (("documents", schemas.DOCUMENTS), ("chunks", schemas.CHUNKS), ("facts", schemas.FACTS)):
        files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path(f"{folder}/{name}")):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    register_views(*[spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("documents", schemas.DOCUMENTS), ("chunks", schemas.CHUNKS), ("facts", schemas.FACTS))])


CITED = ("fact_id", "doc_name", "company", "fiscal_year", "row_label", "column_label", "value_raw", "signed", "scale", "unit", "page", "fact_text")


def facts_cited(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts with what a citation needs of their document."""
    return facts.join(documents.select("doc_id", "doc_name", "company", "fiscal_year"), "doc_id").select(*CITED)


def register_views(documents: DataFrame, chunks: DataFrame, facts: DataFrame) -> None:
    """Temp views of the three tables and facts_cited; may be called again."""
    for name, df in (("documents", documents), ("chunks", chunks), ("facts", facts), ("facts_cited", facts_cited(documents, facts))):
        df.createOrReplaceTempView(name)
