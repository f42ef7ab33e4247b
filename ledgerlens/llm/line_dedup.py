"""Line-run dedup: repeated runs of lines keep their first copy. DataFrame functions only.

Suffixes of the line sequences are ordered by prefix doubling: a suffix's rank is how many suffixes come before it in the
order of their first h lines; the pair of ranks at a position and h lines on orders it by 2h lines. Suffixes whose h lines
occur nowhere else have no part in any interval of the array with such a common prefix, so they leave it, and each round has
fewer rows than the one before. A run counts when it has min_words words or more: every run that occurs twice is covered by
shortest windows of min_words words that start or end on its lines. The interval of suffixes with a common prefix of n lines
is that of equal ranks by the largest power of two at both ends of the n lines; windows in an interval of two or more are
copies of its first position. They mark their lines, and neighbouring marks with one source make a maximal run. A line has a
word at least, so rounds never exceed log2(min_words).

Lines are compared without white space at their ends; blank lines are not part of the sequence. Order is (id, line).
Distinct keys are counted, dealt by ranges and summed up range by range, then joined back, so a line in a third of all rows
meets nowhere in one task; windows run within the repeated lines of one document.

Edge cases: null or empty text has no lines; a null id orders first; equal rows count as one; rows with the same id and
other text are documents of their own; an empty table gives an empty result; other columns are ignored (or kept by
dedup_lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, plain_columns, running_sum, shuffle_partitions, small, write_table

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Classes up to which their table is broadcast.
CLASS_ROWS = 150_000
DOC = ["doc", "tie"]


def _position(seq: Column | str = "seq") -> Column:
    return F.struct("doc", "tie", (F.col(seq) if isinstance(seq, str) else seq).alias("seq"))


def line_table(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, tie (a hash that tells documents of one id apart), seq (among lines with words), line (in the text), body."""
    source = documents.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    source = source.withColumn("tie", F.xxhash64("text"))
    if source.groupBy(*DOC).count().where("count > 1").limit(1).count():
        source = source.dropDuplicates(DOC)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(" \t\r\x0b\x0c")).alias("body")))
    return source.select("doc", "tie", F.posexplode(F.filter(lines, lambda x: x["body"] != "")).alias("seq", "x")).select("doc", "tie", "seq", "x.line", "x.body")


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """rows (doc, tie, seq, *keys) whose keys occur at two positions at least, with rank: how many of these come before in the order of the keys."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    # Written as they are dealt, so a range stays what it is; the join deals both sides anew and Spark can split a hot line.
    classes = scratch.write(classes.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).withColumn("range", F.spark_partition_id()), "line-classes")
    few = classes.count() <= CLASS_ROWS
    placed = running_sum(classes, [], "range", keys, "n", "upto").select(*[F.col(k).alias(f"of_{k}") for k in keys], (F.col("upto") - F.col("n")).alias("rank"))
    return rows.join(F.broadcast(placed) if few else placed, [F.col(k) == F.col(f"of_{k}") for k in keys]).select("doc", "tie", "seq", *[c for c in rows.columns if c not in ("doc", "tie", "seq", *keys)], "rank")


def _doubled(ranks: DataFrame, lines: int, scratch: Scratch) -> DataFrame:
    """Ranks by 2 * lines from those by lines. A gap on the way means that some window between is unique, and so is the whole."""
    ahead = Window.partitionBy(*DOC).orderBy("seq")
    pairs = ranks.select("doc", "tie", "seq", F.col("rank").alias("x"), F.lead("rank", lines).over(ahead).alias("y"), F.lead("seq", lines).over(ahead).alias("at"))
    return _ranked(pairs.where(F.col("at") == F.col("seq") + lines).drop("at"), ["x", "y"], scratch)


def _later(windows: DataFrame, ranks: DataFrame, lines: int, scratch: Scratch) -> DataFrame:
    """The windows (doc, tie, seq, length) that are not the first of their interval, with name: the position that is. lines <= length < 2 * lines."""
    ends = _on(_on(windows, ranks, F.lit(0), "x"), ranks, F.col("length") - lines, "y")
    intervals = ends.groupBy("length", "x", "y").agg(F.min(_position()).alias("name"), F.count("*").alias("n")).where("n > 1")
    keys = ["length", "x", "y"]
    intervals = small(scratch.write(intervals.select(*[F.col(k).alias(f"of_{k}") for k in keys], "name"), "line-intervals"), CLASS_ROWS)
    return ends.join(intervals, [F.col(k) == F.col(f"of_{k}") for k in keys]).where(_position() != F.col("name")).select("doc", "tie", "seq", "length", "name")


def _on(left: DataFrame, right: DataFrame, shift: Column, out: str) -> DataFrame:
    """left with the rank that right has at seq + shift of the same document."""
    there = right.select(F.col("doc").alias("doc_r"), F.col("tie").alias("tie_r"), F.col("seq").alias("seq_r"), F.col("rank").alias(out))
    return left.join(there, F.col("doc").eqNullSafe(F.col("doc_r")) & (F.col("tie") == F.col("tie_r")) & (F.col("seq") + shift == F.col("seq_r"))).drop("doc_r", "tie_r", "seq_r")


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line of a later copy: doc, tie, seq, line, words, source (position of the run's first copy) and offset."""
    scratch = Scratch(documents.sparkSession)
    lines = line_table(documents, id_col, text_col)
    ids = lines.select("doc", "tie", "seq", "line", F.xxhash64("body").alias("a"), F.xxhash64(F.lit(7), "body").alias("b"), F.regexp_count("body", F.lit(WORD)).cast("long").alias("words"))
    again = _ranked(ids, ["a", "b"], scratch)
    # Stretches of neighbouring repeated lines with enough words.
    by_doc = Window.partitionBy(*DOC).orderBy("seq")
    again = again.withColumn("stretch", F.col("seq") - F.row_number().over(by_doc))
    stretch = Window.partitionBy(*DOC, "stretch")
    again = again.withColumn("all", F.sum("words").over(stretch)).where(F.col("all") >= min_words).drop("all")
    upto = F.sum("words").over(stretch.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    again, _ = write_table(again.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")), "line-repeats")

    last = F.max("upto").over(stretch)
    forward = F.count("*").over(stretch.orderBy("before").rangeBetween(0, min_words - 1))
    backward = F.count("*").over(stretch.orderBy("upto").rangeBetween(1 - min_words, 0))
    found = again.select("doc", "tie", "seq", F.when(last - F.col("before") >= min_words, forward).alias("ahead"), F.when(F.col("upto") >= min_words, backward).alias("back"))
    windows = found.where("ahead is not null").select("doc", "tie", "seq", F.col("ahead").alias("length"))
    windows = windows.union(found.where("back is not null").select("doc", "tie", (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("length"))).distinct()
    windows = scratch.write(windows, "line-windows")
    longest = windows.agg(F.max("length")).first()[0] or 0

    lines, ranks, copies = 1, again.select("doc", "tie", "seq", "rank"), None
    while lines <= longest:
        later = _later(windows.where((F.col("length") >= lines) & (F.col("length") < 2 * lines)), ranks, lines, scratch)
        copies = later if copies is None else copies.unionByName(later)
        if 2 * lines <= longest:
            ranks = scratch.write(_doubled(ranks, lines, scratch), "line-ranks")
        lines *= 2
    none = again.select("doc", "tie", "seq", F.lit(0).alias("length"), _position().alias("name")).limit(0)
    copies, _ = write_table(none if copies is None else copies, "line-copies")
    scratch.drop()

    marks = copies.select("doc", "tie", F.explode(F.sequence(F.col("seq").cast("int"), (F.col("seq") + F.col("length") - 1).cast("int"))).alias("at"), F.struct(F.col("name.doc").alias("doc"), F.col("name.tie").alias("tie"), (F.col("name.seq") - F.col("seq")).alias("offset")).alias("source"))
    marks = marks.groupBy(*DOC, "at").agg(F.min("source").alias("source"))
    marks = marks.select(F.col("doc").alias("doc_m"), F.col("tie").alias("tie_m"), "at", "source")
    return again.select("doc", "tie", "seq", "line", "words").join(marks, F.col("doc").eqNullSafe(F.col("doc_m")) & (F.col("tie") == F.col("tie_m")) & (F.col("seq") == F.col("at"))).drop("doc_m", "tie_m", "at")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs that repeat earlier ones: id, start_line, n_lines, n_words, source id and source_start_line (lines with words, from 0)."""
    lines = repeated_lines(documents, min_words, id_col, text_col)
    same = Window.partitionBy(*DOC, "source").orderBy("seq")
    runs = lines.withColumn("run", F.col("seq") - F.row_number().over(same)).groupBy(*DOC, "source", "run")
    runs = runs.agg(F.min("seq").alias("start"), F.count("*").alias("n_lines"), F.sum("words").alias("n_words"))
    return runs.select(F.col("doc").alias(id_col), F.col("start").cast("long").alias("start_line"), "n_lines", "n_words", F.col("source.doc").alias(f"source_{id_col}"), (F.col("start") + F.col("source.offset")).cast("long").alias("source_start_line"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines of later copies taken out of their text; all columns stay, and so does every row.

    Rows of one id and text are one document and lose the same lines; rows of one id and other texts are told apart by their
    text, rows without an id come first in order. A null text stays null.
    """
    given, documents = documents, plain_columns(documents, (id_col, text_col))
    marked = repeated_lines(documents, min_words, id_col, text_col).groupBy(*DOC).agg(F.collect_set("line").alias("__out"))
    marked = marked.select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), "__out")
    joined = documents.join(marked, documents[id_col].eqNullSafe(F.col("__doc")) & (F.xxhash64(documents[text_col].cast("string")) == F.col("__tie")), "left")
    rest = F.array_join(F.filter(F.split(documents[text_col], "\n"), lambda x, i: ~F.array_contains(F.col("__out"), i)), "\n")
    return joined.select(*[F.when(F.col("__out").isNotNull(), rest).otherwise(documents[c]).alias(c) if c == text_col else documents[c] for c in documents.columns]).toDF(*given.columns)
