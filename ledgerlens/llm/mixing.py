"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source are put in a pseudo-random order (a digest of the id and the seed) and repeated epochs times. A
copy's virtual finish time is the number of its source's tokens up to and including it, divided by the source's weight.
All copies are ranged by virtual finish time and the sequence is cut where it reaches the total budget. A source that
runs out of copies simply stops, so the others take its share by weight: the cut is the water-filling point, and the
target of each source is the closed form of that point.

The running sums go through ranges of the (uniform) digest, so a source with a third of all rows is spread over many
tasks; only the one range of finish times that holds the cut is sorted. The table of sources, one row each, is ranked
in one task: sources are a configured dimension, not rows of the corpus.

Edge cases: null text has size 0; a null source is a source of its own, last in order; size 0 takes nothing; rows of
the same id and size share their decision only if equal in all that orders them; rows without an id are ordered by a digest
of their text and source; an empty table gives an empty result; a corpus without words has targets 0. Other columns pass
through mixed_documents, where a number for each row decides between rows of the same id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ROW, plain_columns, running_sum, shuffle_partitions, small, with_row_key, write_table

WORD = r"[^\x20\x09-\x0D]+"
#: The order digest has this many bits.
BITS = 48


def order_digest(key: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, weight, target and level (the virtual time of the cut) from (source, source_size)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * float(epochs)).withColumn("runs_out", F.col("most") / F.col("weight"))
    order = Window.orderBy("runs_out", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    left = budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    found = ranked.withColumn("budget", budget).withColumn("at", left / weight_left)
    level = F.min(F.when(F.col("at") <= F.col("runs_out"), F.struct("runs_out", "at"))).over(everything)["at"]
    found = found.withColumn("level", F.coalesce(level, F.max("runs_out").over(everything)))
    return found.select("source", "source_size", "weight", F.least("most", F.col("weight") * F.col("level")).alias("target"), "level", "budget")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken (tokens the mix takes, repeats counted) and copies, one row per document.

    epochs is 2: a document is taken not at all, once or twice. row_col, a number for each row, is the last to order by
    and is returned too.
    """
    if epochs != 2:
        raise ValueError("a document can be taken twice at most")
    spark = documents.sparkSession
    key = [] if row_col is None else ["row_key"]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col, source_col).alias("unnamed"), *[F.col(row_col).alias(k) for k in key])
    base, _ = write_table(base.withColumn("digest", order_digest(F.coalesce(F.col("doc_id").cast("string"), F.col("unnamed").cast("string")), seed)).drop("unnamed"), "mix-sizes")
    rows = base.count()
    per_range = max(64, rows // (16 * shuffle_partitions(spark)))
    bits = min(24, max(0, (rows // per_range).bit_length()))  # 2 ** bits ranges of the digest

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, _ = write_table(source_targets(sizes, weights, share, epochs), "mix-targets")
    cut = targets.agg(F.max("level").alias("level"), F.max("budget").alias("budget")).first()
    level, budget = cut["level"] or 0.0, cut["budget"] or 0.0

    ranged = base.withColumn("part", F.shiftright("digest", BITS - bits))
    queued = running_sum(ranged, ["source"], "part", ["digest", "doc_id", "size", *key], "size", "tokens")
    known = F.broadcast(targets) if targets.count() <= 100_000 else targets
    queued = queued.join(known.withColumnRenamed("source", "of"), queued["source"].eqNullSafe(F.col("of")), "left")
    ranges = 1 << bits
    queued = queued.withColumns({"first": F.col("tokens") / F.col("weight"), "second": (F.col("tokens") + F.col("source_size")) / F.col("weight")})
    place = lambda c: F.least(F.floor(F.col(c) / F.lit(level or 1.0) * ranges), F.lit(4 * ranges)).cast("long")
    queued, _ = write_table(queued.withColumns({"first_range": place("first"), "second_range": place("second")}).select("doc_id", "size", "digest", "source_size", "target", "first", "second", "first_range", "second_range", *key), "mix-queue")

    copies = queued.select("doc_id", "size", "digest", *key, F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("first").alias("finish"), F.col("first_range").alias("range")), F.struct(F.lit(1).alias("copy"), F.col("second").alias("finish"), F.col("second_range").alias("range")))).alias("c")).select("doc_id", "size", "digest", *key, "c.*")
    sums = copies.groupBy("range").agg(F.sum("size").alias("sum"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    crossing = sums.withColumn("upto", F.sum("sum").over(upto)).where(F.col("upto") > budget).orderBy("range").first()
    last, before = (crossing["range"], crossing["upto"] - crossing["sum"]) if crossing else (8 * ranges, 0)
    inside = copies.where(F.col("range") == last)
    order = ["finish", "digest", "doc_id", "copy", *key]
    running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    final = inside.withColumn("upto", running).where(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("end")).first()["end"] if crossing else None

    def taken(finish: str, place: str, copy: int) -> Column:
        whole = F.col(place) < last
        if final is None:
            return whole.cast("long")
        end = F.struct(F.lit(final["finish"]).cast("double").alias("a"), F.lit(final["digest"]).cast("long").alias("b"), F.lit(final["doc_id"]).cast(base.schema["doc_id"].dataType).alias("c"), F.lit(final["copy"]).alias("d"), *[F.lit(final[k]).cast("long").alias("e") for k in key])
        own = F.struct(F.col(finish).alias("a"), F.col("digest").alias("b"), F.col("doc_id").alias("c"), F.lit(copy).alias("d"), *[F.col(k).alias("e") for k in key])
        return (whole | ((F.col(place) == last) & (own <= end))).cast("long")

    queued = queued.withColumn("copies", taken("first", "first_range", 0) + taken("second", "second_range", 1))
    return queued.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col(k).alias(row_col) for k in key])


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Ids may be null or repeated: every row is counted and taken for itself, equal rows too, each twice at most. All columns
    stay, whatever their names.
    """
    needed = (id_col, options.get("text_col", "text"), options.get("source_col", "source"))
    keyed = with_row_key(plain_columns(documents, needed))
    taken = mix_sources(keyed, id_col=id_col, row_col=ROW, **options).where("copies > 0").select(F.col(ROW).alias("__taken_row"), F.col("copies").cast("int").alias("__copies"))
    joined = keyed.join(small(taken), keyed[ROW] == F.col("__taken_row"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[keyed[c] for c in keyed.columns if c != ROW]).toDF(*documents.columns)
