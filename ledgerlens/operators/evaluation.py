"""Retrieval and answer metrics, aggregated by group and condition."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import any_figure, numbers, same_figure, trigrams

KS = (1, 5, 10, 20)
#: Evidence texts whose trigrams a task looks up at once.
BLOCK_EVIDENCE = 20_000
WORDS = re.compile("[a-z0-9]+")


def classify(answer: Column, evidence: Column) -> Column:
    """narrative: the answer has no number; direct: one of its numbers is in the evidence; else computed."""
    said = numbers(answer)
    return F.when(F.size(said) == 0, "narrative").when(any_figure(said, numbers(evidence)), "direct").otherwise("computed")


def first_rank(hits: DataFrame, relevant: Column) -> DataFrame:
    """(qid, rank): the first rank at which a hit is relevant, null if none is."""
    return hits.groupBy("qid").agg(F.min(F.when(relevant, F.col("rank"))).alias("rank"))


def rank_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, recall at each k and MRR of (rank) rows; a null rank is a miss."""
    recall = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}") for k in KS]
    mrr = F.round(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) / F.count("*"), 6).alias("mrr")
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, mrr)


def overlaps(evidence: DataFrame, passages: DataFrame, e_id: str, p_id: str, e_text: str = "text", p_text: str = "text", threshold: float = 0.0, best_only: bool = False) -> DataFrame:
    """(e_id, p_id, overlap): the share of the evidence's trigrams in the passage, for pairs with one in common.

    Tasks give only pairs whose share reaches the threshold; with best_only each gives no more than the best pair of each
    evidence (the smallest p_id of equals), which is enough for best_overlap.

    The evidence is a small table: it is broadcast in blocks of BLOCK_EVIDENCE as an index of its trigrams, and passages are
    looked up where they stand, so no trigram of theirs is shuffled.
    """
    kinds = {"e": evidence.schema[e_id].dataType, "p": passages.schema[p_id].dataType}
    listed = evidence.select(F.col(e_id), trigrams(F.col(e_text)).alias("grams")).where(F.size("grams") > 0).toLocalIterator()
    source, found = passages.select(F.col(p_id), F.col(p_text).cast("string")), None
    while block := list(islice(listed, BLOCK_EVIDENCE)):
        index: dict[str, list[int]] = {}
        for place, row in enumerate(block):
            for gram in row["grams"]:
                index.setdefault(gram, []).append(place)
        shared = passages.sparkSession.sparkContext.broadcast((index, [r[e_id] for r in block], [len(r["grams"]) for r in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names, sizes = shared.value
            types = [to_arrow_type(kinds["e"]), to_arrow_type(kinds["p"]), pa.int64(), pa.int64()]
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["e", "p", "common", "n"])
            best: dict[int, tuple] = {}
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for key, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                    words = WORDS.findall((text or "").lower())
                    common = Counter(e for gram in {f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)} if gram in index for e in index[gram])
                    for e, n in common.items():
                        if round(n / sizes[e], 6) >= threshold:
                            if not best_only:
                                rows.append((names[e], key, n, sizes[e]))
                            elif e not in best or (-n, key) < best[e]:
                                best[e] = (-n, key)
                if rows:
                    yield made(rows)
            if best:
                yield made([(names[e], key, -n, sizes[e]) for e, (n, key) in best.items()])

        pairs = source.mapInArrow(run, f"e {kinds['e'].simpleString()}, p {kinds['p'].simpleString()}, common long, n long")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = passages.sparkSession.createDataFrame([], f"e {kinds['e'].simpleString()}, p {kinds['p'].simpleString()}, common long, n long")
    return found.select(F.col("e").alias(e_id), F.col("p").alias(p_id), F.round(F.col("common") / F.col("n"), 6).alias("overlap"))


def best_overlap(pairs: DataFrame, e_id: str, p_id: str) -> DataFrame:
    """The best overlap of each evidence and the first passage that has it."""
    top = F.max_by(F.struct("overlap", p_id), F.struct("overlap", -F.col(p_id)))
    return pairs.groupBy(e_id).agg(top.alias("t")).select(e_id, F.col("t.overlap").alias("best"), F.col(f"t.{p_id}").alias("best_id"))


def at_index(rows: DataFrame, value: str, share: float) -> DataFrame:
    """(value): the one at the floor index share * (n - 1) of the sorted values. What is sorted are distinct values with their counts."""
    counted = rows.groupBy(value).agg(F.count("*").alias("rows"))
    order = Window.orderBy(value)
    placed = counted.withColumns({"upto": F.sum("rows").over(order), "all": F.sum("rows").over(Window.partitionBy())})
    return placed.where(F.col("upto") > F.floor(F.lit(share) * (F.col("all") - 1))).agg(F.min(value).alias(value))


def overlap_summary(best: DataFrame, threshold: float = 0.25) -> DataFrame:
    """n, hit rate at the threshold, interpolated median and the 90th percentile by floor index.

    Overlaps have six decimals, so there are a million distinct ones at most.
    """
    found = best.agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") >= threshold).cast("double")), 6).alias("hit_rate"), F.round(F.median("best"), 6).alias("median"))
    return found.join(F.broadcast(at_index(best, "best", 0.9).withColumnRenamed("best", "p90")))


#: Scales at which a figure may be stated, and how far apart two at that scale may be.
BANDS = ((1.0, 0.01), (1000.0, 0.01), (0.001, 1e-6))


def figure_matches(questions: DataFrame, facts: DataFrame, value: str = "value", key: str = "fact_id") -> DataFrame:
    """All targets against all facts: (qid, target, n_facts, first_fact), how many facts have a target's figure at any scale and the first of them.

    questions: qid, targets (array); facts: key and value, whose sign is left aside. A band join: distinct values fall into
    buckets as wide as the largest distance, distinct targets look into those around each of their scales, and are compared
    exactly after that. Values and targets are made distinct first, so a figure that very many have meets itself once. No side
    is broadcast, whatever its compressed size: the driver would hold all of it.
    """
    width = max(apart for _, apart in BANDS)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    held = facts.select(F.abs(F.col(value).cast("double")).alias("v"), F.col(key).alias("k")).where("v is not null and not isnan(v)")
    held = held.groupBy("v").agg(F.count("*").alias("n"), F.min("k").alias("first")).withColumn("bucket", bucket(F.col("v")))
    asked = questions.select("qid", F.explode(F.array_distinct("targets")).alias("target"))
    levels = F.explode(F.array(*[F.col("target") * scale for scale, _ in BANDS]))
    looked = asked.select("target").distinct().select("target", levels.alias("level"))
    looked = looked.select("target", F.explode(F.array(*[bucket(F.col("level")) + k for k in (-1, 0, 1)])).alias("bucket")).distinct()
    pairs = looked.join(held.hint("merge"), "bucket").where(same_figure(F.col("target"), F.col("v")))
    found = pairs.groupBy("target").agg(F.sum("n").alias("n_facts"), F.min("first").alias("first_fact"))
    return asked.join(found.hint("merge"), "target", "left").select("qid", "target", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "first_fact")


def coverage(wanted: Column, found: Column) -> Column:
    """The share of wanted figures that are among those found, at any of three scales; null without wanted ones."""
    hit = F.filter(wanted, lambda w: F.exists(found, lambda f: same_figure(w, f)))
    return F.try_divide(F.size(hit).cast("double"), F.size(wanted))


def coverage_metrics(rows: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """any@k, all@k and the mean coverage at the largest k, from columns cov1, cov5, ...; null counts as 0."""
    share = lambda test, name: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6).alias(name)
    made = [share(F.col(f"cov{k}") > 0, f"any{k}") for k in ks] + [share(F.col(f"cov{k}") >= 0.999, f"all{k}") for k in ks]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *made, F.round(F.avg(F.coalesce(F.col(f"cov{ks[-1]}"), F.lit(0.0))), 6).alias(f"mean{ks[-1]}"))


#: Outcomes in the order in which a report lists them.
OUTCOMES = ("correct", "wrong", "ungrounded", "refused", "unscored", "error")


def outcome_shares(rows: DataFrame, group: str, outcome: str) -> DataFrame:
    """Count of each outcome in each group, and its share of the group."""
    counted = rows.groupBy(group, outcome).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def headline(rows: DataFrame, group: str = "group", outcome: str = "outcome", seconds: str = "seconds") -> DataFrame:
    """What counts on direct questions: correct, wrong (ungrounded ones too) and refused; median and total of the seconds of all."""
    direct = F.col(group) == "direct"
    counts = [F.count_if(direct & F.col(outcome).isin(*kinds)).alias(name) for name, kinds in (("correct", ["correct"]), ("wrong", ["wrong", "ungrounded"]), ("refused", ["refused"]))]
    return rows.agg(F.count_if(direct).alias("n_direct"), *counts, F.round(F.median(seconds), 6).alias("median_seconds"), F.round(F.sum(seconds) / 3600, 6).alias("hours"))


def place_of(column: str, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order, for sorting reports."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))


def conditions(questions: DataFrame) -> DataFrame:
    """questions (qid, oracle_doc, routed_company, routed_year, ...) under three conditions, with the filters of each.

    oracle: only the filing that the label names; routed: the company and year read from the question; corpus: no filter.
    """
    kinds = F.explode(F.array(*[F.lit(c) for c in ("oracle", "routed", "corpus")])).alias("condition")
    on = lambda condition, column: F.when(F.col("condition") == condition, F.col(column))
    out = questions.select("*", kinds)
    out = out.withColumns({"q_doc_name": on("oracle", "oracle_doc"), "q_company": on("routed", "routed_company"), "q_fiscal_year": on("routed", "routed_year")})
    return out.withColumns({"question_id": F.col("qid"), "qid": F.concat_ws("/", F.col("qid").cast("string"), "condition")})


def first_fits(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each question (qid, targets) the hit (qid, rank, signed, ...) with the first value that matches; none without one."""
    joined = hits.join(asked.select("qid", "targets"), "qid")
    fits = joined.where(any_figure(F.col("targets"), F.array(F.abs(F.col("signed").cast("double")))))
    return fits.groupBy("qid").agg(F.min_by(F.struct(*[c for c in hits.columns if c != "qid"]), "rank").alias("f")).select("qid", "f.*")


def score_direct(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each question (qid, targets) the first fact whose value matches: (qid, rank, score, matched, page, found_doc, expected, found).

    hits: qid, rank, score, signed, fact_text, page, doc_name; those that first_fits leaves are enough.
    """
    first = first_fits(asked, hits).select("qid", "rank", F.round("score", 4).alias("score"), F.col("fact_text").alias("matched"), "page", F.col("doc_name").alias("found_doc"), F.abs(F.col("signed").cast("double")).alias("found"))
    return asked.select("qid", F.array_min("targets").alias("expected")).join(first, "qid", "left")


def score_computed(asked: DataFrame, hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, n_inputs, cov1, cov5, ...): the share of the evidence's numbers (wanted) among the values of the first k facts."""
    value = F.abs(F.col("signed").cast("double"))
    found = hits.groupBy("qid").agg(*[F.collect_set(F.when(F.col("rank") <= k, value)).alias(f"found{k}") for k in ks])
    joined = asked.select("qid", "wanted").join(found, "qid", "left")
    none = F.array().cast("array<double>")
    return joined.select("qid", F.size("wanted").cast("long").alias("n_inputs"), *[F.round(coverage(F.col("wanted"), F.coalesce(f"found{k}", none)), 6).alias(f"cov{k}") for k in ks])


def _grams(text: str | None) -> Iterator[tuple[str, str, str]]:
    words = WORDS.findall((text or "").lower())
    return zip(words, words[1:], words[2:], strict=False)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of an evidence's trigrams (the column before the last) in a text (the last); 0 without any."""
    last, grams = None, set()
    for batch in batches:
        out = []
        for evidence, text in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if evidence != last:
                last, grams = evidence, set(_grams(evidence))
            out.append(len(grams.intersection(_grams(text))) / len(grams) if grams else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.float64())], ["qid", "rank", "page", "found_doc", "overlap"])


def score_narrative(asked: DataFrame, hits: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(qid, best_overlap, rank, page, found_doc): the first hit with the best share of the evidence's trigrams; rank from the threshold on.

    hits: qid, rank, text, page_start, doc_name. An overlap of 0 has no page and document.
    """
    wanted = asked.select("qid", "evidence_text")
    kinds = {c: hits.schema[c].dataType for c in ("qid", "rank", "page_start", "doc_name")}
    # A number of partitions that stays: texts are short of bytes for the work that they make. A question's hits are in a row.
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = hits.select("text", *kinds).join(wanted, "qid").repartition(parts, "qid").sortWithinPartitions("qid").select(*kinds, "evidence_text", "text")
    shape = [f"{name} {kind.simpleString()}" for name, kind in zip(("qid", "rank", "page", "found_doc"), kinds.values(), strict=True)]
    scored = joined.mapInArrow(_shares, ", ".join([*shape, "overlap double"]))
    best = scored.where("overlap > 0").groupBy("qid").agg(F.max_by(F.struct("overlap", "rank", "page", "found_doc"), F.struct("overlap", -F.col("rank"))).alias("b"))
    out = asked.select("qid").join(best, "qid", "left")
    rank = F.when(F.col("b.overlap") >= threshold, F.col("b.rank"))
    return out.select("qid", F.round(F.coalesce("b.overlap", F.lit(0.0)), 4).alias("best_overlap"), rank.alias("rank"), "b.page", "b.found_doc")


def found_split(rows: DataFrame) -> DataFrame:
    """Sentences (four words or more) and bare figures among direct answers: n, how many were found, and their share."""
    kind = F.when(F.col("answer_words") >= 4, "sentence").otherwise("figure")
    return rows.groupBy(kind.alias("answer")).agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count("*"), 6).alias("share"))


def input_counts(rows: DataFrame, k: int = max(KS)) -> DataFrame:
    """Median and largest number of inputs of computed questions that have some, and how many need more than k."""
    some = rows.where("n_inputs > 0")
    return some.agg(F.count("*").alias("n"), F.round(F.median("n_inputs"), 6).alias("median_inputs"), F.max("n_inputs").alias("most_inputs"), F.count_if(F.col("n_inputs") > k).alias("over_k"))


def subset(questions: DataFrame, key: str, group: str | None = None, ids: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The questions of a group, or with given ids; then limit of them from offset on, in the order of the key."""
    out = questions
    if group is not None:
        out = out.where(F.col("group") == group)
    if ids is not None:
        out = out.where(F.col(key).isin(*ids)) if ids else out.limit(0)
    if limit is not None or offset:
        out = out.orderBy(key)
        out = out.offset(offset) if offset else out
        out = out if limit is None else out.limit(limit)
    return out


def check_split(counts: dict[str, int], expected: dict[str, int]) -> None:
    """Fails when the groups of a question set are not as many as they should be."""
    if counts != expected:
        raise ValueError(f"groups are {counts}, not {expected}")
