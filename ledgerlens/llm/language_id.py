"""Language identification by Bayesian fusion of evidence.

log posterior(l) = host prior(l) + log P(declared | l) + log P(suffix | l) + TEMPER * log P(text | l), over the known
languages and "und" (text like none of them).

- Text: hashed byte trigrams of the whole text, naive Bayes. The model is fitted on about TRAIN_ROWS labelled rows (those
  with a declared language; the size of the sample is a parameter) and knows their most frequent labels (a parameter too). A row
  of the sample is judged by a model of the sample's other half, so no row's label speaks through the model of its text.
  "und" gives every trigram the same small probability.
- Declared language and address suffix: their likelihoods are the smoothed shares among all rows that the text alone
  gives to a language, so a declaration counts for as much as it turns out to be worth.
- Host priors: counts of the text's decisions by grouped aggregation, over all rows, smoothed from host to domain to the
  whole corpus, each without the row's own decision. Only one row per host is joined back, so a host with a third of all
  rows is not gathered anywhere.

A row is kept when its best language is not "und" and reaches min_confidence. Edge cases: null or empty text, and text
without letters, is judged by the other evidence; a null declaration, host or suffix is a value of its own that says what it
says of the others; repeated rows are judged alike, rows of one id each by itself; without labelled rows every row is "und";
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, small, write_table
from .wordhash import text_chunks

#: Labelled rows that the model is fitted on, about, and the labels that it knows at most: defaults of parameters.
TRAIN_ROWS, MAX_LANGUAGES = 20_000, 256
BUCKETS = 1 << 16
#: Trigrams of one text overlap, so their evidence is discounted; nats that "und" pays for a trigram; prior of "und".
TEMPER, UNKNOWN_NATS, UNKNOWN_PRIOR = 0.25, 9.5, 0.01
#: Bytes of host counts up to which their table is broadcast.
HOST_BYTES = 64 << 20
#: Pseudo-counts of the parent level, and of a declaration or suffix.
KAPPA, SMOOTH = 10.0, 1.0

_shape = np.arange(256, dtype=np.uint32)
_shape[:128] = 32
_shape[97:123] = np.arange(97, 123)
_shape[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and where each text's begin; texts end as at a space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    shape = _shape[data]
    left, right = np.empty(n, np.uint32), np.empty(n, np.uint32)
    left[1:], left[0], right[:-1], right[-1] = shape[:-1], 32, shape[1:], 32
    inner = offsets[(offsets > 0) & (offsets < n)]
    left[inner] = 32
    right[inner - 1] = 32
    at = np.flatnonzero(shape != 32)
    code = (left[at] * np.uint32(0x9E3779B1)) ^ (shape[at] * np.uint32(0x85EBCA77)) ^ (right[at] * np.uint32(0xC2B2AE3D))
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, fold, bucket, n) of the labelled texts of a partition."""
    totals: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        labels, folds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for first, last, data, offsets in text_chunks(batch.column(0)):
            grams, begin = trigrams(data, offsets)
            for k in range(first, last):
                own = grams[begin[k - first] : begin[k - first + 1]]
                table = totals.setdefault((labels[k], folds[k]), np.zeros(BUCKETS, np.int64))
                table += np.bincount(own, minlength=BUCKETS)
    for (label, fold), counts in totals.items():
        there = np.flatnonzero(counts)
        n = len(there)
        yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.string()), pa.array(np.full(n, fold, np.int32)), pa.array(there.astype(np.int32)), pa.array(counts[there])], ["label", "fold", "bucket", "n"])


def sample_fold(key: str, total: int, limit: int) -> Column:
    """-1 for a row outside the sample, else its half (0 or 1): of total labelled rows a hash of the key takes limit on average."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return F.when(place < int((1 << 30) * min(1.0, limit / max(1, total))), F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2))).otherwise(-1).cast("int")


def fit(rows: DataFrame, max_languages: int | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and, for the models that leave out half 0, half 1 and nothing, the log probability of each bucket in each.

    rows: (text, label, fold), those of the sample.
    """
    known = [r["label"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_languages or MAX_LANGUAGES).collect()]
    languages = sorted(known)
    own = rows.where(F.col("label").isin(*languages)) if languages else rows.limit(0)
    counts = map_arrow(own.select("text", "label", "fold"), _count, "label string, fold int, bucket int, n long").groupBy("label", "fold", "bucket").agg(F.sum("n").alias("n")).toPandas()
    halves = np.zeros((2, len(languages), BUCKETS))
    for k, language in enumerate(languages):
        for fold in (0, 1):
            own = counts[(counts["label"] == language) & (counts["fold"] == fold)]
            halves[fold, k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    tables = np.stack((halves[1], halves[0], halves.sum(axis=0))) + 0.05
    return languages, np.log(tables / tables.sum(axis=2, keepdims=True)).astype(np.float32)


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, min_confidence: float = 0.5, train_rows: int = TRAIN_ROWS, sample_col: str | None = None, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """id, language, confidence, text_language (of the text alone) and kept, one row per input row.

    sample_col is the column whose hash takes the training sample, the id by default; a row without one is taken by its
    text. The model knows the max_languages most frequent labels of the sample; memory grows with them (0.8 MB each).
    """
    spark = documents.sparkSession
    none = F.lit(None).cast("string")
    parts = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    key = F.col(sample_col or id_col)
    label = F.when(F.col(text_col).isNotNull(), none if declared is None else declared.cast("string"))
    total_labelled = documents.where(label.isNotNull()).count()
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[(none if c is None else c.cast("string")).alias(k) for k, c in parts.items()], key.alias("key"), label.alias("label"))
    source = source.withColumn("fold", F.when(F.col("label").isNull(), F.lit(-1)).when(F.col("key").isNull(), sample_fold("text", total_labelled, train_rows)).otherwise(sample_fold("key", total_labelled, train_rows)))
    languages, tables = fit(source.where("fold >= 0"), max_languages)
    model = spark.sparkContext.broadcast(tables)
    size = len(languages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                grams, begin = trigrams(data, offsets)
                rows = batch.slice(first, last - first)
                fold = rows.column(6).to_numpy()
                likely = np.empty((last - first, size + 1))
                lengths = np.diff(begin)
                for which in np.unique(fold):
                    own = np.flatnonzero(fold == which)
                    take = grams if len(own) == len(fold) else grams[np.repeat(fold == which, lengths)]
                    ends = np.concatenate(([0], np.cumsum(lengths[own])))
                    for k in range(size):
                        sums = np.concatenate(([0.0], np.cumsum(logs[which][k][take], dtype=np.float64)))
                        likely[own, k] = sums[ends[1:]] - sums[ends[:-1]]
                likely[:, size] = -UNKNOWN_NATS * lengths
                flat = pa.array(np.round(likely * TEMPER, 4).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (last - first + 1) * (size + 1), size + 1).astype(np.int32)), flat)
                best = likely.argmax(axis=1).astype(np.int32)
                best[lengths == 0] = -1
                yield pa.RecordBatch.from_arrays([rows.column(0), *[rows.column(c) for c in range(2, 6)], lists, pa.array(best)], ["id", "declared", "host", "domain", "suffix", "likely", "best"])

    kind = documents.schema[id_col].dataType.simpleString()
    judged = source.select("id", "text", *parts, "fold")
    scored, _ = write_table(map_arrow(judged, score, f"id {kind}, declared string, host string, domain string, suffix string, likely array<double>, best int"), "language-scores")
    counted = [F.sum((F.col("best") == k).cast("long")) for k in range(size)]
    tallies = [c.alias(f"n{k}") for k, c in enumerate(counted)] + [F.count("*").alias("rows")]
    total = scored.agg(*tallies).first()
    whole = [float(total[k] or 0) for k in range(size)]
    shares = [(x + 1.0) / (sum(whole) + size) for x in whole]
    gathered = lambda by, out: scored.groupBy(*by).agg((F.array(*counted) if size else F.array().cast("array<bigint>")).alias(out))
    hosts = gathered(["host", "domain"], "host_n")
    hosts = hosts.join(gathered(["domain"], "domain_n").withColumnRenamed("domain", "of"), F.col("domain").eqNullSafe(F.col("of")), "left").drop("of")
    hosts, _ = write_table(hosts, "language-hosts")

    def prior(k: int) -> Column:
        """The share of language k at the row's host, smoothed by its domain's and the whole corpus's, without the row itself."""
        own, any_own = (F.col("best") == k).cast("double"), (F.col("best") >= 0).cast("double")
        own = F.when(F.col("best") == size, 0.0).otherwise(own)
        any_own = F.when(F.col("best") == size, 0.0).otherwise(any_own)
        rows = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
        corpus = (F.lit(whole[k] + 1.0) - own) / (F.lit(sum(whole) + size) - any_own)
        by_domain = (F.col("domain_n")[k] - own + KAPPA * corpus) / (rows("domain_n") - any_own + KAPPA)
        return (F.col("host_n")[k] - own + KAPPA * by_domain) / (rows("host_n") - any_own + KAPPA)

    def likelihood(column: str) -> DataFrame:
        found = scored.groupBy(column).agg(*tallies)
        kinds = F.lit(float(max(1, found.count())))
        share = [(F.col(f"n{k}") + SMOOTH) / (F.lit(float(total[k] or 0)) + SMOOTH * kinds) for k in range(size)]
        return found.select(F.col(column).alias(f"{column}_of"), (F.array(*share) if size else F.array().cast("array<double>")).alias(f"{column}_given"))

    out = scored.join(small(hosts.withColumnsRenamed({"host": "host_of", "domain": "domain_of"}), HOST_BYTES // (16 * size + 100)), F.col("host").eqNullSafe(F.col("host_of")) & F.col("domain").eqNullSafe(F.col("domain_of")), "left")
    for column in ("declared", "suffix"):
        out = out.join(small(likelihood(column)), F.col(column).eqNullSafe(F.col(f"{column}_of")), "left")
    terms = [F.log((1 - UNKNOWN_PRIOR) * prior(k)) + F.log(F.col("declared_given")[k]) + F.log(F.col("suffix_given")[k]) + F.col("likely")[k] for k in range(size)]
    # A declaration or suffix says nothing about "und" texts: they get its share among all rows.
    mean = lambda c: sum((F.col(c)[k] * shares[k] for k in range(size)), F.lit(1e-12))
    terms.append(F.lit(float(np.log(UNKNOWN_PRIOR))) + F.log(mean("declared_given")) + F.log(mean("suffix_given")) + F.col("likely")[size])
    codes = F.array(*[F.lit(x) for x in [*languages, "und"]])
    out = out.select("id", "best", F.array(*terms).alias("logs"))
    out = out.withColumn("top", F.array_max("logs"))
    weight = F.aggregate("logs", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    out = out.select("id", codes[F.array_position("logs", F.col("top")).cast("int") - 1].alias("language"), F.round(1 / weight, 6).alias("confidence"), F.when(F.col("best") >= 0, codes[F.greatest("best", F.lit(0))]).alias("text_language"))
    kept = (F.col("language") != "und") & (F.col("confidence") >= min_confidence)
    return out.select(F.col("id").alias(id_col), "language", "confidence", "text_language", kept.alias("kept"))


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)</?[a-zA-Z!][^>]*>", " ")


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """Web pages: the language their markup declares, and host, domain and suffix of the address."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    texts = pages.withColumn("__text", page_text(F.col("html")))
    return identify(texts, "page_id", "__text", declared=F.when(declared != "", declared), host=F.when(host != "", host), domain=F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), suffix=F.regexp_extract(host, r"\.([^.]+)$", 1), **options)


def language_documents(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents: the declared language is lang, the host is source."""
    return identify(documents, id_col, "text", declared=F.col("lang"), host=F.col("source"), **options)
