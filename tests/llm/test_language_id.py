import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string"
PARTS = {"en": ["the", "th", "er", "on", "an", "ing", "and"], "de": ["der", "sch", "ung", "ein", "ich", "keit"], "fr": ["eau", "le", "oi", "tion", "eux", "qu"]}


def words(lang, n, rng):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def rows_of(n, seed=0):
    rng = random.Random(seed)
    return [(k, words(lang := rng.choice(list(PARTS)), rng.randrange(3, 60), rng), lang, f"{lang}-host" if k % 3 else "hot") for k in range(n)]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"best": F.lit("clash"), "prior": F.lit(0), "host": F.lit("x")})
    return {r["doc_id"]: r for r in language_id.language_documents(docs, **options).collect()}


def test_held_out_accuracy(spark):
    rows = rows_of(300)
    hidden = {k: lang for k, _, lang, _ in rows if k % 5 == 0}
    found = run(spark, [(k, t, None if k in hidden else lang, s) for k, t, lang, s in rows])
    assert sum(found[k]["language"] == lang for k, lang in hidden.items()) >= 0.98 * len(hidden)
    assert sum(found[k]["text_language"] == lang for k, lang in hidden.items()) >= 0.95 * len(hidden)
    assert sum(r["kept"] for r in found.values()) >= 0.99 * len(found)


def test_other_evidence_decides_where_the_text_does_not(spark):
    rows = [*rows_of(300), (1000, None, "de", "de-host"), (1001, "", None, "fr-host"), (1002, "123 456", "en", "en-host"), (1003, "語言識別測試文件" * 20, None, "en-host"), (1004, "語言識別測試文件" * 20, None, None)]
    found = run(spark, rows)
    assert [found[k]["language"] for k in (1000, 1001, 1002, 1003, 1004)] == ["de", "fr", "en", "und", "und"]
    assert found[1000]["text_language"] is None and not found[1003]["kept"] and found[1000]["kept"]


def test_unlabelled_repeated_and_empty_tables(spark):
    found = language_id.language_documents(spark.createDataFrame([(1, "the thing", None, "a"), (1, "the thing", None, "a")], SCHEMA)).collect()
    assert [(r["doc_id"], r["language"], r["kept"]) for r in found] == [(1, "und", False)] * 2
    assert language_id.language_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(400), SCHEMA).withColumn("fold", language_id.sample_fold("doc_id", 400, 150))
    halves = {r["fold"]: r["count"] for r in docs.groupBy("fold").count().collect()}
    assert 90 < halves[0] + halves[1] < 210 and min(halves[0], halves[1]) > 30
    names, tables = language_id.fit(docs.where("fold >= 0").select("text", F.col("lang").alias("label"), "fold"))
    assert names == ["de", "en", "fr"] and tables.shape == (3, 3, language_id.BUCKETS)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    most = [r["lang"] for r in docs.where("fold >= 0").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert language_id.fit(docs.where("fold >= 0").select("text", F.col("lang").alias("label"), "fold"))[0] == sorted(most)


def brute_force(rows, folds):
    """(language, confidence) of each row: the formula of the module's docstring in plain Python."""
    grams = []
    for _, text, _, _ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        grams.append(language_id.trigrams(raw, np.array([0, len(raw)]))[0].tolist())
    names = sorted({r[2] for r, f in zip(rows, folds, strict=True) if f >= 0})
    counts = {(n, f): Counter(g for row, fold, own in zip(rows, folds, grams, strict=True) if fold == f and row[2] == n for g in own) for n in names for f in (0, 1)}

    def model(left_out):
        out = {}
        for n in names:
            total = sum((counts[n, f] for f in (0, 1) if f != left_out), Counter())
            out[n] = (total, sum(total.values()) + 0.05 * language_id.BUCKETS)
        return out

    models = {f: model(f) for f in (-1, 0, 1)}
    likely, best = [], []
    for own, fold in zip(grams, folds, strict=True):
        scores = [sum(math.log((models[fold][n][0][g] + 0.05) / models[fold][n][1]) for g in own) for n in names] + [-language_id.UNKNOWN_NATS * len(own)]
        likely.append([language_id.TEMPER * x for x in scores])
        best.append(max(range(len(scores)), key=scores.__getitem__) if own else None)
    size = len(names)
    decided = lambda skip, test: [sum(1 for k, b in enumerate(best) if b == n and k != skip and test(rows[k])) for n in range(size)]
    everyone = decided(None, lambda r: True)
    shares = [(x + 1) / (sum(everyone) + size) for x in everyone]
    kinds = {r[2] for r in rows}
    given = {d: [(decided(None, lambda r, d=d: r[2] == d)[n] + 1.0) / (everyone[n] + len(kinds)) for n in range(size)] for d in kinds}
    out = []
    for k, row in enumerate(rows):
        smooth = lambda own, parent: [(x + language_id.KAPPA * p) / (sum(own) + language_id.KAPPA) for x, p in zip(own, parent, strict=True)]
        rest = decided(k, lambda r: True)
        corpus = [(x + 1) / (sum(rest) + size) for x in rest]
        prior = smooth(decided(k, lambda r, row=row: r[3] == row[3]), smooth(rest, corpus))  # all rows share the null domain
        logs = [math.log((1 - language_id.UNKNOWN_PRIOR) * prior[n]) + math.log(given[row[2]][n]) + likely[k][n] for n in range(size)]
        logs.append(math.log(language_id.UNKNOWN_PRIOR) + math.log(sum(g * s for g, s in zip(given[row[2]], shares, strict=True)) + 1e-12) + likely[k][size])
        # The suffix is null everywhere, so it says next to nothing: its likelihood is the same share for all.
        suffix = [(everyone[n] + 1.0) / (everyone[n] + 1.0) for n in range(size)]
        logs = [x + math.log(s) for x, s in zip(logs[:size], suffix, strict=True)] + [logs[size] + math.log(sum(s * p for s, p in zip(suffix, shares, strict=True)) + 1e-12)]
        top = max(range(size + 1), key=logs.__getitem__)
        out.append(((names + ["und"])[top], 1 / sum(math.exp(x - logs[top]) for x in logs)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    # Short texts of mixed languages, so that all the evidence counts.
    rows = [(k, " ".join(words(rng.choice(list(PARTS)), 1, rng) for _ in range(rng.randrange(4))), rng.choice(["en", "de", "fr", None, "de"]), rng.choice(["a", "b", None])) for k in range(80)]
    folds = [r["fold"] for r in spark.createDataFrame(rows, SCHEMA).withColumn("fold", F.when(F.col("lang").isNull(), -1).otherwise(language_id.sample_fold("doc_id", sum(r[2] is not None for r in rows), 40))).orderBy("doc_id").collect()]
    found = run(spark, rows, train_rows=40)
    want = brute_force(rows, folds)
    assert {len(x) for x in (set(folds), rows, found)} == {3, 80}
    for (key, *_), (language, confidence) in zip(rows, want, strict=True):
        assert found[key]["language"] == language and abs(found[key]["confidence"] - confidence) < 1e-3


def test_a_label_does_not_speak_through_the_text(spark):
    # Each text is unlike all others, so only its own label could tell the model its language.
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)), rng.choice(["en", "de"]), "x") for k in range(200)]
    found = run(spark, rows)
    right = sum(found[k]["text_language"] == lang for k, _, lang, _ in rows)
    assert right < 140


def test_page_text_has_no_markup(spark):
    html = "<html lang=en><head><style>p {}</style><SCRIPT>var der = 1 < 2;</SCRIPT ></head><!-- der --><p class='x'>two < three</p></html>"
    said = spark.createDataFrame([(html,)], "html string").select(language_id.page_text(F.col("html"))).first()[0]
    assert said.split() == ["two", "<", "three"]


def test_pages_use_markup_and_address(spark):
    rng = random.Random(1)
    rows = [(k, f"http://{'www.' * (k % 2)}a{k % 4}.{lang}x.org/", f'<html lang="{lang}"><body>{words(lang, 40, rng)}</body></html>') for k, lang in enumerate(rng.choices(list(PARTS), k=120))]
    rows += [(500, None, None), (501, "http://b.dex.org/", '<HTML LANG=de>')]
    found = {r["page_id"]: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[r[0]]["language"] == r[2][12:14] for r in rows[:120]) and found[501]["language"] == "de" and len(found) == 122
