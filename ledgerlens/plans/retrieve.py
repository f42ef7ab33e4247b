"""From questions to evidence to checked answers, in one plan over all questions.

Route and scope, expand the terms, compute a named metric, search facts and passages within the budget of each kind of
question under the scope's filters, drop the year where that leaves nothing at all, render the prompt, ask the model, check
the answer. Tables have the schemas of sources.schemas; vectors of the questions come with them (an embedder's work).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finance import METRICS, detect, grouped
from ..functions.text import COMPANY_ALIASES, answer_words, collapse, expand_terms, numbers, query_terms
from ..operators import evaluation, fulltext, grounding, metrics, scope, search
from ..sources.io import settled
from . import answer

HEADING_CHARS, PASSAGE_CHARS = 70, 700
FACT = ("fact_text", "signed", "scale", "page", "doc_name")
PASSAGE = ("kind", "page_start", "item_section", "context", "doc_name", "text")


def alias_table(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.createDataFrame(list(COMPANY_ALIASES.items()), "alias string, company string")


def _companies(documents: DataFrame) -> DataFrame:
    """The companies of the documents, a row each; settled, for otherwise every document's company goes through what names are made of."""
    return settled(documents.select("company").where("company is not null").distinct())


def routed(questions: DataFrame, documents: DataFrame, aliases: DataFrame | None = None, k_facts: int | None = None, k_chunks: int | None = None) -> DataFrame:
    """questions (qid, question, qvec) with company, fiscal_year, kind, k_facts, k_chunks, the search text and the metric named in it.

    k_facts and k_chunks, where given, take the place of the budget of each kind of question; 0 is none.
    """
    found = scope.route(scope.resolve_scope(questions, _companies(documents), alias_table(documents) if aliases is None else aliases))
    found = found.withColumns({name: F.lit(k) for name, k in (("k_facts", k_facts), ("k_chunks", k_chunks)) if k is not None})
    found = found.withColumn("search_text", expand_terms(F.col("question")))
    return found.withColumn("metric", detect(F.col("search_text")))


def _numbered(rows: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """rows with the numbers of their vectors, and these; given vectors have them already."""
    return search.numbered(rows) if vectors is None else (rows, vectors)


def _hits(rows: DataFrame, vectors: DataFrame, asked: DataFrame, budget: str, mode: str, id_col: str, text_col: str) -> DataFrame:
    """(qid, id, score, rank) within each question's own budget, under its filters q_company and q_fiscal_year."""
    filters = search.Filters(equal={"fiscal_year": "q_fiscal_year"}, contains={"company": "q_company"})
    queries = asked.select("qid", "qvec", F.col("search_text").alias("question"), "q_company", "q_fiscal_year", budget)
    most = max(1, queries.agg(F.max(budget)).first()[0] or 0)
    if mode not in ("vector", "hybrid", "english"):
        raise ValueError(f"no mode {mode}")
    if mode == "vector":
        return answer.within_budget(search.vector_ranks(rows, queries, most, id_col, filters=filters, vectors=vectors), queries, budget)
    # Each list is as deep as the question's own budget asks for.
    depth = F.greatest(2 * F.col(budget), F.lit(search.depth(1))).alias("depth")
    if mode == "english":
        terms = queries.withColumn("question", fulltext.any_words(query_terms(F.col("question"))))
        by_words = fulltext.scanned_search(rows, terms, search.depth(most), id_col, text_col, filters)
    else:
        by_words = search.lexical_ranks(rows, queries, search.depth(most), id_col, text_col, filters=filters)
    lists = [search.vector_ranks(rows, queries, search.depth(most), id_col, filters=filters, vectors=vectors), by_words]
    lists = [answer.within_budget(x, queries.select("qid", depth), "depth") for x in lists]
    return answer.within_budget(search.fuse(lists, most, id_col).withColumnRenamed("rrf", "score"), queries, budget)


def _search_both(asked: DataFrame, facts: tuple[DataFrame, DataFrame], chunks: tuple[DataFrame, DataFrame], mode: str) -> tuple[DataFrame, DataFrame]:
    return _hits(*facts, asked, "k_facts", mode, "fact_id", "fact_text"), _hits(*chunks, asked, "k_chunks", mode, "chunk_id", "text")


def _without_bare_years(asked: DataFrame, *tables: DataFrame) -> DataFrame:
    """asked with bare: whether the question's scope has no row in any of the tables, so that no search finds one; it is asked without the year at once.

    A few values of the rows are read for it, where a search of its own for these questions would read all rows again.
    """
    there = reduce(DataFrame.union, [t.select("company", "fiscal_year") for t in tables]).distinct()
    named = asked.where("q_fiscal_year <> 0").select("q_company", "q_fiscal_year").distinct()
    fits = (F.col("fiscal_year") == F.col("q_fiscal_year")) & search.may_have(search.Filters(contains={"company": "q_company"}))
    bare = search.sized(settled(named.join(search.sized(there), fits, "left_anti").toDF("__company", "__year")))
    own = F.col("q_company").eqNullSafe(F.col("__company")) & (F.col("q_fiscal_year") == F.col("__year"))
    marked = asked.join(bare, own, "left").withColumn("bare", F.col("__year").isNotNull()).drop("__company", "__year")
    return marked.withColumn("q_fiscal_year", F.when(~F.col("bare"), F.col("q_fiscal_year")))


def retrieve(asked: DataFrame, documents: DataFrame, facts: DataFrame, chunks: DataFrame, mode: str = "vector", vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scope used, facts found, passages found, metrics computed) of routed questions.

    Facts: qid, fact_id, rank, score and FACT; passages: qid, chunk_id, rank, score and PASSAGE; metrics: qid and what
    metrics.compute gives. A scope without any fact and passage is searched without the year, which the scope used then
    lacks too: with the first search where no row has that company and year, else in a second one. The searches are done; what is joined to their hits, and the metrics, is computed as far as it is read. mode is vector, hybrid (with exact words) or english (hybrid with stems). With vectors (search.NUMBER, embedding)
    given, facts and chunks have a vector's number in place of the vector.
    """
    asked = settled(asked)  # a row per question
    (facts, fact_vectors), (chunks, chunk_vectors) = _numbered(facts, vectors), _numbered(chunks, vectors)
    facts, chunks = search.with_filing(facts, documents), search.with_filing(chunks, documents)
    searched = (facts, fact_vectors), (chunks, chunk_vectors)
    first = settled(_without_bare_years(asked.withColumns({"q_company": F.col("company"), "q_fiscal_year": F.col("fiscal_year")}), facts, chunks))
    fact_hits, chunk_hits = (settled(x) for x in _search_both(first, *searched, mode))  # within the questions' budgets
    some = fact_hits.select("qid").union(chunk_hits.select("qid")).distinct()
    empty = settled(first.where("not bare and (company is not null or fiscal_year is not null)").join(some, "qid", "left_anti").withColumn("q_fiscal_year", F.lit(None).cast("int")))
    raw_facts, raw_chunks = fact_hits, chunk_hits
    if not empty.isEmpty():
        more_facts, more_chunks = (settled(x) for x in _search_both(empty, *searched, mode))
        raw_facts, raw_chunks = fact_hits.unionByName(more_facts), chunk_hits.unionByName(more_chunks)
    dropped = first.where("bare").select("qid").union(empty.select("qid")).withColumn("dropped", F.lit(True))
    used = asked.join(dropped, "qid", "left")
    used = used.withColumn("fiscal_year", F.when(F.col("dropped").isNull(), F.col("fiscal_year"))).drop("dropped")

    fact_hits = search.with_rows(raw_facts, facts.select("fact_id", *FACT), "fact_id")
    context = F.try_element_at("heading_trail", F.lit(-1)).alias("context")
    chunk_hits = search.with_rows(raw_chunks, chunks.select("chunk_id", context, *[c for c in PASSAGE if c != "context"]), "chunk_id")
    wanted = asked.where("metric is not null and company is not null and fiscal_year is not null").select("qid", "metric", "company", "fiscal_year")
    scoped = facts.join(search.sized(wanted.select("company", "fiscal_year").distinct()), ["company", "fiscal_year"], "left_semi")
    asked_for = {r["metric"] for r in wanted.where(F.col("metric").isin(*METRICS)).select("metric").distinct().collect()}
    computed = metrics.compute(scoped, tuple(m for m in METRICS if m in asked_for) or tuple(METRICS)).join(wanted, ["company", "fiscal_year", "metric"]).drop("company", "fiscal_year")
    return used, fact_hits, chunk_hits, computed


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("None"))


def render(questions: DataFrame, fact_hits: DataFrame, chunk_hits: DataFrame, computed: DataFrame) -> DataFrame:
    """(qid, prompt): computed metrics with their inputs, then figures, then passages, then the question."""
    inputs = F.transform("inputs", lambda i: F.concat(F.lit("      from [F"), i["fact_id"].cast("string"), F.lit("] "), i["label"], F.lit(" = "), grouped(i["value"]), F.lit("  ("), i["doc_name"], F.lit(" p"), _text(i["page"]), F.lit(")")))
    head = F.concat(F.lit("  "), F.col("metric"), F.lit(" = "), F.col("shown"), F.lit("   ("), F.col("note"), F.lit(")"))
    made = computed.select("qid", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.array_join(F.concat(F.array(head), inputs), "\n").alias("line"))
    unit = F.when(F.coalesce(F.col("scale") != "", F.lit(False)), F.concat(F.lit(" "), "scale")).otherwise("")
    figure = F.concat(F.lit("  [F"), F.col("fact_id").cast("string"), F.lit("] "), F.col("doc_name"), F.lit(" p"), _text(F.col("page")), F.lit(" | "), F.coalesce("fact_text", F.lit("None")), F.lit(" | value="), _text(F.col("signed")), unit)
    heading = F.when(F.coalesce(F.col("context") != "", F.lit(False)), F.concat(F.lit(" | "), F.substring("context", 1, HEADING_CHARS))).otherwise("")
    passage = F.concat(F.lit("  [C"), F.col("chunk_id").cast("string"), F.lit("] "), F.col("doc_name"), F.lit(" p"), _text(F.col("page_start")), heading, F.lit("\n      "), F.substring(collapse(F.coalesce("text", F.lit(""))), 1, PASSAGE_CHARS))
    lines = made.unionByName(fact_hits.select("qid", F.lit(1).alias("part"), "rank", figure.alias("line"))).unionByName(chunk_hits.select("qid", F.lit(2).alias("part"), "rank", passage.alias("line")))
    listed = lines.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("part", "rank", "line"))).alias("lines"))

    def part(n: int, title: str) -> Column:
        own = F.transform(F.filter("lines", lambda x: x["part"] == n), lambda x: x["line"])
        return F.when(F.coalesce(F.size(own) > 0, F.lit(False)), F.concat(F.array(F.lit(title)), own, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    # The titles of a context's parts.
    titles = ("Computed for you — the arithmetic is already done, use these figures as given and do not recalculate:", "Figures — each is a value read from a table cell in the filing:", "Passages:")
    whole = F.concat(F.array(F.lit("CONTEXT"), F.lit("")), *[part(n, title) for n, title in enumerate(titles)], F.array(F.lit("QUESTION"), F.col("question")))
    return questions.select("qid", "question").join(listed, "qid", "left").select("qid", F.array_join(whole, "\n").alias("prompt"))


def supplied(questions: DataFrame, fact_hits: DataFrame, chunk_hits: DataFrame, computed: DataFrame) -> DataFrame:
    """(qid, ids, supplied, n_facts, n_chunks): what an answer may cite, and the figures it may state: values, computed results and pages."""
    by_fact = fact_hits.groupBy("qid").agg(F.collect_set(F.concat(F.lit("F"), F.col("fact_id").cast("string"))).alias("f_ids"), F.array_union(F.collect_set(F.abs(F.col("signed").cast("double"))), F.collect_set(F.col("page").cast("double"))).alias("f_values"), F.count("*").alias("n_facts"))
    by_chunk = chunk_hits.groupBy("qid").agg(F.collect_set(F.concat(F.lit("C"), F.col("chunk_id").cast("string"))).alias("c_ids"), F.collect_set(F.col("page_start").cast("double")).alias("c_values"), F.count("*").alias("n_chunks"))
    by_metric = computed.groupBy("qid").agg(F.collect_set(F.abs("value")).alias("m_values"))
    joined = questions.select("qid").join(by_fact, "qid", "left").join(by_chunk, "qid", "left").join(by_metric, "qid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    ids = F.array_union(none("f_ids", "string"), none("c_ids", "string"))
    values = F.array_union(F.array_union(none("f_values", "double"), none("c_values", "double")), none("m_values", "double"))
    return joined.select("qid", ids.alias("ids"), values.alias("supplied"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def first_figure_model(prompt: str) -> str:
    """A deterministic stand-in for a language model: states the first figure of the context and cites it, or refuses."""
    for line in prompt.split("\n"):
        if line.startswith("  [F") and " | value=" in line:
            return f"The figure is {line.rpartition(' | value=')[2]} {line[2 : line.index(']') + 1]}."
    return f"{grounding.REFUSAL}: no figure was supplied."


def answers(asked: DataFrame, documents: DataFrame, facts: DataFrame, chunks: DataFrame, model: Callable[[str], str] = first_figure_model, mode: str = "vector", vectors: DataFrame | None = None) -> DataFrame:
    """Routed questions answered: qid, company, fiscal_year (the scope used), kind, n_facts, n_chunks, prompt, answer, error, problems (array) and n_problems."""
    used, *found = retrieve(asked, documents, facts, chunks, mode, vectors)
    fact_hits, chunk_hits, computed = (settled(x) for x in found)  # within the questions' budgets; each is read twice
    prompts = settled(render(asked, fact_hits, chunk_hits, computed))  # a row per question, as the two below
    context = settled(supplied(asked, fact_hits, chunk_hits, computed))
    said = settled(answer.generate(prompts, model))
    found = answer.checked(said, context)
    none = F.array().cast("array<string>")
    out = used.select("qid", "question", "company", "fiscal_year", "kind").join(context.select("qid", "n_facts", "n_chunks"), "qid").join(prompts, "qid").join(found, "qid")
    return out.withColumn("problems", F.coalesce("problems", none)).withColumn("n_problems", F.size("problems"))


def page_text(rows: DataFrame) -> DataFrame:
    """(qid, shown): each answer (of answers) with what was searched below it, and its problems if it has any."""
    searched = F.concat(F.lit("*searched "), F.coalesce("company", F.lit("all companies")), F.lit(" · "), F.coalesce(F.col("fiscal_year").cast("string"), F.lit("all years")), F.lit(" — "), F.col("n_facts").cast("string"), F.lit(" figures, "), F.col("n_chunks").cast("string"), F.lit(" passages*"))
    warning = F.concat(F.array(F.lit(""), F.lit("> **Ungrounded — do not trust this answer:**")), F.transform("problems", lambda p: F.concat(F.lit("> - "), p)))
    lines = F.concat(F.array(F.lit(""), F.lit("---"), searched), F.when(F.size("problems") > 0, warning).otherwise(F.array().cast("array<string>")))
    return rows.select("qid", F.concat("answer", F.array_join(lines, "\n")).alias("shown"))


def answer_rows(answered: DataFrame, labels: DataFrame) -> DataFrame:
    """answers with their outcome, given labels (qid, group, answer and, if there, oracle_doc): qid, group, outcome, note, company, fiscal_year, oracle_doc, n_facts, n_chunks, seconds, expected, answer, problems.

    Texts are cut as the result file has them; an answer that could not be made is an error.
    """
    oracle = F.col("oracle_doc") if "oracle_doc" in labels.columns else F.lit(None).cast("string")
    known = labels.select("qid", "group", F.col("answer").alias("label"), oracle.alias("oracle_doc"))
    rows = grounding.with_note(grounding.outcome(answered.join(known, "qid").withColumn("expected", numbers(F.col("label")))))
    return rows.select("qid", "group", "outcome", "note", "company", "fiscal_year", "oracle_doc", "n_facts", "n_chunks", F.round("seconds", 1).alias("seconds"), F.substring("label", 1, 120).alias("expected"), F.substring(collapse("answer"), 1, 300).alias("answer"), F.substring(F.array_join("problems", "; "), 1, 200).alias("problems"))


def judged(questions: DataFrame, documents: DataFrame, aliases: DataFrame | None = None, groups: tuple[str, ...] | None = None) -> DataFrame:
    """questions (as for evaluate), of some groups or all, with what a question's evaluation needs: scope, group and the numbers of answer and evidence."""
    wanted = {"group": evaluation.classify(F.col("answer"), F.col("evidence_text")), "targets": numbers(F.col("answer")), "wanted": numbers(F.col("evidence_text")), "answer_words": answer_words(F.col("answer"))}
    known = questions.withColumns(wanted)
    known = known if groups is None else known.where(F.col("group").isin(*groups))
    scoped = scope.resolve_scope(known, _companies(documents), alias_table(documents) if aliases is None else aliases)
    return scoped.withColumnsRenamed({"company": "routed_company", "fiscal_year": "routed_year"})


def evaluate(questions: DataFrame, documents: DataFrame, facts: DataFrame, chunks: DataFrame, k: int = 20, aliases: DataFrame | None = None, vectors: DataFrame | None = None, groups: tuple[str, ...] | None = None) -> DataFrame:
    """One row per question and condition with the scores of its group; columns of the other groups' scores are null.

    questions: qid, question, qvec, answer, evidence_text, oracle_doc. Numeric groups search facts, narrative ones passages. vectors as in retrieve.
    groups: those whose questions are asked (direct, computed, narrative), all by default; nothing is searched for the others.
    """
    asked = settled(evaluation.conditions(judged(questions, documents, aliases, groups)))  # three rows per question
    (facts, fact_vectors), (chunks, chunk_vectors) = _numbered(facts, vectors), _numbered(chunks, vectors)
    facts, chunks = search.with_filing(facts, documents), search.with_filing(chunks, documents)
    if groups is not None:  # a side whose groups are not asked is not read
        facts, chunks = facts if {"direct", "computed"} & set(groups) else facts.limit(0), chunks if "narrative" in groups else chunks.limit(0)
    numeric, prose = asked.where("`group` <> 'narrative'"), asked.where("`group` = 'narrative'")
    columns = ("qid", "qvec", "q_doc_name", "q_company", "q_fiscal_year")
    # k rows per question and condition.
    fact_hits = settled(search.vector_ranks(facts, numeric.select(*columns), k, "fact_id", filters=search.BY_FILING, vectors=fact_vectors).join(facts.select("fact_id", "signed", "page"), "fact_id"))
    chunk_hits = settled(search.vector_ranks(chunks, prose.select(*columns), k, "chunk_id", filters=search.BY_FILING, vectors=chunk_vectors).join(chunks.select("chunk_id", "page_start", "doc_name", "text"), "chunk_id"))
    sought = asked.where("`group` = 'direct'")
    fits = settled(evaluation.first_fits(sought, fact_hits))  # one per question at most: only these need their texts
    direct = evaluation.score_direct(sought, search.with_rows(fits, facts.select("fact_id", "fact_text", "doc_name"), "fact_id"))
    computed = evaluation.score_computed(asked.where("`group` = 'computed'"), fact_hits)
    narrative = evaluation.score_narrative(prose, chunk_hits)
    scores = direct.unionByName(narrative, allowMissingColumns=True).unionByName(computed, allowMissingColumns=True)
    counts = fact_hits.groupBy("qid").agg(F.count("*").alias("n_retrieved")).union(chunk_hits.groupBy("qid").agg(F.count("*").alias("n_retrieved")))
    out = asked.select("qid", "question_id", "condition", "group", "oracle_doc", "answer_words", *[F.when(F.col("condition") == "routed", F.col(c)).alias(c) for c in ("routed_company", "routed_year")])
    return out.join(counts, "qid", "left").join(scores, "qid", "left").withColumn("n_retrieved", F.coalesce("n_retrieved", F.lit(0))).drop("qid")


