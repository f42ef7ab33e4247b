"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from ..functions.text import EXPANSIONS, NOISE
from . import oracle_english

_LINES = "lines AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS fact_id FROM lineitem)"
_FILINGS = "filings AS (SELECT o_orderkey AS doc_id, n_name || '_' || year(o_orderdate) || '_10K_' || o_orderkey AS doc_name, n_name AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_FACTS = "facts AS (SELECT fact_id, l_orderkey AS doc_id, l_linenumber AS table_ordinal, l_returnflag || ' ' || l_linestatus AS row_label, l_extendedprice AS value, l_returnflag = 'R' AS parenthesised, l_linenumber AS page FROM lines)"
_QUESTIONS = """questions AS (SELECT doc_id AS qid, 'Describe ' || (['capex', 'working capital and EPS', 'net margin', 'r&d', 'segments'])[doc_id % 5 + 1] || ' of '
  || CASE doc_id % 3 WHEN 0 THEN company WHEN 1 THEN replace(company, 'NATION_', 'N.T.N. ') ELSE 'the group' END
  || CASE WHEN doc_id % 2 = 0 THEN ' in FY' || fiscal_year WHEN doc_id % 5 = 0 THEN ' during ' || (fiscal_year + 30) ELSE '' END AS question FROM filings)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


_COSINE = "round({0} / (sqrt({1}) * sqrt({2})), 6)".format(_dot("e.embedding", "q.qvec"), _dot("e.embedding", "e.embedding"), _dot("q.qvec", "q.qvec"))
_VECTOR_QUERIES = "queries AS (SELECT vec_id AS qid, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0)"
_NOISE = ", ".join(f"'{w}'" for w in NOISE)
_TERMS = f"list_filter(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[A-Za-z][A-Za-z0-9&'']*|\\d{{{{4}}}}'), lambda w: trim(lower(w), '''')), lambda w: length(w) >= 3 AND w NOT IN ({_NOISE}))"


def _terms(text: str) -> str:
    """First twelve distinct terms in order."""
    found = _TERMS.format(text).replace("{{", "{").replace("}}", "}")
    return f"(list_filter({found}, lambda w, i: list_position({found}, w) = i))[1:12]"


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9&'']+'), lambda w: w <> '')"
_LEXICAL = f"""asked AS (SELECT qid, len(terms) AS n_terms, unnest(terms) AS term FROM (SELECT qid, {_terms('question')} AS terms FROM lexical_queries)),
counted AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
lexical AS (SELECT qid, id, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) / any_value(n_terms), 6) AS score FROM counted JOIN asked USING (term) GROUP BY qid, id),
lexical_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM lexical)"""


def _grams(text: str) -> str:
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 1, 1)), lambda i: {words}[i] || ' ' || {words}[i + 1] || ' ' || {words}[i + 2]))"


_OVERLAP = f"""words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM words, range(1, 100000) AS r(i) WHERE i <= len(w) - 2),
sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM documents),
doc_grams AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM doc_words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
held AS (SELECT DISTINCT doc_id, gram FROM doc_grams WHERE gram IS NOT NULL),
pairs AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS overlap FROM held JOIN wanted USING (gram) JOIN sizes USING (item_id) GROUP BY item_id, doc_id)"""
_BEST = f"{_OVERLAP}, best AS (SELECT item_id, max(overlap) AS best, arg_min(doc_id, (-overlap, doc_id)) AS best_id FROM pairs GROUP BY item_id)"

_NUMBERS = """list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '-?\\$?\\(?\\d[\\d,]*\\.?\\d*\\)?%?'), lambda t: round(abs(try_cast(trim(replace(replace(trim(t, '%'), '$', ''), ',', ''), '()') AS DOUBLE)), 4)), lambda x: x IS NOT NULL))"""
_SAME = "(abs({0} - {1}) < 0.01 OR abs({0} * 1000 - {1}) < 0.01 OR abs({0} / 1000 - {1}) < 1e-6)"

ORACLE: dict[str, str] = {}

ORACLE["vector_topk"] = f"WITH q AS (SELECT embedding AS qvec FROM embeddings WHERE vec_id = 0) SELECT e.vec_id AS id, e.label, {_COSINE} AS score FROM embeddings e, q ORDER BY score DESC, id LIMIT 10"
ORACLE["vector_topk_filtered"] = f"WITH q AS (SELECT embedding AS qvec FROM embeddings WHERE vec_id = 0) SELECT e.vec_id AS id, e.label, {_COSINE} AS score FROM embeddings e, q WHERE e.label = 3 ORDER BY score DESC, id LIMIT 10"
ORACLE["vector_topk_per_query"] = f"""WITH {_VECTOR_QUERIES}, scored AS (SELECT q.qid, e.vec_id AS id, {_COSINE} AS score FROM embeddings e, queries q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) SELECT * FROM ranked WHERE rank <= 10"""
ORACLE["vector_length"] = f"SELECT vec_id AS id, round(sqrt({_dot('embedding', 'embedding')}), 6) AS length, 1.0::DOUBLE AS unit FROM embeddings"
_METRICS = "count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS r20, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr"
ORACLE["retrieval_eval"] = f"""WITH {_VECTOR_QUERIES}, scored AS (SELECT q.qid, qlabel, label, e.vec_id AS id, {_COSINE} AS score FROM embeddings e, queries q WHERE e.vec_id <> q.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored), firsts AS (SELECT qid, min(CASE WHEN label = qlabel THEN rank END) AS rank FROM ranked GROUP BY qid) SELECT {_METRICS} FROM firsts"""
ORACLE["condition_grid"] = f"""WITH {_VECTOR_QUERIES}, asked AS (SELECT qid, qvec, qlabel, condition, CASE WHEN condition = 'oracle' THEN qlabel WHEN condition = 'routed' AND qid % 200 = 0 THEN qlabel END AS only_label FROM queries, (VALUES ('oracle'), ('routed'), ('corpus')) c(condition)),
scored AS (SELECT q.qid, condition, qlabel, label, e.vec_id AS id, {_COSINE} AS score FROM embeddings e, asked q WHERE e.vec_id <> q.qid AND (only_label IS NULL OR only_label = label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, condition ORDER BY score DESC, id) AS rank FROM scored),
firsts AS (SELECT qid, condition, min(CASE WHEN label = qlabel THEN rank END) AS rank FROM ranked WHERE rank <= 20 GROUP BY qid, condition) SELECT condition, {_METRICS} FROM firsts GROUP BY condition"""
_ALL_TERMS = _TERMS.format("text").replace("{{", "{").replace("}}", "}")
ORACLE["query_terms"] = f"""WITH each AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM (SELECT doc_id, {_ALL_TERMS} AS terms FROM documents)), firsts AS (SELECT doc_id, term, min(i) AS i FROM each GROUP BY doc_id, term),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM firsts), joined AS (SELECT doc_id, string_agg(term, ' OR ' ORDER BY i) AS terms FROM placed WHERE place <= 12 GROUP BY doc_id)
SELECT d.doc_id, coalesce(terms, '') AS terms FROM documents d LEFT JOIN joined USING (doc_id)"""
ORACLE["lexical_topk"] = f"WITH lexical_queries AS (SELECT item_id AS qid, text AS question FROM benchmark), {_LEXICAL} SELECT qid, id, score, rank FROM lexical_ranked WHERE rank <= 10"
ORACLE["hybrid_rrf"] = f"""WITH {_VECTOR_QUERIES}, lexical_queries AS (SELECT q.qid, d.text AS question FROM queries q JOIN documents d ON d.doc_id = q.qid), {_LEXICAL},
known AS (SELECT doc_id FROM documents), vectors AS (SELECT q.qid, e.vec_id AS id, {_COSINE} AS score FROM embeddings e JOIN known ON doc_id = e.vec_id, queries q WHERE q.qid IN (SELECT doc_id FROM known)),
vector_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vectors),
lists AS (SELECT qid, id, rank, 0 AS list FROM vector_ranked WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 1 FROM lexical_ranked WHERE rank <= 20),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((list, rank)) AS first FROM lists GROUP BY qid, id),
placed AS (SELECT qid, id, rrf, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, id) AS INTEGER) AS rank FROM fused) SELECT * FROM placed WHERE rank <= 10"""
ORACLE["trigram_overlap"] = f"WITH {_OVERLAP} SELECT item_id, doc_id, overlap FROM pairs WHERE overlap >= 0.25"
ORACLE["overlap_best"] = f"WITH {_BEST} SELECT * FROM best"
ORACLE["overlap_hits"] = f"WITH {_BEST} SELECT count(*) AS n, round(avg(CASE WHEN best >= 0.25 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(median(best), 6) AS median, (list(best ORDER BY best))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS p90 FROM best"
ORACLE["extract_numbers"] = f"SELECT doc_id, CAST(len({_NUMBERS.format('text')}) AS INTEGER) AS n, list_max({_NUMBERS.format('text')}) AS largest FROM documents"
_TOKENS = r"list_distinct(list_filter(regexp_extract_all(coalesce({0}, ''), '\d[\d,]*(?:\.\d+)?'), lambda t: length(replace(t, ',', '')) >= 3))"
ORACLE["number_tokens"] = f"SELECT page_id, array_to_string(list_sort({_TOKENS.format('html')}), ' ') AS tokens FROM pages"
_MATCH = _SAME.format("w", "f")
ORACLE["number_match"] = f"""WITH items AS (SELECT l_orderkey, list_distinct(list(round(l_extendedprice, 4))) AS found FROM lineitem GROUP BY l_orderkey), joined AS (SELECT o_orderkey, [o_totalprice, list_max(found) / 1000] AS wanted, found FROM orders JOIN items ON o_orderkey = l_orderkey),
hits AS (SELECT o_orderkey, len(list_filter(wanted, lambda w: len(list_filter(found, lambda f: {_MATCH})) > 0)) AS n FROM joined) SELECT o_orderkey, n > 0 AS any_match, round(n / 2.0::DOUBLE, 6) AS coverage FROM hits"""
_COV = ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS cov{k}" for k in (1, 5, 10, 20))
_ANY = ", ".join([f"round(avg(CASE WHEN cov{k} > 0 THEN 1.0 ELSE 0 END), 6) AS any{k}" for k in (1, 5, 10, 20)] + [f"round(avg(CASE WHEN cov{k} >= 0.999 THEN 1.0 ELSE 0 END), 6) AS all{k}" for k in (1, 5, 10, 20)])
ORACLE["coverage_at_k"] = f"WITH {_LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, fact_id) AS rank FROM lines), cov AS (SELECT l_orderkey, {_COV} FROM ranked GROUP BY l_orderkey) SELECT o_orderstatus, count(*) AS n, {_ANY}, round(avg(cov20), 6) AS mean20 FROM cov JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"
ORACLE["same_table_ratio"] = f"""WITH {_LINES}, {_FACTS}, best AS (SELECT doc_id, arg_min(value, (table_ordinal, fact_id)) FILTER (row_label LIKE 'A%') AS current_assets, arg_min(value, (table_ordinal, fact_id)) FILTER (row_label LIKE 'N%') AS current_liabilities FROM facts GROUP BY doc_id)
SELECT *, round(current_assets / nullif(current_liabilities, 0), 6) AS ratio FROM best WHERE current_assets IS NOT NULL AND current_liabilities IS NOT NULL"""
ORACLE["best_table"] = f"""WITH {_LINES}, {_FACTS}, {_FILINGS}, best AS (SELECT doc_id, arg_min(value, (table_ordinal, length(row_label), fact_id)) FILTER (row_label LIKE 'A%') AS a, arg_min(value, (table_ordinal, length(row_label), fact_id)) FILTER (row_label LIKE 'R%') AS r, min(table_ordinal) FILTER (row_label LIKE 'A%') + min(table_ordinal) FILTER (row_label LIKE 'R%') AS places FROM facts GROUP BY doc_id),
placed AS (SELECT company, fiscal_year, doc_id, CAST(places AS INTEGER) AS places, round(100 * a / nullif(r, 0), 4) AS margin, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY places, doc_id) AS place FROM best JOIN filings USING (doc_id) WHERE a IS NOT NULL AND r IS NOT NULL) SELECT company, fiscal_year, doc_id, places, margin FROM placed WHERE place = 1"""
ORACLE["line_item_patterns"] = """WITH patterns(key, place, pattern) AS (VALUES ('small', 0, 'small%'), ('small', 1, '%small%'), ('brass', 0, '%brass'), ('brass', 1, '%steel'), ('one', 0, 'part 1%'), ('one', 1, '%1'))
SELECT p_partkey, key, CAST(min(place) AS INTEGER) AS place, 'type' AS of FROM part JOIN patterns ON p_type ILIKE pattern GROUP BY p_partkey, key UNION ALL SELECT p_partkey, key, CAST(min(place) AS INTEGER), 'name' FROM part JOIN patterns ON p_name ILIKE pattern GROUP BY p_partkey, key"""
_SUM = "sum(CASE WHEN {0} THEN l_extendedprice ELSE 0.0 END)"
ORACLE["metric_margins"] = f"""WITH s AS (SELECT l_orderkey, {_SUM.format("l_returnflag = 'A'")} AS ca, {_SUM.format("l_returnflag = 'N'")} AS cl, {_SUM.format("l_returnflag = 'R'")} AS cash, {_SUM.format('l_tax > 0.04')} AS rec, {_SUM.format('l_discount > 0.05')} AS gp, sum(l_extendedprice) AS rev,
{_SUM.format('l_quantity > 25')} AS oi, {_SUM.format('l_quantity > 40')} AS ni, {_SUM.format("l_linestatus = 'F'")} AS ta, {_SUM.format("l_linestatus = 'O'")} AS tl, {_SUM.format('l_linenumber > 2')} AS eq FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(ca / nullif(cl, 0), 4) AS current_ratio, round((cash + rec) / nullif(cl, 0), 4) AS quick_ratio, round(ca - cl, 4) AS working_capital, round(100 * gp / nullif(rev, 0), 4) AS gross_margin, round(100 * oi / nullif(rev, 0), 4) AS operating_margin, round(100 * ni / nullif(rev, 0), 4) AS net_margin, round(tl / nullif(eq, 0), 4) AS debt_to_equity, round(100 * ni / nullif(ta, 0), 4) AS return_on_assets FROM s"""


def _expanded(question: str) -> str:
    """The expansions in order of appearance; RE2 has no lookaround, so each term's place is found by itself."""
    places = ", ".join(f"[CASE WHEN regexp_matches(lower({question}), '(^|[^a-z0-9]){t.replace('&', '&')}([^a-z0-9]|$)') THEN strpos(lower({question}), '{t}') ELSE 0 END::VARCHAR, '{e}']" for t, e in EXPANSIONS.items())
    return f"{question} || coalesce(' ' || nullif(array_to_string(list_transform(list_sort(list_transform(list_filter([{places}], lambda p: p[1] <> '0'), lambda p: lpad(p[1], 6, '0') || p[2])), lambda p: p[7:]), ' '), ''), '')"


ORACLE["term_expansion"] = f"WITH {_FILINGS}, {_QUESTIONS} SELECT qid, {_expanded('question')} AS search_text FROM questions"
ORACLE["metric_detect"] = f"WITH {_FILINGS}, {_QUESTIONS} SELECT qid, nullif(regexp_extract(lower({_expanded('question')}), '(total current assets|earnings per share|net margin)', 1), '') AS metric FROM questions"
ORACLE["signed_value"] = f"WITH {_LINES}, {_FACTS} SELECT fact_id, CASE WHEN parenthesised THEN -value ELSE value END AS signed FROM facts"
ORACLE["scope_resolution"] = f"""WITH {_FILINGS}, {_QUESTIONS}, squashed AS (SELECT qid, question, regexp_replace(upper(question), '[^A-Z0-9]', '', 'g') AS q FROM questions),
names AS (SELECT n_name, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS name, replace(n_name, 'NATION_', 'NTN') AS alias FROM nation),
named AS (SELECT qid, arg_max(n_name, (length(name), name)) AS company FROM squashed JOIN names ON contains(q, name) GROUP BY qid),
aliased AS (SELECT qid, arg_max(n_name, (length(alias), alias)) AS company FROM squashed JOIN names ON contains(q, alias) GROUP BY qid)
SELECT s.qid, coalesce(n.company, a.company) AS company, CAST(coalesce(nullif(regexp_extract(question, '(?i)\\bFY\\s?(\\d{{4}})\\b', 1), ''), nullif(regexp_extract(question, '\\b(20\\d{{2}})\\b', 1), '')) AS INTEGER) AS fiscal_year FROM squashed s LEFT JOIN named n USING (qid) LEFT JOIN aliased a USING (qid)"""
ORACLE["company_list"] = f"WITH {_FILINGS}, names AS (SELECT DISTINCT company, regexp_replace(upper(company), '[^A-Z0-9]', '', 'g') AS name FROM filings) SELECT *, CAST(row_number() OVER (ORDER BY length(name) DESC, name) AS INTEGER) AS place FROM names"
ORACLE["route_budget"] = f"""WITH {_FILINGS}, {_QUESTIONS}, kinds AS (SELECT CASE WHEN regexp_matches(question, '(?i)\\b(what is|what was|how much|how many|amount|total|value of|capex|capital expenditure|revenue|net sales|net income|margin|ratio|assets|liabilities|cash flow|ebitda|eps|dividend|inventory|\\$|usd|millions?|billions?)\\b') THEN 'numeric' ELSE 'narrative' END AS kind FROM questions)
SELECT kind, CASE kind WHEN 'numeric' THEN 10 ELSE 4 END AS k_facts, CASE kind WHEN 'numeric' THEN 3 ELSE 10 END AS k_chunks, count(*) AS n FROM kinds GROUP BY kind"""
ORACLE["follow_up_carry"] = r"""WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'C' || length(text) END AS company, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS INTEGER) END AS fiscal_year, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)
SELECT conv_id, turn, coalesce(company, last_value(company IGNORE NULLS) OVER w) AS company, coalesce(fiscal_year, last_value(fiscal_year IGNORE NULLS) OVER w) AS fiscal_year,
md5(CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) <= 6 AND previous <> '' THEN previous || ' ' || text ELSE text END) AS search_md5 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ORACLE["year_fallback"] = """WITH loose AS (SELECT c_custkey AS qid, CAST(year(o_orderdate) AS INTEGER) AS year, 1994 + c_custkey % 5 AS asked FROM orders JOIN customer ON o_custkey = c_custkey), strict AS (SELECT * FROM loose WHERE year = asked),
hits AS (SELECT * FROM strict UNION ALL SELECT * FROM loose WHERE qid NOT IN (SELECT qid FROM strict)) SELECT qid, count(*) AS hits, min(year) AS from_year FROM hits GROUP BY qid"""
ORACLE["fact_context"] = f"WITH {_LINES} SELECT fact_id, p_partkey AS chunk_id, (string_split(p_name, ' '))[-1] AS context FROM lines LEFT JOIN part ON p_partkey = l_partkey AND l_quantity > 25"
ORACLE["fact_strings"] = f"WITH {_LINES} SELECT fact_id, 'ACME' || CASE WHEN l_linenumber > 1 THEN ' · Shipped ' || l_linestatus ELSE '' END || ' · ' || l_returnflag || CASE WHEN l_linestatus <> 'O' THEN ' · ' || l_linestatus ELSE '' END || ' · ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' millions' ELSE '' END AS fact_text FROM lines"
ORACLE["loaded_docs"] = "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
ORACLE["todo_docs"] = "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
ORACLE["referenced_docs"] = "SELECT CAST(max(l_partkey) AS VARCHAR) AS doc_name FROM lineitem GROUP BY l_orderkey UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem"
ORACLE["worklist_order"] = """WITH wanted AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 480000), same AS (SELECT DISTINCT c_nationkey FROM customer JOIN wanted USING (c_custkey))
SELECT c_custkey, c_nationkey, CAST(CASE WHEN c_custkey IN (SELECT c_custkey FROM wanted) THEN 0 WHEN c_nationkey IN (SELECT c_nationkey FROM same) THEN 1 ELSE 2 END AS INTEGER) AS priority FROM customer ORDER BY priority, c_custkey LIMIT 100"""
ORACLE["page_batches"] = "SELECT p_partkey, TRUE AS complete, CAST(ceil(p_size / 12) AS BIGINT) AS parts FROM part WHERE p_size > 0"
ORACLE["company_names"] = f"WITH {_FILINGS} SELECT doc_id, company || CASE WHEN doc_id % 4 = 2 THEN '_10KSB' ELSE '' END AS company_part FROM filings"
ORACLE["chunk_dedupe"] = r"""WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN lang <> 'fr' THEN 1 END AS t, text FROM documents WHERE length(trim(text, ' ')) > 0)
SELECT min(chunk_id) AS chunk_id, md5(text) AS digest FROM c WHERE t = 1 GROUP BY md5(text) UNION ALL SELECT chunk_id, md5(text) FROM c WHERE t IS NULL"""
ORACLE["insert_or_ignore"] = f"WITH {_LINES}, placed AS (SELECT fact_id, l_orderkey AS doc_id, l_returnflag, l_linestatus, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY fact_id) AS p FROM lines) SELECT fact_id, doc_id, l_returnflag, l_linestatus, l_extendedprice FROM placed WHERE p = 1"
ORACLE["doc_upsert"] = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'X' END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 200000"
ORACLE["replace_by_document"] = """WITH incoming AS (SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM incoming) UNION ALL SELECT * FROM incoming"""
ORACLE["embedding_cache"] = "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN -1.0::DOUBLE ELSE length(text)::DOUBLE END AS v FROM documents"
ORACLE["page_blobs"] = r"WITH b AS (SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')) AS blob FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(length(blob) AS INTEGER) AS chars, md5(blob) AS digest FROM b"
ORACLE["evidence_page"] = f"""WITH e AS (SELECT page_id AS e_id, {_TOKENS.format('url')} AS t FROM pages), wanted AS (SELECT e_id, len(t) AS n, unnest(t) AS token FROM e), held AS (SELECT page_id, unnest({_TOKENS.format('html')}) AS token FROM pages),
shares AS (SELECT e_id, page_id, round(count(*) / any_value(n), 6) AS share FROM held JOIN wanted USING (token) GROUP BY e_id, page_id), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY e_id ORDER BY share DESC, page_id DESC) AS INTEGER) AS place FROM shares) SELECT * FROM placed WHERE place <= 3"""
ORACLE["table_fragments"] = "WITH t AS (SELECT conv_id AS doc_id, turn AS page, length(text) % 3 AS num_cols, role = 'user' AS has_header FROM conversations) SELECT a.doc_id, a.page, b.page AS continues FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.page = a.page - 1 AND a.num_cols = b.num_cols WHERE NOT a.has_header AND b.has_header"
ORACLE["scale_marker_location"] = "WITH marked AS (SELECT DISTINCT source FROM documents WHERE regexp_matches(text, '(?i)licensed under (the apache|cc)')) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM marked) AND NOT regexp_matches(text, '(?i)licensed under (the apache|cc)')"
ORACLE["text_contains"] = "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')"
ORACLE["extraction_overview"] = "SELECT conv_id, count(*) AS n_texts, count(DISTINCT turn) AS n_pages, count(*) FILTER (role <> 'user') AS n_headless, max(turn) AS last_page FROM conversations GROUP BY conv_id"
ORACLE["vertical_extent"] = f"WITH {_LINES}, b AS (SELECT fact_id, CASE WHEN l_returnflag = 'A' THEN 1 - l_quantity / 60.0::DOUBLE ELSE l_quantity / 60.0::DOUBLE END AS a, CASE WHEN l_returnflag = 'A' THEN 1 - (l_quantity + l_tax) / 60.0::DOUBLE ELSE (l_quantity + l_tax) / 60.0::DOUBLE END AS b FROM lines) SELECT fact_id, round(least(a, b), 6) AS y0, round(greatest(a, b), 6) AS y1 FROM b"
_ANSWERS = f"""{_LINES}, {_FACTS}, grouped AS (SELECT doc_id, arg_min(fact_id, fact_id) AS f, arg_min(value, fact_id) AS v, list('F' || fact_id) AS ids, list(value) AS supplied FROM facts GROUP BY doc_id),
answers AS (SELECT doc_id AS qid, f, v, ids, supplied, doc_id % 11 = 0 AS refused, v + CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS said, CASE doc_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'F7' ELSE 'F' || f END AS cited FROM grouped)"""
_PROBLEMS = f"""{_ANSWERS}, found AS (SELECT qid, 'no citation' AS problem, '' AS detail FROM answers WHERE NOT refused AND cited IS NULL UNION ALL SELECT qid, 'fabricated citation', cited FROM answers WHERE NOT refused AND cited IS NOT NULL AND NOT list_contains(ids, cited)
UNION ALL SELECT qid, 'ungrounded figure', '$' || format('{{:,.2f}}', said) FROM answers WHERE NOT refused AND len(list_filter(supplied, lambda s: {_SAME.format('round(said, 2)', 's')})) = 0)"""
ORACLE["grounding_check"] = f"WITH {_PROBLEMS} SELECT * FROM found"
ORACLE["answer_outcomes"] = f"""WITH {_PROBLEMS}, judged AS (SELECT CASE qid % 4 WHEN 0 THEN 'narrative' WHEN 1 THEN 'computed' ELSE 'direct' END AS "group", CASE WHEN refused THEN 'refused' WHEN qid IN (SELECT qid FROM found) THEN 'ungrounded' WHEN qid % 4 = 0 THEN 'unscored' WHEN qid % 7 = 3 OR {_SAME.format('v', 'round(said, 2)')} OR {_SAME.format('v', '2018.0')} THEN 'correct' ELSE 'wrong' END AS outcome FROM answers),
counted AS (SELECT "group", outcome, count(*) AS n FROM judged GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY "group"), 6) AS share FROM counted"""
ORACLE["outcome_share"] = "WITH counted AS (SELECT event_type, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS large, count(*) AS n FROM events GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM counted"
ORACLE["group_split"] = """WITH items AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN NOT regexp_matches(o_orderpriority, '\\d') THEN 'narrative' WHEN CAST(o_orderpriority[1] AS INTEGER) = n THEN 'direct' ELSE 'computed' END AS "group", count(*) AS n FROM orders JOIN items ON o_orderkey = l_orderkey GROUP BY 1"""
ORACLE["answer_word_split"] = "SELECT role, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}')) >= 4 AS sentence, count(*) AS n FROM conversations GROUP BY ALL"
ORACLE["prompt_render"] = rf"""WITH lexical_queries AS (SELECT item_id AS qid, text AS question FROM benchmark), {_LEXICAL}, shown AS (SELECT qid, count(*) AS n, string_agg('[C' || id || '] ' || source[1:70] || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g'))[1:700], chr(10) ORDER BY rank) AS evidence FROM lexical_ranked JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY qid)
SELECT q.qid, CAST(coalesce(n, 0) AS INTEGER) AS n_ids, md5(coalesce(evidence, '(no evidence)') || chr(10) || chr(10) || 'Question: ' || question) AS prompt_md5 FROM lexical_queries q LEFT JOIN shown s ON q.qid = s.qid"""
ORACLE["answer_pipeline"] = f"""WITH {_LINES}, {_FACTS}, {_FILINGS}, firsts AS (SELECT doc_id, arg_min(fact_id, fact_id) AS f, arg_min(value, fact_id) AS v, arg_min(page, fact_id) AS page FROM facts GROUP BY doc_id)
SELECT g.doc_id AS qid, CASE WHEN f IS NULL THEN 'INSUFFICIENT EVIDENCE: no evidence was supplied.' ELSE format('{{:,.2f}}', v) || ' (p. ' || page || ', filing) [F' || f || ']' END AS answer, 0 AS n_problems FROM filings g LEFT JOIN firsts s ON g.doc_id = s.doc_id"""
ORACLE["event_json"] = "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS sorted_props FROM events"

# The filings with facts and passages (queries._fact_table, _chunk_table) and the stated questions (queries._asked).
_FTABLE = """ftable AS (SELECT *, company || ' · ' || row_label || ' · ' || column_label || ' · ' || CAST(signed AS VARCHAR) || CASE WHEN scale IS NULL THEN '' ELSE ' ' || scale END AS fact_text FROM (
  SELECT fact_id, l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS table_ordinal, (['Total current assets', 'Total current liabilities', 'Net income', 'Net sales', 'Cash and cash equivalents', 'Accounts receivable - net', 'Segment net sales', 'NET INCOME (LOSS)'])[l_partkey % 8 + 1] AS row_label,
  'Dec 31, ' || (fiscal_year - CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS column_label, CASE WHEN l_tax = 0 AND l_discount < 0.03 THEN 0.0::DOUBLE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS signed, CASE WHEN l_linestatus = 'F' THEN 'millions' END AS scale,
  l_linenumber AS page, company, fiscal_year, doc_name FROM lines JOIN filings ON l_orderkey = doc_id)),
fvec AS (SELECT f.*, embedding::DOUBLE[] AS emb FROM ftable f JOIN embeddings ON vec_id = fact_id % (SELECT count(*) FROM embeddings))"""
_CTABLE = """cvec AS (SELECT c.*, company, fiscal_year, doc_name FROM (SELECT doc_id AS chunk_id, doc_id * 37 % (SELECT count(*) FROM orders) AS doc, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'prose' END AS kind, 'Item ' || (doc_id % 9) AS item_section, CASE WHEN doc_id % 4 <> 0 THEN source END AS context,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 50 AS INTEGER) END AS page_start, text, embedding::DOUBLE[] AS emb FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)) c JOIN filings ON doc = filings.doc_id)"""
_ASKED = """stated AS (SELECT f.doc_id AS qid, (['What was the current ratio', 'Describe the segments', 'What is the net margin', 'Explain capex and R&D', 'How much was the working capital', 'Who leads the company'])[k % 6 + 1] || ' of '
  || CASE k % 4 WHEN 0 THEN 'the group' WHEN 1 THEN replace(company, 'NATION_', 'N.T.N. ') ELSE company END || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN ' in FY' || (fiscal_year + 40) ELSE ' in FY' || fiscal_year END || '?' AS question,
  CASE k % 3 WHEN 0 THEN 'Because the market grew' WHEN 1 THEN 'It was ' || coalesce(top, 'none') ELSE '0.4711' END AS answer, CASE WHEN k % 3 = 0 THEN d.text ELSE coalesce(figures, '') END AS evidence_text, doc_name AS oracle_doc, e.embedding::DOUBLE[] AS qvec
  FROM (SELECT *, CAST(doc_id // 100 AS BIGINT) AS k FROM filings WHERE doc_id % 100 = 0) f LEFT JOIN (SELECT doc_id, string_agg(printf('%.2f', abs(signed)), ' ' ORDER BY printf('%.2f', abs(signed))) AS figures, printf('%.2f', max(abs(signed))) AS top FROM ftable GROUP BY doc_id) g ON f.doc_id = g.doc_id
  JOIN embeddings e ON e.vec_id = k % (SELECT count(*) FROM embeddings) JOIN documents d ON d.doc_id = k % (SELECT count(*) FROM documents))"""
_ROUTED = f"""names AS (SELECT n_name, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS name, replace(n_name, 'NATION_', 'NTN') AS alias FROM nation WHERE n_name IN (SELECT company FROM filings)),
squashed AS (SELECT qid, regexp_replace(upper(question), '[^A-Z0-9]', '', 'g') AS q FROM stated),
named AS (SELECT qid, arg_max(n_name, (length(name), name)) AS company FROM squashed JOIN names ON contains(q, name) GROUP BY qid), aliased AS (SELECT qid, arg_max(n_name, (length(alias), alias)) AS company FROM squashed JOIN names ON contains(q, alias) GROUP BY qid),
routed AS (SELECT a.*, coalesce(n.company, l.company) AS r_company, CAST(coalesce(nullif(regexp_extract(question, '(?i)\\bFY\\s?(\\d{{4}})\\b', 1), ''), nullif(regexp_extract(question, '\\b(20\\d{{2}})\\b', 1), '')) AS INTEGER) AS r_year,
  CASE WHEN regexp_matches(question, '(?i)\\b(what is|what was|how much|how many|amount|total|value of|capex|capital expenditure|revenue|net sales|net income|margin|ratio|assets|liabilities|cash flow|ebitda|eps|dividend|inventory|\\$|usd|millions?|billions?)\\b') THEN 'numeric' ELSE 'narrative' END AS kind,
  {_expanded('question')} AS search_text FROM stated a LEFT JOIN named n ON a.qid = n.qid LEFT JOIN aliased l ON a.qid = l.qid),
scoped AS (SELECT *, CASE kind WHEN 'numeric' THEN 10 ELSE 4 END AS k_facts, CASE kind WHEN 'numeric' THEN 3 ELSE 10 END AS k_chunks, nullif(regexp_extract(lower(search_text), '(operating margin|return on assets|working capital|debt to equity|current ratio|gross margin|quick ratio|net margin)', 1), '') AS metric FROM routed)"""
_COS = "round(list_cosine_similarity(emb, qvec), 6)"
_FITS = "(r_company IS NULL OR company ILIKE '%' || r_company || '%') AND ({0} IS NULL OR fiscal_year = {0})"
_FOUND = f"""strict_facts AS (SELECT qid, fact_id, k_facts, {_COS} AS score, doc_name FROM scoped JOIN fvec ON {_FITS.format('r_year')}), strict_chunks AS (SELECT qid, chunk_id, k_chunks, {_COS} AS score, doc_name, context FROM scoped JOIN cvec ON {_FITS.format('r_year')}),
nothing AS (SELECT * FROM scoped WHERE (r_company IS NOT NULL OR r_year IS NOT NULL) AND qid NOT IN (SELECT qid FROM strict_facts UNION SELECT qid FROM strict_chunks)),
all_facts AS (SELECT * FROM strict_facts UNION ALL SELECT qid, fact_id, k_facts, {_COS}, doc_name FROM nothing JOIN fvec ON {_FITS.format('NULL::INTEGER')}), all_chunks AS (SELECT * FROM strict_chunks UNION ALL SELECT qid, chunk_id, k_chunks, {_COS}, doc_name, context FROM nothing JOIN cvec ON {_FITS.format('NULL::INTEGER')}),
fact_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM all_facts) WHERE rank <= k_facts), chunk_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM all_chunks) WHERE rank <= k_chunks)"""
_BASE = f"{_LINES}, {_FILINGS}, {_FTABLE}, {_CTABLE}"
_RETRIEVED = f"{_BASE}, {_ASKED}, {_ROUTED}, {_FOUND}"

ORACLE["search_filtered"] = f"""WITH {_BASE}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qvec, vec_id // 100 % 5 AS w, n_name FROM embeddings JOIN nation ON n_nationkey = vec_id // 100 % 25 WHERE vec_id % 100 = 0),
fits AS (SELECT qid, chunk_id, {_COS} AS score, doc_name, kind, item_section, page_start, context FROM q JOIN cvec ON (w NOT IN (0, 4) OR company ILIKE '%' || lower(n_name) || '%') AND (w NOT IN (1, 4) OR kind = 'prose') AND (w <> 2 OR item_section = 'Item 3') AND (w <> 3 OR fiscal_year = 1997)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fits) SELECT qid, rank, chunk_id, score, doc_name, kind, item_section, page_start, context FROM ranked WHERE rank <= 5"""
ORACLE["search_facts_filtered"] = f"""WITH {_BASE}, q AS (SELECT doc_id AS qid, doc_name AS q_name, fiscal_year AS q_year, doc_id // 100 % 2 AS w, embedding::DOUBLE[] AS qvec FROM filings JOIN embeddings ON vec_id = doc_id // 100 % (SELECT count(*) FROM embeddings) WHERE doc_id % 100 = 0),
fits AS (SELECT qid, fact_id, {_COS} AS score, fact_text, signed, scale, page, doc_name FROM q JOIN fvec ON CASE w WHEN 0 THEN doc_name = q_name ELSE fiscal_year = q_year END),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM fits) SELECT qid, rank, fact_id, score, fact_text, signed, scale, page, doc_name FROM ranked WHERE rank <= 3"""
ORACLE["lexical_filtered"] = f"""WITH {_BASE}, q AS (SELECT item_id AS qid, text AS question, CASE WHEN item_id % 2 = 0 THEN 'table' END AS q_kind, CASE WHEN item_id % 3 = 0 THEN 1998 END AS q_year FROM benchmark), lexical_queries AS (SELECT qid, question FROM q), {_LEXICAL},
fits AS (SELECT l.qid, chunk_id, l.score FROM lexical l JOIN q ON l.qid = q.qid JOIN cvec ON chunk_id = id WHERE (q_kind IS NULL OR kind = q_kind) AND (q_year IS NULL OR fiscal_year = q_year)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fits) SELECT * FROM ranked WHERE rank <= 5"""
_FACT_WORDS = _LEXICAL.replace("SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(", "SELECT fact_id AS id, term, count(*) AS tf FROM (SELECT fact_id, unnest(").replace(" FROM documents)", " FROM (SELECT fact_id, fact_text AS text FROM ftable))")
ORACLE["lexical_facts"] = f"WITH {_BASE}, {_ASKED}, lexical_queries AS (SELECT qid, {_expanded('question')} AS question FROM stated), {_FACT_WORDS} SELECT qid, id AS fact_id, score, rank FROM lexical_ranked WHERE rank <= 5"
ORACLE["question_scope"] = f"WITH {_RETRIEVED} SELECT qid, r_company AS company, CASE WHEN qid NOT IN (SELECT qid FROM nothing) THEN r_year END AS fiscal_year, kind, k_facts, k_chunks, search_text, metric FROM scoped"
ORACLE["retrieve_facts"] = f"WITH {_RETRIEVED} SELECT qid, rank, fact_id, score, doc_name FROM fact_hits"
ORACLE["retrieve_chunks"] = f"WITH {_RETRIEVED} SELECT qid, rank, chunk_id, score, doc_name, context FROM chunk_hits"
_HYBRID = f"""{_RETRIEVED}, lexical_queries AS (SELECT qid, search_text AS question FROM scoped), {_FACT_WORDS},
eligible AS (SELECT qid, fact_id FROM all_facts), words AS (SELECT l.qid, l.id, CAST(row_number() OVER (PARTITION BY l.qid ORDER BY l.score DESC, l.id) AS INTEGER) AS rank FROM lexical l JOIN eligible e ON l.qid = e.qid AND l.id = e.fact_id),
vectors AS (SELECT qid, fact_id AS id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM all_facts),
lists AS (SELECT qid, id, rank, 0 AS list FROM vectors UNION ALL SELECT qid, id, rank, 1 FROM words), cut AS (SELECT l.*, k_facts FROM lists l JOIN scoped s ON l.qid = s.qid WHERE rank <= greatest(2 * k_facts, 20)),
fused AS (SELECT qid, id, k_facts, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((list, rank)) AS first FROM cut GROUP BY qid, id, k_facts), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, id) AS INTEGER) AS rank FROM fused)"""
ORACLE["retrieve_hybrid"] = f"WITH {_HYBRID} SELECT qid, rank, id AS fact_id, rrf FROM placed WHERE rank <= k_facts"
_PATTERNS = """patterns(key, place, pattern) AS (VALUES ('current_assets', 0, 'total current assets'), ('current_liabilities', 0, 'total current liabilities'), ('cash', 0, 'cash and cash equivalents'), ('cash', 1, 'cash and equivalents'), ('receivables', 0, 'accounts receivable%'), ('receivables', 1, 'receivables - net%'), ('receivables', 2, 'receivables%'),
  ('revenue', 0, 'total net sales'), ('revenue', 1, 'net sales'), ('revenue', 2, 'total revenues'), ('revenue', 3, 'total revenue'), ('revenue', 4, 'revenues'), ('revenue', 5, 'revenue'), ('net_income', 0, 'net income'), ('net_income', 1, 'net income (loss)'), ('net_income', 2, 'net income attributable%'))"""
_NEEDS = "needs(metric, key, n, of) AS (VALUES ('current ratio', 'current_assets', 1, 2), ('current ratio', 'current_liabilities', 2, 2), ('quick ratio', 'cash', 1, 3), ('quick ratio', 'receivables', 2, 3), ('quick ratio', 'current_liabilities', 3, 3), ('working capital', 'current_assets', 1, 2), ('working capital', 'current_liabilities', 2, 2), ('net margin', 'net_income', 1, 2), ('net margin', 'revenue', 2, 2))"
_COMPUTED = f"""{_PATTERNS}, {_NEEDS}, fitting AS (SELECT f.*, key, min(place) AS place FROM ftable f JOIN patterns ON row_label ILIKE pattern WHERE contains(column_label, CAST(fiscal_year AS VARCHAR)) GROUP BY ALL),
slots AS (SELECT company, fiscal_year, doc_id, table_ordinal, key, arg_min({{'id': fact_id, 'label': row_label, 'v': signed, 'page': page, 'doc': doc_name, 'place': place, 'scale': scale}}, (place, length(row_label), fact_id)) AS s FROM fitting GROUP BY company, fiscal_year, doc_id, table_ordinal, key),
wholes AS (SELECT company, fiscal_year, metric, doc_id, table_ordinal, sum(s.place) AS places, list(s ORDER BY n) AS i FROM slots JOIN needs USING (key) GROUP BY company, fiscal_year, metric, doc_id, table_ordinal, needs.of HAVING count(*) = needs.of),
bests AS (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year, metric ORDER BY places, doc_id, table_ordinal) AS choice FROM wholes),
computed AS (SELECT *, CASE metric WHEN 'current ratio' THEN i[1].v / nullif(i[2].v, 0) WHEN 'quick ratio' THEN (i[1].v + i[2].v) / nullif(i[3].v, 0) WHEN 'working capital' THEN i[1].v - i[2].v ELSE 100 * i[1].v / nullif(i[2].v, 0) END AS value FROM bests WHERE choice = 1)"""
_SHOWN = "CASE metric WHEN 'working capital' THEN format('{{:,.0f}}', value) WHEN 'net margin' THEN printf('%.1f%%', value) ELSE printf('%.2f', value) END"
ORACLE["metric_compute"] = f"WITH {_LINES}, {_FILINGS}, {_FTABLE}, {_COMPUTED} SELECT company, fiscal_year, metric, doc_id, table_ordinal, round(value, 6) AS value, i[1].scale AS scale, array_to_string(list_transform(i, lambda x: x.id), ',') AS fact_ids FROM computed WHERE value IS NOT NULL"
ORACLE["metric_render"] = f"""WITH {_LINES}, {_FILINGS}, {_FTABLE}, {_COMPUTED} SELECT company, fiscal_year, 'working capital: ' || format('{{:,.0f}}', value) || CASE WHEN i[1].scale IS NULL THEN '' ELSE ' ' || i[1].scale END || chr(10) || '  total current assets - total current liabilities' || chr(10) || '  computed from:' || chr(10)
  || array_to_string(list_transform(i, lambda x: '    [F' || x.id || '] ' || x.label || ' = ' || format('{{:,.0f}}', x.v) || '  (' || x.doc || ' p' || x.page || ')'), chr(10)) AS shown FROM computed WHERE metric = 'working capital' AND value IS NOT NULL"""
ORACLE["retrieve_metrics"] = f"WITH {_RETRIEVED}, {_COMPUTED} SELECT qid, c.metric, c.doc_id, {_SHOWN.replace('metric', 'c.metric').replace('{{', '{').replace('}}', '}')} AS shown, CAST(len(i) AS INTEGER) AS n_inputs FROM scoped s JOIN computed c ON s.metric = c.metric AND r_company = c.company AND r_year = c.fiscal_year WHERE value IS NOT NULL"


def _line(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), 'None')"


_BODY = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))[1:700]"
_PROMPTS = f"""made AS (SELECT qid, c.metric, value, '  ' || c.metric || ' = ' || {_SHOWN.replace('metric', 'c.metric').replace('{{', '{').replace('}}', '}')} || '   (' || CASE c.metric WHEN 'current ratio' THEN 'total current assets / total current liabilities' WHEN 'working capital' THEN 'total current assets - total current liabilities' ELSE 'net income / revenue' END || ')' || chr(10)
  || array_to_string(list_transform(i, lambda x: '      from [F' || x.id || '] ' || x.label || ' = ' || format('{{:,.0f}}', x.v) || '  (' || x.doc || ' p' || x.page || ')'), chr(10)) AS line FROM scoped s JOIN computed c ON s.metric = c.metric AND r_company = c.company AND r_year = c.fiscal_year WHERE value IS NOT NULL),
figures AS (SELECT qid, string_agg('  [F' || h.fact_id || '] ' || h.doc_name || ' p' || f.page || ' | ' || fact_text || ' | value=' || CAST(signed AS VARCHAR) || CASE WHEN scale IS NULL THEN '' ELSE ' ' || scale END, chr(10) ORDER BY rank) AS lines FROM fact_hits h JOIN ftable f ON h.fact_id = f.fact_id GROUP BY qid),
passages AS (SELECT qid, string_agg('  [C' || h.chunk_id || '] ' || h.doc_name || ' p' || {_line('c.page_start')} || CASE WHEN h.context IS NULL THEN '' ELSE ' | ' || h.context[1:70] END || chr(10) || '      ' || {_BODY}, chr(10) ORDER BY rank) AS lines FROM chunk_hits h JOIN cvec c ON h.chunk_id = c.chunk_id GROUP BY qid),
prompts AS (SELECT s.qid, 'CONTEXT' || chr(10) || chr(10) || CASE WHEN m.line IS NULL THEN '' ELSE 'Computed for you — the arithmetic is already done, use these figures as given and do not recalculate:' || chr(10) || m.line || chr(10) || chr(10) END
  || CASE WHEN f.lines IS NULL THEN '' ELSE 'Figures — each is a value read from a table cell in the filing:' || chr(10) || f.lines || chr(10) || chr(10) END || CASE WHEN p.lines IS NULL THEN '' ELSE 'Passages:' || chr(10) || p.lines || chr(10) || chr(10) END || 'QUESTION' || chr(10) || question AS prompt
  FROM scoped s LEFT JOIN made m ON s.qid = m.qid LEFT JOIN figures f ON s.qid = f.qid LEFT JOIN passages p ON s.qid = p.qid)"""
ORACLE["context_prompt"] = f"WITH {_RETRIEVED}, {_COMPUTED}, {_PROMPTS} SELECT qid, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM prompts"
# The stand-in model states the first figure, which is grounded, and cites it.
_FIRST = """firsts AS (SELECT qid, h.fact_id, signed, CAST(signed AS VARCHAR) || CASE WHEN scale IS NULL THEN '' ELSE ' ' || scale END AS said FROM fact_hits h JOIN ftable f ON h.fact_id = f.fact_id WHERE rank = 1),
answered AS (SELECT s.qid, s.answer AS label, s.evidence_text, r_company, CASE WHEN s.qid NOT IN (SELECT qid FROM nothing) THEN r_year END AS used_year, f.signed, CASE WHEN f.fact_id IS NULL THEN 'INSUFFICIENT EVIDENCE: no figure was supplied.' ELSE 'The figure is ' || said || ' [F' || f.fact_id || '].' END AS said,
  (SELECT count(*) FROM fact_hits h WHERE h.qid = s.qid) AS n_facts, (SELECT count(*) FROM chunk_hits h WHERE h.qid = s.qid) AS n_chunks FROM scoped s LEFT JOIN firsts f ON s.qid = f.qid)"""
ORACLE["answer_shown"] = f"WITH {_RETRIEVED}, {_FIRST} SELECT qid, said || chr(10) || '---' || chr(10) || '*searched ' || coalesce(r_company, 'all companies') || ' · ' || coalesce(CAST(used_year AS VARCHAR), 'all years') || ' — ' || n_facts || ' figures, ' || n_chunks || ' passages*' AS shown FROM answered"
_CLASS = f"CASE WHEN len({_NUMBERS.format('label')}) = 0 THEN 'narrative' WHEN len(list_filter({_NUMBERS.format('label')}, lambda w: len(list_filter({_NUMBERS.format('evidence_text')}, lambda f: {_MATCH})) > 0)) > 0 THEN 'direct' ELSE 'computed' END"
_JUDGED = f"""graded AS (SELECT *, {_CLASS} AS grp FROM answered), judged AS (SELECT qid, grp AS "group", CASE WHEN signed IS NULL THEN 'refused' WHEN grp = 'narrative' THEN 'unscored' WHEN len(list_filter({_NUMBERS.format('label')}, lambda w: {_SAME.format('w', 'round(abs(signed), 4)')})) > 0 THEN 'correct' ELSE 'wrong' END AS outcome,
  r_company AS company, used_year AS fiscal_year, n_facts, n_chunks, label[1:120] AS expected, said AS answer, '' AS problems FROM graded)"""
ORACLE["answer_evaluation"] = f"WITH {_RETRIEVED}, {_FIRST}, {_JUDGED} SELECT * FROM judged"
ORACLE["answer_headline"] = f"""WITH {_RETRIEVED}, {_FIRST}, {_JUDGED}, timed AS (SELECT j.*, round(o_totalprice / 1000, 1) AS seconds FROM judged j JOIN orders ON o_orderkey = qid)
SELECT count(*) FILTER ("group" = 'direct') AS n_direct, count(*) FILTER ("group" = 'direct' AND outcome = 'correct') AS correct, count(*) FILTER ("group" = 'direct' AND outcome IN ('wrong', 'ungrounded')) AS wrong, count(*) FILTER ("group" = 'direct' AND outcome = 'refused') AS refused, round(median(seconds), 6) AS median_seconds, round(sum(seconds) / 3600, 6) AS hours FROM timed"""

_GRAMS_OF = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1)), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"
_EVALUATED = f"""{_BASE}, {_ASKED}, {_ROUTED}, labelled AS (SELECT *, answer AS label FROM scoped), grouped AS (SELECT *, {_CLASS} AS grp, {_NUMBERS.format('label')} AS targets, {_NUMBERS.format('evidence_text')} AS wanted FROM labelled),
asks AS (SELECT qid, condition, grp, oracle_doc, targets, wanted, qvec, evidence_text, len(regexp_extract_all(answer, '[A-Za-z]{{3,}}')) AS answer_words, CASE WHEN condition = 'oracle' THEN oracle_doc END AS q_doc, CASE WHEN condition = 'routed' THEN r_company END AS q_company, CASE WHEN condition = 'routed' THEN r_year END AS q_year FROM grouped, (VALUES ('oracle'), ('routed'), ('corpus')) c(condition)),
fact_scores AS (SELECT qid, condition, fact_id, {_COS} AS score, abs(signed) AS v, fact_text, page, doc_name FROM asks JOIN fvec ON (q_doc IS NULL OR doc_name = q_doc) AND (q_company IS NULL OR company ILIKE '%' || q_company || '%') AND (q_year IS NULL OR fiscal_year = q_year) WHERE grp <> 'narrative'),
fact_ranks AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, condition ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM fact_scores) WHERE rank <= 20),
chunk_scores AS (SELECT qid, condition, chunk_id, {_COS} AS score, text, page_start, doc_name FROM asks JOIN cvec ON (q_doc IS NULL OR doc_name = q_doc) AND (q_company IS NULL OR company ILIKE '%' || q_company || '%') AND (q_year IS NULL OR fiscal_year = q_year) WHERE grp = 'narrative'),
chunk_ranks AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, condition ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM chunk_scores) WHERE rank <= 20),
directs AS (SELECT a.qid, a.condition, arg_min({{'rank': rank, 'score': round(score, 4), 'matched': fact_text, 'page': page, 'doc': doc_name, 'found': v}}, rank) AS f FROM asks a JOIN fact_ranks r ON a.qid = r.qid AND a.condition = r.condition WHERE grp = 'direct' AND len(list_filter(targets, lambda w: {_SAME.format('w', 'v')})) > 0 GROUP BY a.qid, a.condition),
lists AS (SELECT qid, condition, {', '.join(f'coalesce(list(v) FILTER (rank <= {k}), []) AS found{k}' for k in (1, 5, 10, 20))} FROM fact_ranks GROUP BY qid, condition),
covers AS (SELECT a.qid, a.condition, len(wanted) AS n_inputs, {', '.join(f"CASE WHEN len(wanted) > 0 THEN round(len(list_filter(wanted, lambda w: len(list_filter(coalesce(found{k}, []), lambda f: {_MATCH})) > 0)) / len(wanted), 6) END AS cov{k}" for k in (1, 5, 10, 20))} FROM asks a LEFT JOIN lists l ON a.qid = l.qid AND a.condition = l.condition WHERE grp = 'computed'),
words_of AS (SELECT a.qid, a.condition, rank, page_start, doc_name, regexp_extract_all(lower(evidence_text), '[a-z0-9]+') AS ew, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tw FROM asks a JOIN chunk_ranks r ON a.qid = r.qid AND a.condition = r.condition),
grams_of AS (SELECT qid, condition, rank, page_start, doc_name, {_GRAMS_OF.format('ew')} AS eg, {_GRAMS_OF.format('tw')} AS tg FROM words_of), overs AS (SELECT *, CASE WHEN len(eg) > 0 THEN len(list_intersect(eg, tg)) / len(eg) ELSE 0 END AS overlap FROM grams_of),
proses AS (SELECT qid, condition, arg_max({{'o': overlap, 'rank': rank, 'page': page_start, 'doc': doc_name}}, (overlap, -rank)) AS b FROM overs WHERE overlap > 0 GROUP BY qid, condition),
counts AS (SELECT qid, condition, count(*) AS n FROM fact_ranks GROUP BY ALL UNION ALL SELECT qid, condition, count(*) FROM chunk_ranks GROUP BY ALL),
results AS (SELECT a.qid AS question_id, a.condition, grp AS "group", oracle_doc, CAST(answer_words AS INTEGER) AS answer_words, q_company AS routed_company, q_year AS routed_year, coalesce(n, 0) AS n_retrieved, CASE WHEN grp = 'direct' THEN f.rank WHEN b.o >= 0.25 THEN b.rank END AS rank, f.score AS score, f.matched AS matched, coalesce(f.page, b.page) AS page, coalesce(f.doc, b.doc) AS found_doc,
  CASE WHEN grp = 'direct' THEN list_min(targets) END AS expected, f.found AS found, CASE WHEN grp = 'narrative' THEN round(coalesce(b.o, 0), 4) END AS best_overlap, n_inputs, cov1, cov5, cov10, cov20 FROM asks a LEFT JOIN counts n ON a.qid = n.qid AND a.condition = n.condition LEFT JOIN directs d ON a.qid = d.qid AND a.condition = d.condition LEFT JOIN covers c ON a.qid = c.qid AND a.condition = c.condition LEFT JOIN proses p ON a.qid = p.qid AND a.condition = p.condition)"""
ORACLE["evaluation_rows"] = f"WITH {_EVALUATED} SELECT * FROM results"
ORACLE["evaluation_direct"] = f"""WITH {_EVALUATED} SELECT "group", condition, {_METRICS} FROM results WHERE "group" = 'direct' GROUP BY ALL"""
ORACLE["evaluation_computed"] = f"""WITH {_EVALUATED} SELECT "group", condition, count(*) AS n, {_ANY}, round(avg(coalesce(cov20, 0)), 6) AS mean20 FROM results WHERE "group" = 'computed' GROUP BY "group", condition"""
ORACLE["evaluation_narrative"] = f"""WITH {_EVALUATED} SELECT "group", condition, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit, round(median(best_overlap), 6) AS median FROM results WHERE "group" = 'narrative' GROUP BY "group", condition"""
ORACLE["evaluation_split"] = f"""WITH {_EVALUATED} SELECT CASE WHEN answer_words >= 4 THEN 'sentence' ELSE 'figure' END AS answer, count(*) AS n, count(rank) AS found, round(count(rank) / count(*), 6) AS share FROM results WHERE "group" = 'direct' AND condition = 'routed' GROUP BY 1"""
ORACLE["evaluation_inputs"] = f"""WITH {_EVALUATED} SELECT count(*) AS n, round(median(n_inputs), 6) AS median_inputs, max(n_inputs) AS most_inputs, count(*) FILTER (n_inputs > 4) AS over_k FROM results WHERE "group" = 'computed' AND condition = 'routed' AND n_inputs > 0"""
ORACLE["question_subset"] = f"""WITH {_BASE}, {_ASKED}, labelled AS (SELECT *, answer AS label FROM stated), grouped AS (SELECT qid, {_CLASS} AS grp FROM labelled) SELECT qid, grp AS "group" FROM grouped WHERE grp = 'narrative' ORDER BY qid LIMIT 20 OFFSET 2"""
ORACLE["table_selector"] = f"WITH {_LINES}, {_FILINGS}, {_FTABLE} SELECT fact_id, doc_id, row_label FROM ftable WHERE table_ordinal = 1"
ORACLE["fact_rank"] = f"""WITH {_BASE}, {_ASKED}, ranked AS (SELECT qid, abs(signed) AS v, {_NUMBERS.format('answer')} AS targets, row_number() OVER (PARTITION BY qid ORDER BY {_COS} DESC, fact_id) AS rank FROM stated, fvec)
SELECT qid, CAST(min(CASE WHEN len(list_filter(targets, lambda t: abs(v - t) < 0.01)) > 0 THEN rank END) AS INTEGER) AS rank FROM ranked GROUP BY qid"""
_VALUE = "TRY_CAST(replace({0}, ',', '') AS DOUBLE)"
ORACLE["evidence_report"] = f"""WITH e AS (SELECT page_id AS e_id, {_TOKENS.format("url || ' 1,234.5 77'")} AS t, list_distinct(list_transform({_TOKENS.format('url')}, lambda x: {_VALUE.format('x')})) AS said FROM pages), p AS (SELECT page_id, {_TOKENS.format('html')} AS held FROM pages),
wanted AS (SELECT e_id, unnest(t) AS token FROM e), hits AS (SELECT page_id, unnest(held) AS token FROM p), shares AS (SELECT e_id, page_id, count(*) AS c FROM wanted JOIN hits USING (token) GROUP BY e_id, page_id),
best AS (SELECT s.e_id, arg_max({{'page': page_id, 'share': round(c / len(t), 6)}}, (round(c / len(t), 6), page_id)) AS b FROM shares s JOIN e ON s.e_id = e.e_id WHERE round(c / len(t), 6) >= 0.3 GROUP BY s.e_id),
vals AS (SELECT page_id, unnest(list_distinct(list_transform(held, lambda x: {_VALUE.format('x')}))) AS v FROM p), asked_values AS (SELECT e.e_id, unnest(said) AS v, b.page AS page FROM e JOIN best ON e.e_id = best.e_id),
placed AS (SELECT a.e_id, a.v, bool_or(coalesce(w.page_id = a.page, FALSE)) AS here, coalesce(array_to_string((list(w.page_id ORDER BY w.page_id) FILTER (w.page_id IS NOT NULL))[1:6], '/'), '') AS pages FROM asked_values a LEFT JOIN vals w ON a.v = w.v GROUP BY a.e_id, a.v),
answers AS (SELECT e_id, string_agg(CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) || ':' || here || ':' || pages, ',' ORDER BY v) AS answers FROM placed GROUP BY e_id)
SELECT e.e_id, CAST(len(t) AS INTEGER) AS n, b.page AS best_page, b.share AS share, b.page <> e.e_id AS is_offset, CASE WHEN b.page IS NOT NULL THEN CAST(len(list_filter(t, lambda x: list_contains(held, x))) AS INTEGER) END AS recovered,
CASE WHEN b.page IS NOT NULL THEN array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(held, x)))[1:15], ',') END AS missing, answers FROM e LEFT JOIN best ON e.e_id = best.e_id LEFT JOIN p ON p.page_id = b.page LEFT JOIN answers ON e.e_id = answers.e_id WHERE len(t) > 0"""
ORACLE["table_overview"] = r"""WITH t AS (SELECT conv_id AS doc_id, turn, role = 'user' AS head, round(length(text) / 4000, 6) AS bottom, regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' (In Millions) ' ELSE '' END, '(?i)\((?:in\s+)?(millions|thousands|billions)\)') AS marked FROM conversations)
SELECT doc_id, count(*) AS n_tables, count(*) FILTER (NOT head) AS n_headless, max(CASE WHEN bottom <> 0 THEN bottom END) AS lowest, count(*) FILTER (marked) AS n_marked, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (marked), '') AS marked FROM t GROUP BY doc_id"""
ORACLE["tables_by_page"] = "SELECT l_orderkey AS doc_id, l_linenumber AS page, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS tables FROM lineitem GROUP BY l_orderkey, l_linenumber"
ORACLE["page_blobs_with_cells"] = r"WITH b AS (SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY role <> 'user', turn), '\s+', ' ', 'g')) AS blob FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(length(blob) AS INTEGER) AS chars, md5(blob) AS digest FROM b"
ORACLE["kind_counts"] = "SELECT doc_id * 37 % (SELECT count(*) FROM orders) AS doc_id, count(*) FILTER (doc_id % 3 <> 0) AS prose, count(*) FILTER (doc_id % 3 = 0) AS tables FROM documents GROUP BY 1"
ORACLE["scale_markers"] = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'millions' WHEN 1 THEN 'thousands' WHEN 3 THEN 'billions' END AS scale FROM part"
ORACLE["token_values"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, 2) END AS value FROM orders"
ORACLE["evidence_numbers"] = "WITH n AS (SELECT l_orderkey, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS v FROM lineitem UNION SELECT l_orderkey, round(l_extendedprice, 2) FROM lineitem) SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, round(sum(v), 2) AS total FROM n GROUP BY l_orderkey"
ORACLE["chunk_union"] = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'prose' END AS kind, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS INTEGER) END AS table_ordinal FROM documents"
ORACLE["delete_cascade"] = f"WITH {_LINES}, {_FILINGS}, {_FTABLE} SELECT fact_id, doc_id FROM ftable WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"
ORACLE["chunk_set_null"] = f"WITH {_LINES} SELECT fact_id, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN NULL ELSE l_partkey END AS chunk_id FROM lines"
ORACLE["load_facts"] = f"""WITH {_LINES}, {_FILINGS}, {_FTABLE}, c AS (SELECT doc_id * 37 % (SELECT count(*) FROM orders) AS doc, CAST(doc_id % 2 AS INTEGER) AS t, max(doc_id) AS chunk_id, arg_max(source, doc_id) AS context FROM documents WHERE doc_id % 4 <> 1 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_ordinal, row_label, column_label ORDER BY fact_id) AS place FROM ftable)
SELECT fact_id, doc_id, chunk_id, company || CASE WHEN context IS NULL THEN '' ELSE ' · ' || context END || ' · ' || row_label || ' · ' || column_label || ' · ' || CAST(signed AS VARCHAR) || CASE WHEN scale IS NULL THEN '' ELSE ' ' || scale END AS fact_text FROM f LEFT JOIN c ON doc = doc_id AND t = table_ordinal WHERE place = 1"""
ORACLE["greedy_cover"] = """WITH RECURSIVE sets AS (SELECT l_partkey AS qid, list(DISTINCT CAST(l_suppkey AS VARCHAR)) AS docs FROM lineitem GROUP BY l_partkey),
named AS (SELECT doc, count(*) AS named FROM (SELECT unnest(docs) AS doc FROM sets) GROUP BY doc),
steps AS (SELECT 0 AS place, []::VARCHAR[] AS taken, NULL::VARCHAR AS doc, 0::BIGINT AS gain, 0::BIGINT AS named
UNION ALL SELECT place, list_append(taken, b.doc), b.doc, b.gain, b.named FROM (
  SELECT any_value(place) + 1 AS place, any_value(taken) AS taken, max({'gain': gain, 'named': n, 'doc': d}) AS b FROM (
    SELECT s.place, s.taken, n.doc AS d, n.named AS n, (SELECT count(*) FROM sets WHERE list_contains(docs, n.doc) AND len(list_filter(docs, lambda x: NOT list_contains(s.taken, x))) = 1) AS gain
    FROM steps s JOIN named n ON NOT list_contains(s.taken, n.doc)) HAVING count(*) > 0))
SELECT CAST(place AS INTEGER) AS place, doc, gain, named FROM steps WHERE place > 0"""
ORACLE["facts_cited"] = f"WITH {_LINES}, {_FILINGS}, {_FTABLE} SELECT fact_id, doc_name, company, fiscal_year, row_label, column_label, CAST(signed AS VARCHAR) AS value_raw, signed, scale, 'USD' AS unit, page, fact_text FROM ftable"

ORACLE |= oracle_english.ORACLE | {"lexical_stemmed": oracle_english.lexical(_terms("text"))}

_CHAT = rf"""spoken AS (SELECT conv_id, turn, trim(CASE turn // 2 % 4 WHEN 0 THEN 'What was the current ratio of NATION_' || (conv_id % 25) || ' in FY' || (1992 + conv_id % 6) || '?' WHEN 1 THEN 'and in FY' || (1993 + conv_id % 6) || '?'
  WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN '/reset' ELSE '  What about the net margin? ' END ELSE 'Describe the segments' END) AS question FROM conversations WHERE role = 'user'),
parted AS (SELECT *, count(*) FILTER (question = '/reset') OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM spoken), lines_said AS (SELECT * FROM parted WHERE question <> '/reset'),
own_scope AS (SELECT *, (SELECT arg_max(n_name, (length(n_name), n_name)) FROM nation WHERE contains(regexp_replace(upper(question), '[^A-Z0-9]', '', 'g'), replace(n_name, '_', ''))) AS own_company, CAST(nullif(regexp_extract(question, 'FY(\d{{4}})', 1), '') AS INTEGER) AS own_year FROM lines_said),
filled AS (SELECT conv_id, turn, conv_id || '/' || turn AS qid, question, last_value(own_company IGNORE NULLS) OVER w AS r_company, last_value(own_year IGNORE NULLS) OVER w AS r_year, lag(question) OVER w AS previous FROM own_scope WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn)),
followed AS (SELECT *, CASE WHEN len(string_split(question, ' ')) <= 6 AND previous IS NOT NULL THEN previous || ' ' || question ELSE question END AS typed FROM filled),
scoped AS (SELECT f.*, '' AS answer, '' AS evidence_text, {_expanded('typed')} AS search_text, CASE WHEN regexp_matches(question, '(?i)\b(what was|ratio|margin)\b') THEN 'numeric' ELSE 'narrative' END AS kind, CASE WHEN regexp_matches(question, '(?i)\b(what was|ratio|margin)\b') THEN 10 ELSE 4 END AS k_facts,
  CASE WHEN regexp_matches(question, '(?i)\b(what was|ratio|margin)\b') THEN 3 ELSE 10 END AS k_chunks, nullif(regexp_extract(lower({_expanded('typed')}), '(current ratio|net margin)', 1), '') AS metric, embedding::DOUBLE[] AS qvec FROM followed f JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings))"""
ORACLE["chat_turns"] = f"WITH {_CHAT} SELECT conv_id, turn, r_company AS company, r_year AS fiscal_year, kind, metric, search_text FROM scoped"
ORACLE["chat_answers"] = f"WITH {_BASE}, {_CHAT}, {_FOUND}, {_FIRST} SELECT s.conv_id, s.turn, a.r_company AS company, a.used_year AS fiscal_year, n_facts, n_chunks, said AS answer, 0 AS n_problems FROM answered a JOIN scoped s ON a.qid = s.qid"
ORACLE["figure_band_join"] = f"""WITH {_LINES}, tops AS (SELECT l_orderkey, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey), asked AS (SELECT DISTINCT o_orderkey AS qid, unnest(list_filter([o_totalprice, top / 1000], lambda x: x IS NOT NULL)) AS target FROM orders LEFT JOIN tops ON o_orderkey = l_orderkey),
held AS (SELECT abs(l_extendedprice) AS v, count(*) AS n, min(fact_id) AS first FROM lines GROUP BY 1), levels AS (SELECT DISTINCT target, unnest([target, target * 1000, target / 1000]) AS level FROM asked),
near AS (SELECT DISTINCT target, v, n, first FROM levels JOIN held ON v > level - 0.02 AND v < level + 0.02 WHERE {_SAME.format('target', 'v')}), found AS (SELECT target, CAST(sum(n) AS BIGINT) AS n_facts, min(first) AS first_fact FROM near GROUP BY target)
SELECT qid, round(a.target, 6) AS target, coalesce(n_facts, 0) AS n_facts, first_fact FROM asked a LEFT JOIN found f ON a.target = f.target"""
_PASSAGES = "(SELECT doc_id AS chunk_id, doc_id * 37 % (SELECT count(*) FROM orders) AS doc, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'prose' END AS kind, CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 50 AS INTEGER) END AS page_start, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS INTEGER) END AS t, text FROM documents)"
ORACLE["load_all"] = f"""WITH {_LINES}, {_FILINGS}, {_FTABLE}, passages AS {_PASSAGES},
fresh AS (SELECT doc_id, table_ordinal, row_label, column_label, arg_min(CASE WHEN signed < 0 THEN signed - 1 ELSE signed + 1 END, fact_id) AS signed FROM ftable WHERE doc_id % 3 = 0 GROUP BY doc_id, table_ordinal, row_label, column_label),
kept AS (SELECT doc_id, signed FROM ftable WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0), linked AS (SELECT DISTINCT doc, t FROM passages WHERE t IS NOT NULL AND trim(text, ' ') <> ''),
fact_sums AS (SELECT doc_id, count(*) AS n_facts, round(sum(signed), 2) AS total, count(t) AS n_linked, count(e) AS n_embedded FROM (SELECT doc_id, signed, t, 1 AS e FROM fresh LEFT JOIN linked ON doc = doc_id AND t = table_ordinal UNION ALL SELECT doc_id, signed, NULL, NULL FROM kept) GROUP BY doc_id),
new_chunks AS (SELECT doc, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind, t, page_start, text ORDER BY chunk_id) AS place FROM passages WHERE doc % 3 = 0 AND trim(text, ' ') <> '') WHERE t IS NULL OR place = 1),
chunk_sums AS (SELECT doc, count(*) AS n_chunks, round(sum(chars)::DOUBLE, 2) AS chars FROM (SELECT doc, chars FROM new_chunks UNION ALL SELECT doc, NULL FROM passages WHERE doc % 2 = 0 AND doc % 3 <> 0) GROUP BY doc)
SELECT doc_name, n_facts, total, n_linked, n_embedded, n_chunks, chars FROM filings f LEFT JOIN fact_sums s ON f.doc_id = s.doc_id LEFT JOIN chunk_sums c ON f.doc_id = c.doc WHERE f.doc_id % 2 = 0 OR f.doc_id % 3 = 0"""
ORACLE["embedding_append"] = """SELECT 'document' AS kind, doc_id AS id, 0 AS turn, length(text)::DOUBLE AS v FROM documents
UNION ALL SELECT 'turn', conv_id, turn, CASE WHEN text IN (SELECT text FROM documents WHERE text IS NOT NULL) THEN length(text) ELSE -length(text) END::DOUBLE FROM conversations"""
ORACLE["constraint_violations"] = f"""WITH {_LINES}, {_FILINGS}, {_FTABLE}, docs AS (SELECT doc_id, CASE WHEN doc_id % 97 <> 1 THEN doc_name END AS doc_name FROM filings), all_docs AS (SELECT * FROM docs UNION ALL SELECT -doc_id, doc_name FROM docs WHERE doc_id % 89 = 2),
parts AS (SELECT chunk_id, CASE WHEN chunk_id % 40 = 3 THEN -7 ELSE doc END AS doc_id, CASE WHEN chunk_id % 50 <> 7 THEN kind END AS kind, t, page_start, CASE WHEN chunk_id % 60 <> 5 THEN text END AS text FROM {_PASSAGES}),
nums AS (SELECT count(*) AS np FROM documents), refs AS (SELECT fact_id, CASE WHEN fact_id % 11 = 4 THEN np + 1 WHEN fact_id % 11 <> 5 THEN fact_id % np END AS chunk_id FROM ftable, nums)
SELECT 'documents' AS "table", 'doc_name is null' AS rule, CAST(doc_id AS VARCHAR) AS key, count(*) AS n FROM all_docs WHERE doc_name IS NULL GROUP BY doc_id
UNION ALL SELECT 'documents', 'doc_name repeated', doc_name, count(*) FROM all_docs WHERE doc_name IS NOT NULL GROUP BY doc_name HAVING count(*) > 1
UNION ALL SELECT 'documents', 'doc_id repeated', CAST(doc_id AS VARCHAR), count(*) FROM all_docs GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'chunks', 'text is null', CAST(chunk_id AS VARCHAR), 1 FROM parts WHERE text IS NULL UNION ALL SELECT 'chunks', 'kind unknown', CAST(chunk_id AS VARCHAR), 1 FROM parts WHERE kind IS NULL
UNION ALL SELECT 'chunks', 'doc_id unknown', CAST(doc_id AS VARCHAR), count(*) FROM parts WHERE doc_id NOT IN (SELECT doc_id FROM all_docs) GROUP BY doc_id
UNION ALL SELECT 'chunks', 'doc_id, kind, table_ordinal, page_start, text_md5 repeated', doc_id || '/' || kind || '/' || t || '/' || page_start || '/' || md5(text), count(*) FROM parts WHERE kind IS NOT NULL AND t IS NOT NULL AND page_start IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, kind, t, page_start, text HAVING count(*) > 1
UNION ALL SELECT 'facts', 'doc_id, table_ordinal, row_label, column_label repeated', doc_id || '/' || table_ordinal || '/' || row_label || '/' || column_label, count(*) FROM ftable GROUP BY doc_id, table_ordinal, row_label, column_label HAVING count(*) > 1
UNION ALL SELECT 'facts', 'chunk_id unknown', CAST(chunk_id AS VARCHAR), count(*) FROM refs WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM parts) GROUP BY chunk_id"""

ORACLE["answer_summary"] = f"""WITH {_RETRIEVED}, {_FIRST}, {_JUDGED}, timed AS (SELECT j.*, round(o_totalprice / 1000, 1) AS seconds FROM judged j JOIN orders ON o_orderkey = qid)
SELECT "group", outcome, count(*) AS n, round(median(seconds), 6) AS median_seconds, round(sum(seconds) / 3600, 6) AS hours FROM timed GROUP BY GROUPING SETS (("group", outcome), ("group"), ())"""
_RATES = ", ".join([f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS r{k}" for k in (1, 5, 10, 20)])
ORACLE["retrieval_summary"] = f"""WITH {_EVALUATED}, kinds AS (SELECT *, CASE WHEN answer_words >= 4 THEN 'sentence' ELSE 'figure' END AS answer FROM results)
SELECT "group", condition, answer, count(*) AS n, {_RATES}, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, {_ANY}, round(avg(coalesce(cov20, 0)), 6) AS mean20, round(median(best_overlap), 6) AS median_overlap,
(list(best_overlap ORDER BY best_overlap) FILTER (best_overlap IS NOT NULL))[CAST(floor(0.9 * (count(best_overlap) - 1)) AS INTEGER) + 1] AS p90_overlap, count(*) FILTER (n_inputs > 0) AS n_with_inputs, round(median(n_inputs) FILTER (n_inputs > 0), 6) AS median_inputs,
max(n_inputs) FILTER (n_inputs > 0) AS most_inputs, count(*) FILTER (n_inputs > 20) AS over_k FROM kinds GROUP BY GROUPING SETS (("group", condition), ("group", condition, answer))"""
ORACLE["document_overview"] = r"""WITH t AS (SELECT conv_id, turn, role = 'user' AS head, length(text) % 3 AS cols, round(length(text) / 4000, 6) AS bottom, regexp_matches(text || CASE WHEN turn % 3 = 0 THEN ' (In Millions) ' ELSE '' END, '(?i)\((?:in\s+)?(millions|thousands|billions)\)') AS inside,
regexp_matches(text || CASE WHEN turn % 4 = 1 THEN ' (thousands)' ELSE '' END, '(?i)\((?:in\s+)?(millions|thousands|billions)\)') AS beside FROM conversations),
f AS (SELECT a.conv_id, string_agg(b.turn || '>' || a.turn, ',' ORDER BY b.turn, a.turn) AS fragments FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.cols = b.cols WHERE NOT a.head AND b.head GROUP BY a.conv_id),
c AS (SELECT conv_id AS doc_id, count(*) AS n_pages, count(*) AS n_tables, count(*) AS n_texts, count(*) FILTER (NOT head) AS n_headless, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT head), '') AS headless, max(bottom) FILTER (bottom <> 0) AS lowest,
count(*) FILTER (inside) AS n_marked, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (inside), '') AS marked, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (beside AND NOT inside), '') AS marked_elsewhere FROM t GROUP BY conv_id)
SELECT c.*, coalesce(fragments, '') AS fragments FROM c LEFT JOIN f ON f.conv_id = doc_id"""
_ENGLISH = f"""{_RETRIEVED}, fact_src AS (SELECT fact_id AS id, fact_text AS text FROM ftable), asked_terms AS (SELECT qid, {_terms('search_text')} AS terms FROM scoped), {oracle_english.any_ranked("fact_src", "asked_terms")}, lexical AS (SELECT * FROM english),"""
ORACLE["retrieve_english"] = f"WITH {_ENGLISH} {_HYBRID[_HYBRID.index('eligible AS') :]} SELECT qid, rank, id AS fact_id, rrf FROM placed WHERE rank <= k_facts"
