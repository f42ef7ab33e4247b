"""DuckDB SQL for English full text: tokens, stems, ranks. Nothing is shared with the library, so that neither repeats the other's errors."""

from __future__ import annotations

_STOP = "list_value(" + ", ".join(
    f"'{w}'" for w in (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
        "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
        "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
        "don should now"
    ).split()
) + ")"
_L, _A = r"\p{L}", r"[\p{L}\p{Nd}]"
_HOST = r"[\p{L}\p{Nd}][\p{L}\p{Nd}-]*(?:\.[\p{L}\p{Nd}][\p{L}\p{Nd}-]*)*\.\p{L}[\p{L}\p{Nd}-]*(?::[0-9]+)?"
_HYPHENATED = r"[0-9]*\p{L}[\p{L}\p{Nd}]*(?:-[\p{L}\p{Nd}]+)+"
_TOKEN = "|".join(
    [
        r"<[/!?]?[A-Za-z][^<>]*>", r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", r"[A-Za-z]+://", r"[\p{L}\p{Nd}][\p{L}\p{Nd}._+-]*@[\p{L}\p{Nd}][\p{L}\p{Nd}-]*(?:\.[\p{L}\p{Nd}][\p{L}\p{Nd}-]*)+",
        _HOST + r'(?:/[^\x09-\x0d <>"]*)?', r"(?:[\p{L}\p{Nd}]+(?:[._-][\p{L}\p{Nd}]+)*)?(?:/[\p{L}\p{Nd}]+(?:[._-][\p{L}\p{Nd}]+)*)+", r"[0-9]+\.[0-9]+\.[0-9]+(?:\.[0-9]+)*",
        r"[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+", r"[+-]?[0-9]+\.[0-9]+", _HYPHENATED, r"[0-9]*\p{L}[\p{L}\p{Nd}]*", r"[+-]?[0-9]+",
    ]
)
_SHORT = "(^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$)"


def _step(name: str, before: str, cases: list[tuple[str, str, str]]) -> str:
    """A step: of the suffixes (longest first) the first that fits decides; with its condition it is cut and replaced."""
    whens = " ".join(f"WHEN ends_with(w, '{end}') THEN CASE WHEN {condition} THEN {made} ELSE w END" for end, condition, made in cases)
    return f"{name} AS (SELECT w0, r1, r2, CASE WHEN done THEN w {whens} ELSE w END AS w, done FROM {before})"


def _cut(end: str, to: str = "") -> str:
    return f"left(w, length(w) - {len(end)}) || '{to}'"


def _in(region: str, end: str) -> str:
    return f"length(w) - {len(end)} >= {region}"


def _replace(region: str, rules: str) -> list[tuple[str, str, str]]:
    pairs = [(x.split(">") + [""])[:2] for x in rules.split()]
    return [(end, _in(region, end), _cut(end, to)) for end, to in sorted(pairs, key=lambda p: -len(p[0]))]


def _stems(words: str) -> str:
    """CTEs that end in stems(w0, stem), from words(w0): distinct lower-cased words of letters and hyphens."""
    step2 = _replace("r1", "tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al fulness>ful ousli>ous ousness>ous iveness>ive iviti>ive biliti>ble bli>ble fulli>ful lessli>less")
    step2 += [("ogi", _in("r1", "ogi") + " AND w LIKE '%logi'", _cut("ogi", "og")), ("li", _in("r1", "li") + " AND regexp_matches(w, '[cdeghkmnrt]li$')", _cut("li"))]
    step3 = sorted(_replace("r1", "tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful ness") + _replace("r2", "ative"), key=lambda c: -len(c[0]))
    step4 = sorted(_replace("r2", "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize") + [("ion", _in("r2", "ion") + " AND regexp_matches(w, '[st]ion$')", _cut("ion"))], key=lambda c: -len(c[0]))
    past = {end: f"left(w, length(w) - {len(end)})" for end in ("ingly", "edly", "ing", "ed")}
    mended = "CASE WHEN regexp_matches({0}, '(at|bl|iz)$') THEN {0} || 'e' WHEN regexp_matches({0}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({0}, length({0}) - 1) WHEN length({0}) <= r1 AND regexp_matches({0}, '" + _SHORT + "') THEN {0} || 'e' ELSE {0} END"
    step1b = [("eedly", _in("r1", "eedly"), _cut("eedly", "ee")), *[(end, f"regexp_matches({base}, '[aeiouy]')", mended.format(base)) for end, base in past.items() if len(end) > 3], ("eed", _in("r1", "eed"), _cut("eed", "ee")), *[(end, f"regexp_matches({base}, '[aeiouy]')", mended.format(base)) for end, base in past.items() if len(end) <= 3]]
    return f"""
marked AS (SELECT w0, regexp_replace(regexp_replace(w0, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
ones AS (SELECT w0, w, coalesce(nullif(length(regexp_extract(w, '^(?:gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])')), 0), length(w)) AS r1 FROM marked),
twos AS (SELECT w0, w, r1, r1 + coalesce(nullif(length(regexp_extract(w[r1 + 1 :], '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length(w) - r1) AS r2, length(w0) <= 2 AS done FROM ones),
step1a AS (SELECT w0, r1, r2, CASE WHEN done THEN w WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN w LIKE '%us' OR w LIKE '%ss' THEN w
  WHEN w LIKE '%s' AND regexp_matches(left(w, greatest(length(w) - 2, 0)), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w, done FROM twos),
finals AS (SELECT w0, r1, r2, w, done OR w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS done FROM step1a),
{_step("step1b", "finals", step1b)},
step1c AS (SELECT w0, r1, r2, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w, done FROM step1b),
{_step("step2", "step1c", step2)},
{_step("step3", "step2", step3)},
{_step("step4", "step3", step4)},
step5 AS (SELECT w0, CASE WHEN done THEN w WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}'))) THEN left(w, length(w) - 1) WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM step4),
odd(w0, stem) AS (VALUES ('skis', 'ski'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('idly', 'idl'), ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'), ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'), ('atlas', 'atlas'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes')),
stems AS (SELECT s.w0, coalesce(o.stem, replace(w, 'Y', 'y')) AS stem FROM step5 s LEFT JOIN odd o ON o.w0 = s.w0)"""


def vectors(source: str, more: str = "SELECT 0 AS id, '' AS text WHERE FALSE") -> str:
    """CTEs that end in vecs(id, lexeme, positions), from source(id, text); and stem_of(w0, stem) with the words of more too."""
    parts = f"""CASE WHEN regexp_full_match(token, '(?s)<.*>|&.*;|[A-Za-z]+://') OR strlen(token) >= 2047 THEN [] WHEN regexp_full_match(token, '(?s)({_HOST})(/.*)') THEN [token, regexp_extract(token, '(?s)^({_HOST})(/.*)$', 1), regexp_extract(token, '(?s)^({_HOST})(/.*)$', 2)]
  WHEN regexp_full_match(token, '{_HYPHENATED}') THEN list_concat([token], string_split(token, '-')) ELSE [token] END"""
    found = f"regexp_extract_all(text, '{_TOKEN}')"
    split = f"SELECT id, ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS sub FROM (SELECT id, ord, {parts} AS parts FROM (SELECT id, unnest({found}) AS token, generate_subscripts({found}, 1) AS ord FROM __source))"
    return f"""
split_parts AS ({split.replace("__source", source)}),
more_texts AS ({more}), more_parts AS ({split.replace("__source", "more_texts")}),
letter_words AS (SELECT DISTINCT lower(part) AS w0 FROM (SELECT part FROM split_parts UNION ALL SELECT part FROM more_parts) WHERE regexp_full_match(part, '{_L}+(?:-{_L}+)*')),
{_stems("letter_words")},
named_parts AS (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY ord, sub) AS spot, lower(part) AS low, regexp_full_match(part, '{_L}+(?:-{_L}+)*') AS plain FROM split_parts),
placed_parts AS (SELECT id, least(spot, 16383) AS spot, CASE WHEN plain THEN stem ELSE low END AS lexeme FROM named_parts LEFT JOIN stems ON plain AND w0 = low WHERE NOT (plain AND list_contains({_STOP}, low))),
vecs AS (SELECT id, lexeme, (list(DISTINCT spot ORDER BY spot))[1:255] AS positions FROM placed_parts GROUP BY id, lexeme)"""


#: What a lexeme with so many positions adds to a rank, in single precision; n is a column.
def occurrence(n: str) -> str:
    total = f"list_reduce(list_transform(range(1, {n} + 1), lambda j: CAST(CAST(0.1 AS FLOAT)::DOUBLE / (j * j) AS FLOAT)), lambda a, b: CAST(a::DOUBLE + b::DOUBLE AS FLOAT))"
    return f"CAST(CAST(CAST(0.1 AS FLOAT)::DOUBLE + ({total})::DOUBLE AS FLOAT)::DOUBLE - CAST(0.1 AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE / 1.64493406685::DOUBLE"


def rank_any(parts: str, n: str) -> str:
    """Rank by a list of what each lexeme adds, in order of the lexemes, of n in the query."""
    total = f"list_reduce(list_prepend(0.0::DOUBLE, {parts}), lambda a, b: CAST(a + b AS FLOAT)::DOUBLE)"
    return f"CAST(({total}) / {n} AS FLOAT)::DOUBLE"


def rank_pair(later: str, earlier: str) -> str:
    """Rank by the positions of two lexemes that belong together."""
    near = "CASE WHEN abs(a - b) > 100 THEN CAST(1e-30 AS FLOAT) ELSE CAST(1.0::DOUBLE / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a - b)::DOUBLE / 1.5::DOUBLE - 2)) AS FLOAT) END"
    one = f"CAST(sqrt(CAST(CAST(CAST(0.1 AS FLOAT)::DOUBLE * CAST(0.1 AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE * ({near})::DOUBLE AS FLOAT)::DOUBLE) AS FLOAT)::DOUBLE"
    each = f"flatten(list_transform({later}, lambda a: list_transform(list_filter({earlier}, lambda b: b <> a), lambda b: {one})))"
    return f"CASE WHEN len({each}) = 0 THEN CAST(1e-20 AS FLOAT)::DOUBLE ELSE list_reduce({each}, lambda r, c: CAST(1.0::DOUBLE - (1.0::DOUBLE - r) * (1.0::DOUBLE - c) AS FLOAT)::DOUBLE) END"


ORACLE: dict[str, str] = {}
_SHOWN = "SELECT id AS {0}, count(*) AS n, md5(string_agg(shown, ' ' ORDER BY shown)) AS vector_md5 FROM (SELECT id, '''' || lexeme || ''':' || array_to_string(positions, ',') AS shown FROM vecs) GROUP BY id"
ORACLE["text_vectors"] = f"WITH src AS (SELECT doc_id AS id, text FROM documents), {vectors('src')} {_SHOWN.format('doc_id')}"
ORACLE["page_vectors"] = f"WITH src AS (SELECT page_id AS id, html AS text FROM pages), {vectors('src')} {_SHOWN.format('page_id')}"


def any_ranked(source: str, asked: str) -> str:
    """CTEs that end in english(qid, id, score), for queries asked(qid, terms) of words any of which will do, each a token of its own."""
    return f"""{vectors(source, "SELECT 0 AS id, array_to_string(flatten(list(terms)), ' ') AS text FROM " + asked)},
asked_words AS (SELECT DISTINCT qid, CASE WHEN regexp_full_match(term, '[a-z]+') THEN stem ELSE term END AS lexeme FROM (SELECT qid, unnest(flatten(list_transform(terms, lambda t: string_split(t, '&')))) AS term FROM {asked}) LEFT JOIN stems ON w0 = term WHERE NOT list_contains({_STOP}, term)),
asked_sizes AS (SELECT qid, count(*) AS n FROM asked_words GROUP BY qid),
english AS (SELECT qid, id, {rank_any("list(part ORDER BY lexeme)", "any_value(n)")} AS score FROM (SELECT qid, id, lexeme, n, {occurrence("len(positions)")} AS part FROM vecs JOIN asked_words USING (lexeme) JOIN asked_sizes USING (qid)) GROUP BY qid, id)"""


def lexical(terms: str) -> str:
    return f"""WITH src AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS qid, {terms} AS terms FROM benchmark), {any_ranked("src", "asked")},
placed AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM english) SELECT * FROM placed WHERE rank <= 10"""


_PAIR = f"(list_filter(regexp_extract_all(text, '[a-z]{{5,}} [a-z]{{5,}}'), lambda p: NOT list_contains({_STOP}, string_split(p, ' ')[1]) AND NOT list_contains({_STOP}, string_split(p, ' ')[2])))[1]"
_LAST = f"list_filter(regexp_extract_all(text, '[a-z]{{5,}}'), lambda w: NOT list_contains({_STOP}, w))[-1]"
ORACLE["lexical_phrase"] = f"""WITH src AS (SELECT doc_id AS id, text FROM documents), chosen AS (SELECT item_id AS qid, item_id % 3 AS kind, string_split({_PAIR}, ' ') AS pair, {_LAST} AS last_word FROM benchmark),
{vectors("src", "SELECT 0 AS id, array_to_string(list(pair[1] || ' ' || pair[2] || ' ' || last_word), ' ') AS text FROM chosen")},
stemmed AS (SELECT qid, kind, a.stem AS p1, b.stem AS p2, c.stem AS w3 FROM chosen JOIN stems a ON a.w0 = pair[1] JOIN stems b ON b.w0 = pair[2] JOIN stems c ON c.w0 = last_word),
lexeme_lists AS (SELECT *, list_sort(list_distinct(CASE WHEN kind = 2 THEN [p1, p2] ELSE [p1, p2, w3] END)) AS lexemes FROM stemmed),
hits AS (SELECT qid, id, map_from_entries(list((lexeme, positions))) AS held FROM (SELECT qid, unnest(lexemes) AS lexeme FROM lexeme_lists) JOIN vecs USING (lexeme) GROUP BY qid, id),
tested AS (SELECT l.*, id, held, coalesce(len(list_filter(held[p1], lambda x: list_contains(held[p2], x + 1))) > 0, FALSE) AS phrase, list_transform(list_filter(lexemes, lambda x: held[x] IS NOT NULL), lambda x: held[x]) AS have FROM hits JOIN lexeme_lists l USING (qid)),
fitting AS (SELECT * FROM tested WHERE CASE kind WHEN 0 THEN phrase OR held[w3] IS NOT NULL WHEN 1 THEN held[p1] IS NOT NULL AND held[w3] IS NOT NULL AND held[p2] IS NULL ELSE phrase END),
scored AS (SELECT qid, id, CASE WHEN kind = 0 OR len(lexemes) = 1 THEN {rank_any("list_transform(have, lambda h: " + occurrence("len(h)") + ")", "len(lexemes)")} WHEN len(have) = 1 THEN CAST(1e-20 AS FLOAT)::DOUBLE ELSE {rank_pair("have[2]", "have[1]")} END AS score FROM fitting),
placed AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) SELECT * FROM placed WHERE rank <= 10"""
