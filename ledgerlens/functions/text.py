"""Column expressions over question, fact and passage text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no retrieval signal in a question about figures.
NOISE = [
    "what", "was", "were", "is", "are", "the", "for", "of", "in", "at", "on",
    "and", "or", "to", "from", "by", "with", "how", "much", "many", "did",
    "does", "do", "give", "response", "question", "relying", "details", "shown",
    "statement", "statements", "company", "fiscal", "year", "amount", "value",
    "please", "answer", "based", "according", "provided", "usd", "using",
]

# Jargon and the words that filings print instead.
EXPANSIONS = {
    "capex": "capital expenditures purchases of property plant and equipment",
    "cogs": "cost of goods sold cost of sales cost of revenue",
    "opex": "operating expenses",
    "ebitda": "EBITDA earnings before interest taxes depreciation and amortization",
    "ebit": "EBIT operating income",
    "fcf": "free cash flow cash provided by operating activities",
    "eps": "earnings per share",
    "roic": "return on invested capital",
    "nci": "noncontrolling interest",
    "ppe": "property plant and equipment",
    "pp&e": "property plant and equipment",
    "sg&a": "selling general and administrative expenses",
    "r&d": "research and development expenses",
    "d&a": "depreciation and amortization",
    "top line": "net sales revenue",
    "bottom line": "net income",
    "working capital": "total current assets total current liabilities",
    "quick ratio": "cash and cash equivalents receivables total current liabilities",
    "current ratio": "total current assets total current liabilities",
}

# How people write company names (squashed), and the names as filings have them.
COMPANY_ALIASES = {
    "JNJ": "JOHNSON JOHNSON",
    "JANDJ": "JOHNSON JOHNSON",
    "JOHNSONANDJOHNSON": "JOHNSON JOHNSON",
    "AMEX": "AMERICANEXPRESS",
    "AMERICANEXPRESSCOMPANY": "AMERICANEXPRESS",
    "JPM": "JPMORGAN",
    "JPMORGANCHASE": "JPMORGAN",
    "MGM": "MGMRESORTS",
    "AMD": "AMD",
    "PGE": "PG E",
    "PACIFICGASANDELECTRIC": "PG E",
    "COKE": "COCACOLA",
    "THECOCACOLACOMPANY": "COCACOLA",
    "LOCKHEED": "LOCKHEEDMARTIN",
    "ULTA": "ULTABEAUTY",
    "ACTIVISION": "ACTIVISIONBLIZZARD",
    "KRAFT": "KRAFTHEINZ",
    "GENERALMILLSINC": "GENERALMILLS",
    "AMERICANWATER": "AMERICANWATERWORKS",
    "BOSTONPROPERTIESINC": "BOSTONPROPERTIES",
}

# Patterns.
TERM = r"[A-Za-z][A-Za-z0-9&']*|\d{4}"
NUMBER = r"-?\$?\(?\d[\d,]*\.?\d*\)?%?"
TOKEN = r"\d[\d,]*(?:\.\d+)?"
SCALE = r"(?i)\((?:in\s+)?(millions|thousands|billions)\)"
CITATION = r"\[([FC]\d+)\]"
FIGURE = r"(?<![A-Za-z0-9])-?\$?\d[\d,]*(?:\.\d+)?(?![A-Za-z0-9])"
NUMERIC_QUESTION = (
    r"(?i)\b(what is|what was|how much|how many|amount|total|value of|capex|capital expenditure|revenue|net sales|net income|margin|ratio|"
    r"assets|liabilities|cash flow|ebitda|eps|dividend|inventory|\$|usd|millions?|billions?)\b"
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def squash(text: Column) -> Column:
    """Upper case, letters and digits only: how company names are compared."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def query_terms(text: Column, limit: int = 12, noise: list[str] = NOISE) -> Column:
    """The first distinct content words of a question, lower-cased."""
    words = F.transform(_all(text, TERM), lambda w: F.trim(F.lower(w), F.lit("'")))
    keep = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(noise))
    return F.slice(F.array_distinct(keep), 1, limit)


def expand_terms(text: Column, expansions: dict[str, str] = EXPANSIONS) -> Column:
    """The question, then the filing's words for each jargon term in it, in order of appearance; whole terms, longest first."""
    pattern = "|".join(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" for t in sorted(expansions, key=len, reverse=True))
    lookup = F.create_map(*[F.lit(x) for pair in expansions.items() for x in pair])
    found = F.transform(F.array_distinct(_all(F.lower(text), pattern)), lambda t: F.element_at(lookup, t))
    return F.when(F.size(found) > 0, F.concat_ws(" ", text, F.array_join(found, " "))).otherwise(text)


def numbers(text: Column) -> Column:
    """Distinct magnitudes of all numbers in a text, to four decimals; signs, currency, commas and brackets are dropped."""

    def read(token: Column) -> Column:
        bare = F.trim(F.replace(F.replace(F.trim(token, F.lit("%")), F.lit("$"), F.lit("")), F.lit(","), F.lit("")), F.lit("()"))
        return F.round(F.abs(bare.try_cast("double")), 4)

    return F.array_distinct(F.filter(F.transform(_all(text, NUMBER), read), lambda x: x.isNotNull()))


def number_tokens(text: Column) -> Column:
    """Distinct numeric tokens as printed that have three characters or more, commas aside."""
    return F.array_distinct(F.filter(_all(text, TOKEN), lambda t: F.length(F.replace(t, F.lit(","), F.lit(""))) >= 3))


def as_float(token: Column) -> Column:
    """The value of a numeric token; null if it is none."""
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def scale_of(text: Column) -> Column:
    """The scale that a text states in brackets (millions, thousands or billions), or null."""
    return F.nullif(F.lower(F.regexp_extract(text, SCALE, 1)), F.lit(""))


def same_figure(target: Column, found: Column) -> Column:
    """Equal at the scale stated, a thousand times up or a thousand times down."""
    return (F.abs(target - found) < 0.01) | (F.abs(target * 1000 - found) < 0.01) | (F.abs(target / 1000 - found) < 1e-6)


def any_figure(targets: Column, found: Column) -> Column:
    return F.exists(targets, lambda t: F.exists(found, lambda f: same_figure(t, f)))


def trigrams(text: Column) -> Column:
    """Distinct word trigrams over a-z0-9 of the lower-cased text, joined by spaces."""
    words = _all(F.lower(text), "[a-z0-9]+")
    rest = lambda n: F.slice(words, n, F.greatest(F.size(words) - 2, F.lit(0)))
    pairs = F.zip_with(rest(1), rest(2), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.zip_with(pairs, rest(3), lambda a, b: F.concat_ws(" ", a, b)))


def collapse(text: Column) -> Column:
    """White-space runs to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def answer_words(text: Column) -> Column:
    return F.size(_all(text, "[A-Za-z]{3,}"))


def fiscal_year(text: Column) -> Column:
    """FY and a year beats a bare 20xx; null without either."""
    marked = F.nullif(F.regexp_extract(text, r"(?i)\bFY\s?(\d{4})\b", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit(""))
    return F.coalesce(marked, bare).cast("int")


def citations(text: Column) -> Column:
    return F.array_distinct(_all(text, CITATION, 1))


def figures(text: Column) -> Column:
    """Figures of an answer outside its citations, as printed; bare years from 1900 to 2100 are left out."""
    prose = F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, " ")

    def is_year(token: Column) -> Column:
        bare = F.replace(token, F.lit("$"), F.lit(""))
        return F.regexp_like(bare, F.lit(r"^\d{4}$")) & F.coalesce(bare.try_cast("int").between(1900, 2100), F.lit(False))

    return F.filter(_all(prose, FIGURE), lambda t: ~is_year(t))


def figure_value(token: Column) -> Column:
    return F.abs(F.regexp_replace(token, "[$,]", "").try_cast("double"))


def follow_up(question: Column, previous: Column) -> Column:
    """A question of six words or fewer is searched with the previous one before it."""
    short = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != "")) <= 6
    return F.when(short & previous.isNotNull() & (previous != ""), F.concat_ws(" ", previous, question)).otherwise(question)


def company_of(doc_name: Column) -> Column:
    """The leading parts of a file name before one that begins with a year or is a form type; the whole name if none lead."""
    parts = F.split(doc_name, "_")
    stop = F.transform(parts, lambda p: F.regexp_like(p, F.lit(r"^(19|20)\d{2}")) | F.regexp_like(p, F.lit(r"(?i)^(10K|10Q|8K|EARNINGS)$")))
    place = F.array_position(stop, F.lit(True)).cast("int")
    found = F.when(place > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(place - 1, F.lit(0))), "_")).otherwise(doc_name)
    return F.coalesce(F.nullif(found, F.lit("")), doc_name)


def fact_text(company: Column, context: Column, row: Column, column: Column, value: Column, scale: Column) -> Column:
    """The non-empty parts of a fact joined by middle dots: the context without the colons that end it, the value with its scale."""
    amount = F.trim(F.concat_ws(" ", value, F.coalesce(scale, F.lit(""))))
    parts = [company, F.regexp_replace(context, ":+$", ""), row, column, amount]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " · ")


def scrub(text: Column) -> Column:
    """Text without NUL characters."""
    return F.regexp_replace(text, r"\x00", "")
