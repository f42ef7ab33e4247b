"""English full text: tokens of a text, their lexemes and positions, and queries as a web search has them.

A lexeme is the stem (Porter's second algorithm) of a word of letters that is no stop word; numbers, mixed words, hosts,
addresses, files and versions are lexemes as they are, lower-cased. Positions count all tokens, stop words too. A hyphenated
word gives itself and then its parts, an address with a path itself, its host and its path. Marks, character references and
protocols are no tokens.
"""

from __future__ import annotations

import re

import regex

# Words that are too common to search for.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now""".split()
)

# Words whose stem no rule gives, and words that the first step leaves as they are for good.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())

# Suffixes and what takes their place, by step.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

#: A lexeme is shorter than this many bytes; a position is at most LAST, and a lexeme keeps at most MOST of them.
BYTES, LAST, MOST = 2047, 16383, 255

_A = r"[\p{L}\p{Nd}]"
_PART = rf"{_A}+(?:[._-]{_A}+)*"
_HOST = rf"{_A}[\p{{L}}\p{{Nd}}-]*(?:\.{_A}[\p{{L}}\p{{Nd}}-]*)*\.\p{{L}}[\p{{L}}\p{{Nd}}-]*(?::[0-9]+)?"
#: Tokens: mark, character reference, protocol, e-mail, host with path, file, version, number with exponent, fraction, hyphenated word, word, number.
TOKEN = "|".join(
    [
        r"<[/!?]?[A-Za-z][^<>]*>", r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", r"[A-Za-z]+://",
        rf"{_A}[\p{{L}}\p{{Nd}}._+-]*@{_A}[\p{{L}}\p{{Nd}}-]*(?:\.{_A}[\p{{L}}\p{{Nd}}-]*)+",
        rf'{_HOST}(?:/[^\x09-\x0d <>"]*)?',
        rf"(?:{_PART})?(?:/{_PART})+", r"[0-9]+\.[0-9]+\.[0-9]+(?:\.[0-9]+)*", r"[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+", r"[+-]?[0-9]+\.[0-9]+",
        rf"[0-9]*\p{{L}}{_A}*(?:-{_A}+)+", rf"[0-9]*\p{{L}}{_A}*", r"[+-]?[0-9]+",
    ]
)
_token = regex.compile(TOKEN)
_no_token = regex.compile(r"<.*>|&.*;|[A-Za-z]+://", regex.S)
_with_path = regex.compile(rf"({_HOST})(/.*)", regex.S)
_hyphenated = regex.compile(rf"[0-9]*\p{{L}}{_A}*(?:-{_A}+)+")
_letters = regex.compile(r"\p{L}+(?:-\p{L}+)*")

_region = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_first_region = re.compile("gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy]")
_short = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_vowel = re.compile("[aeiouy]")


def _suffix(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in, or none."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _vowel.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    end = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= first else word
    if not end or not _vowel.search(base):
        return word
    if base.endswith(("at", "bl", "iz")) or (len(base) <= first and _short.search(base)):
        return base + "e"
    return base[:-1] if base[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt") else base


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that is a consonant is marked: the first letter, or one after a vowel.
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    found = _first_region.match(word)
    first = found.end() if found else len(word)
    found = _region.match(word, first)
    second = found.end() if found else len(word)
    word = _plural(word)
    if word in DONE:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _suffix(word, STEP_2)
    base = word[: len(word) - len(end)]
    if end and len(base) >= first and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in tuple("cdeghkmnrt")):
        word = base + STEP_2[end]
    end = _suffix(word, STEP_3)
    base = word[: len(word) - len(end)]
    if end and len(base) >= (second if end == "ative" else first):
        word = base + STEP_3[end]
    end = _suffix(word, STEP_4)
    base = word[: len(word) - len(end)]
    if end and len(base) >= second and (end != "ion" or base[-1:] in ("s", "t")):
        word = base
    base = word[:-1]
    if word.endswith("e") and (len(base) >= second or (len(base) >= first and not _short.search(base))):
        word = base
    elif word.endswith("ll") and len(base) >= second:
        word = base
    return word.replace("Y", "y")


def _lexeme(part: str) -> str | None:
    """The lexeme of a token; none for a stop word."""
    low = part.lower()
    if not _letters.fullmatch(part):
        return low
    return None if low in STOP else stem(low)


#: Lexemes of tokens that a worker has met; it starts anew when there are too many.
_known: dict[str, tuple[str | None, ...]] = {}


def lexemes(token: str) -> tuple[str | None, ...]:
    """What a token gives, a position each; none where a stop word stands."""
    found = _known.get(token)
    if found is None:
        if _no_token.fullmatch(token) or len(token.encode()) >= BYTES:
            found = ()
        elif path := _with_path.fullmatch(token):
            found = tuple(x.lower() for x in (token, path[1], path[2]))
        elif _hyphenated.fullmatch(token):
            found = tuple(_lexeme(x) for x in (token, *token.split("-")))
        else:
            found = (_lexeme(token),)
        if len(_known) >= 1 << 18:
            _known.clear()
        _known[token] = found
    return found


def vector(text: str) -> dict[str, list[int]]:
    """The lexemes of a text with their positions."""
    out: dict[str, list[int]] = {}
    at = 0
    for token in _token.findall(text):
        for lexeme in lexemes(token):
            at += 1
            if lexeme is not None:
                held = out.setdefault(lexeme, [])
                if len(held) < MOST and (not held or held[-1] != LAST):
                    held.append(min(at, LAST))
    return out


def _phrase(text: str):
    """The tree of words that follow each other: their lexemes, each with its distance from the one before; none if all are stop words."""
    chain, at, last = [], 0, None
    for token in _token.findall(text):
        for lexeme in lexemes(token):
            at += 1
            if lexeme is not None:
                chain.append((lexeme, 0 if last is None else at - last))
                last = at
    return ("phrase", tuple(chain)) if chain else None


_query = re.compile(r'(-*)(?:"([^"]*)"?|([^\s"]+))')


def websearch(text: str):
    """The tree of a query: words in quotes follow each other, OR between words, a minus before what must not be there; all else together.

    Nodes: ("phrase", ((lexeme, distance), ...)), ("not", node), ("and", nodes), ("or", nodes); none if only stop words are left.
    """
    either: list[list] = [[]]
    for minus, quoted, bare in _query.findall(text):
        if bare and not minus and bare.lower() == "or":
            if either[-1]:
                either.append([])
            continue
        node = _phrase(quoted or bare)
        if node is not None:
            either[-1].append(("not", node) if len(minus) % 2 else node)
    nodes = [x[0] if len(x) == 1 else ("and", tuple(x)) for x in either if x]
    return None if not nodes else nodes[0] if len(nodes) == 1 else ("or", tuple(nodes))


def operands(tree) -> list[str]:
    """The distinct lexemes of a tree in byte order."""
    if tree is None:
        return []
    if tree[0] == "phrase":
        found = {lexeme for lexeme, _ in tree[1]}
    else:
        found = {x for node in ([tree[1]] if tree[0] == "not" else tree[1]) for x in operands(node)}
    return sorted(found, key=str.encode)


def matches(tree, held: dict[str, list[int]]) -> bool:
    """Whether a text with these positions fits the tree."""
    if tree[0] == "not":
        return not matches(tree[1], held)
    if tree[0] in ("and", "or"):
        return (all if tree[0] == "and" else any)(matches(node, held) for node in tree[1])
    (lexeme, _), *rest = tree[1]
    ends = set(held.get(lexeme, ()))
    for lexeme, distance in rest:
        ends = {at for at in held.get(lexeme, ()) if at - distance in ends}
    return bool(ends)
