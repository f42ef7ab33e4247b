"""Plain-Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def ngram_join(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = roots(ids, links)
    return {d: (len(sets[d]), component[d]) for d in ids}


def token_rows(docs, tokenizer, end_id):
    start, rows = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        rows.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return rows


def line_runs(docs, min_words):
    """Deleted (doc, line) pairs: lines in a run of min_words words or more that occurs earlier."""
    seqs = {d: [x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")] for d, t in sorted(docs)}
    seqs = {d: [x for x in s if x] for d, s in seqs.items()}
    first, found = {}, set()
    for d, s in seqs.items():
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(s[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= min_words:
                    if run in first:
                        found |= {(d, k) for k in range(i, j)}
                    else:
                        first[run] = (d, i)
    return found


def leaks(docs, items, threshold, overlap, split, gram=3, k1=1.2, b=0.75):
    """{(doc, item): (score, question share, answer share)} of each document's best passage for an item; every item is scored whole."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    items = {i: (words(t), *map(words, split(t))) for i, t in items if words(t)}
    mean = sum(len(w) for w, _, _ in items.values()) / len(items)
    df = Counter(x for w, _, _ in items.values() for x in set(w))
    weights = {i: {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean)) for x, tf in Counter(w).items()} for i, (w, _, _) in items.items()}
    step, found = max(32, max(len(w) for w, _, _ in items.values())), {}

    def share(part, own):
        size = max(1, min(gram, len(part)))
        grams = lambda w: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        return len(grams(part) & grams(own)) / len(grams(part)) if grams(part) else 1.0

    for d, t in docs:
        text = words(t)
        for at in range(0, len(text), step):
            own = text[at : at + 2 * step]
            for i, (_, question, answer) in items.items():
                score = sum(v for x, v in weights[i].items() if x in set(own)) / sum(weights[i].values())
                shares = share(question, own), share(answer, own)
                if score >= threshold - 1e-9 and min(shares) >= overlap:
                    found[d, i] = max(found.get((d, i), ()), (round(score, 9), *shares))
    return {k: tuple(round(x, 6) for x in v) for k, v in found.items()}


def base32_sha1(payload):
    import base64

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
