"""Plain single-process versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, item ids)} of (doc_id, text) rows."""
    phrases = {}
    for item, text in items:
        words = WORD.findall(lower_ascii(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[k : k + window]), set()).add("" if item is None else str(item))
    sizes = sorted({len(p) for p in phrases})
    out = {}
    for doc, text in docs:
        words = WORD.findall(lower_ascii(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                owners = phrases.get(tuple(words[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def jaccard_components(docs, num=90, den=100, size=3):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for doc, text in docs:
        sets.setdefault(doc, []).append(shingles(text, size))
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, many in sets.items():
        for s in many:
            for g in s:
                where.setdefault(g, set()).add(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        for x in sets[a]:
            for y in sets[b]:
                if x and y and den * len(x & y) >= num * len(x | y):
                    up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (sorted(len(s) for s in many), find(d)) for d, many in sets.items()}


def repeats(docs, length=100):
    """{doc_id: (bytes, spans, bytes kept)} of (doc_id, text) rows with distinct keys."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\x01" * length
            seen.add(window)
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(gone))]
        out[doc] = (len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def top_products(rows, k=5, every=50, scale=256):
    """Sorted (query, rank, id, score) of (id, vector) rows."""
    whole = []
    for key, v in rows:
        if key is not None and v and all(x is not None and abs(scale * x) < 2**63 for x in v):
            whole.append((key, [math.floor(scale * x) for x in v]))
    out = []
    for key, v in whole:
        if key % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), other) for other, w in whole if other != key and len(v) == len(w)]
            out += [(key, n + 1, other, -score) for n, (score, other) in enumerate(sorted(found)[:k])]
    return sorted(set(out))


def quotes(rows):
    """{(conv, place): (text without quotes, passages, linked, parent, by quote)} of (conv, turn, role, text) rows.

    Quotes are looked for by going through all earlier messages.
    """
    def plain(text):
        return " ".join(re.findall(r"[^\W_]+", text.lower()))

    def units(text):
        return [u for u in map(plain, [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]) if u]

    placed, out, held = {}, {}, {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        placed.setdefault(conv, []).append(text or "")
    for conv, texts in placed.items():
        for place, text in enumerate(texts):
            passages = []
            for line in text.split("\n"):
                marks = re.match(r"(?:[ \t]*>)*", line)[0]
                level, body = marks.count(">"), line if not marks else re.sub(r"^[ \t]", "", line[len(marks):])
                if passages and passages[-1][0] == level:
                    passages[-1][1].append(body)
                else:
                    passages.append((level, [body]))
            own = "\n".join("\n".join(b) for level, b in passages if level == 0)
            bodies = [u for level, b in passages if level == 0 for u in units("\n".join(b))] + units(own)
            held[conv, place] = (own, set(bodies), [(level, "\n".join(b)) for level, b in passages if level and plain("\n".join(b))])
    for (conv, place), (own, _, passages) in held.items():
        def source(body):
            near = [(conv, p) for c, p in held if c == conv and p < place and body in held[c, p][1]]
            far = [(c, p) for c, p in held if body in held[c, p][1]]
            return min(near) if near else min(far) if far and min(far)[0] < conv else None

        links = []
        for number, (level, body) in enumerate(passages):
            at = source(plain(body))
            if at is None:
                parts = [(source(u)[0] != conv, -len(u), source(u)) for u in set(units(body)) if source(u)]
                at = min(parts)[2] if parts else None
            links.append((level, number, at))
        good = sorted(x for x in links if x[2])
        parent = good[0][2] if good else (conv, place - 1) if place else (None, None)
        out[conv, place] = (own, len(passages), len(good), *parent, bool(good))
    return out
