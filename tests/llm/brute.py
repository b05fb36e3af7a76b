"""Brute-force versions, as the contracts state them."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(texts, k, percent):
    """For each text a number that it shares with those that links reach; and its set's size."""
    sets = [frozenset(shingle_set(t, k)) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    return [(find(i), len(s)) for i, s in enumerate(sets)]


def components(docs, k, percent):
    """docs: (doc_id, text) -> (doc_id, n, smallest id)."""
    found, least = groups([t for _, t in docs], k, percent), {}
    for (d, _), (r, _) in zip(docs, found, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, n, least.get(r)) for (d, _), (r, n) in zip(docs, found, strict=True)]


def one_of_each_group(rows, k, percent):
    """Rows (doc_id and text among them) without a set, and of each group the first by doc_id (none last) and digest of the text."""
    out, first = [], {}
    for row, (r, n) in zip(rows, groups([x.text for x in rows], k, percent), strict=True):
        if not n:
            out.append(row)
            continue
        place = (row.doc_id is None, row.doc_id or 0, hashlib.md5(row.text.encode()).hexdigest())
        if r not in first or place < first[r][0]:
            first[r] = (place, row)
    return out + [row for _, row in first.values()]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits(x):
    return re.sub("[^0-9]", "", x)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
)
SECRETS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)


def pii(text):
    return [(k, m.start(), m.end()) for k, p, good in PII for m in re.finditer(p, text or "") if good(m[0])]


def secrets(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, good) in enumerate(SECRETS) for m in re.finditer(p, text or "") if good(m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def quality(text):
    w = WORD.findall(text or "")
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    chars, n = sum(map(len, w)), len(w)
    return n, chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n
