"""Plain versions of the operators, a text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone', 'iban', 'ssn')[k]}:{a}:{b}" for a, k, b in spans)


def added_spans(text):
    """iban and ssn, as (start, rank, end)."""
    out = []

    def near(m, words):
        return any(re.search(words, x, re.I) for x in (text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]))

    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        x = m[0].replace(" ", "")
        known = {"GB": 22, "DE": 22, "FR": 27}.get(x[:2]) == len(x)  # the countries that tests use
        sound = 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
        if sound and (known or near(m, r"\b(iban|account|konto|cuenta|compte|bank)\b")):
            out.append((m.start(), 4, m.end()))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if near(m, r"\b(ssn|social security|social-security)\b"):
            out.append((m.start(), 5, m.end()))
    return out


def redacted(text, spans):
    """spans: (start, rank, end), sorted."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out.append(text[at:start] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[IBAN]", "[SSN]")[kind])
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def repeats(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def near(docs):
    sets = shingle_sets(docs)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def unigram(docs):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    seen = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(seen.values()), len(seen)
    return {i: (held[i], len(w), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def edits(item, text):
    """The least edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
