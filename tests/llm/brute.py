"""Plain versions of the operators, over lists of (doc_id, text); None ids come last and are one document."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash

LAST = 2**63 - 1
BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def order(doc):
    return LAST if doc is None else doc


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows):
    def key(line):
        found = line.strip(BLANKS).translate(LOWER)
        return found if len(found) >= 10 else None

    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if (k := key(line)) is not None:
                first[k] = min(first.get(k, LAST), order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if (k := key(line)) is None or first[k] == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fingerprint(text):
    words = blank_words((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = collections.Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(rows):
    prints = [fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), LAST), order(doc))
    return [(doc, prints[k], None if least[find(k)] == LAST else least[find(k)]) for k, (doc, _) in enumerate(rows)]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, window=10):
    held = collections.defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            held[tuple(words[at:at + window])].add("null" if item is None else str(item))
    out = []
    for doc, text in rows:
        words, hit, found = alnum_words(text), set(), set()
        for size in {len(w) for w in held}:
            for at in range(len(words) - size + 1):
                if own := held.get(tuple(words[at:at + size])):
                    hit.update(range(at, at + size))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substring_dedup(rows, window=13):
    first = {}
    for doc, text in rows:
        words = blank_words(text)
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, LAST), order(doc))
    out = []
    for doc, text in rows:
        words, gone = blank_words(text), set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < order(doc):
                gone.update(range(at, at + window))
        out.append((doc, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def measures(text):
    words = blank_words(text)
    count = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if count[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def periodic_runs(words):
    """(start, length, period) of all runs, period by period."""
    least = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at > start and at - start + q >= max(6, 4 * q):
                least.setdefault((start, at - start + q), q)
            at += 1
    return sorted((start, length, q) for (start, length), q in least.items())


def collapsed(words):
    gone = {k for start, length, q in periodic_runs(words) for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def hard_negatives(rows, every=100):
    """Rows (vec_id, label, vector), already of whole numbers; every row is one of its own."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (anchor, label, vector) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        told = sorted((-score(vector, v), order(i), k) for k, (i, _, v) in enumerate(rows) if k != a)
        for worth, positive, _ in [t for t in told if rows[t[2]][1] == label][:5]:
            fitting = [t for t in told if rows[t[2]][1] != label and 80 * -worth <= 100 * -t[0] <= 100 * -worth]
            out += [(anchor, None if positive == LAST else positive, rank, None if i == LAST else i, -worth, -s) for rank, (s, i, _) in enumerate(fitting[:5], 1)]
    return out


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    """(kind, start, end) in code points by the patterns as they are stated."""
    found = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            double = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(double)) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, m.end()))
    return [(PII[rank][0], a, b) for a, rank, b in sorted(found)]


def viterbi(unary, pairs):
    """Best labels of one sequence by trying all."""
    import itertools

    def worth(labels):
        return sum(u[y] for u, y in zip(unary, labels, strict=True)) + sum(pairs[a][b] for a, b in itertools.pairwise([0, *labels, 0]))

    return max(itertools.product(range(len(pairs)), repeat=len(unary)), key=worth)
