"""Plain Python versions of what the operators return."""

import hashlib
import math
import re
import string
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii(text):
    found = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or (
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((m.start(), rank, m.end(), kind))
    count = Counter(kind for *_, kind in found)
    return (*[count[k] for k, _ in PII], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))))


def quality(text):
    w = words(text)
    triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingles(text, width=4):
    w = words(text, True)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_components(rows, width=4):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def without_repeats(rows, window=50):
    least = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(rows, items, k=10):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    lists = [(i, terms(t)) for i, t in rows]
    lists = [(i, Counter(t), len(t)) for i, t in lists if t]
    count, length = len(lists), sum(n for *_, n in lists)
    df = Counter(t for _, own, _ in lists for t in own)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, tf, n in lists:
            m = 100 - 90 + (90 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items, window=10):
    """(doc_id, words, words hit, sorted item ids) of every row."""
    windows = set()
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        windows |= {(item or "", tuple(w[k:k + window])) for k in range(max(len(w) - window + 1, 1)) if w}
    by_start = {}
    for item, w in windows:
        by_start.setdefault(w[0], []).append((str(item), w))
    out = []
    for i, text in rows:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for k, word in enumerate(w):
            for item, own in by_start.get(word, ()):
                if tuple(w[k:k + len(own)]) == own:
                    hit |= set(range(k, k + len(own)))
                    names.add(item)
        out.append((i, len(w), len(hit), sorted(names)))
    return out


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(i, text):
    """(n, form, prefix length, middle length, output)."""
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"42:{'' if i is None else i}")
    a, b, c, d = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if d % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
