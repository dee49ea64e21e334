"""The contracts, spelled out slowly over Python lists."""

import hashlib
import re
from collections import Counter, defaultdict


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def decontaminated(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words = split(text)
    hit, found = set(), set()
    for item, t in items:
        w = split(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), sha(names), bool(hit) and 20 * len(hit) >= len(words)


def repeats_removed(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def jaccard_components(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    owner = defaultdict(list)
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        met = Counter(b for x in s for b in owner[x])
        for b, n in met.items():
            if 100 * n >= 90 * (len(s) + len(sets[b][1]) - n):
                root[top(a)] = top(b)
        for x in s:
            owner[x].append(a)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[top(a)].append(i)
    return [(i, len(s), min(least[top(a)], default=None)) for a, (i, s) in enumerate(sets)]


def secrets(text):
    text = text or ""
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    kinds = {
        "assign": (word + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    spans = [
        (m.start(), k, kind, m.end())
        for k, (kind, (pattern, good)) in enumerate(kinds.items())
        for m in re.finditer(pattern, text)
        if good(m)
    ]
    count = Counter(s[2] for s in spans)
    shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    return count["assign"], count["access"], count["hex"], sha(shown)
