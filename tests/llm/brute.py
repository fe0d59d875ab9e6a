"""Plain Python forms of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    """Smallest reachable node of each node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def shingles(text, length):
    w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    if len(w) < length:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + length]) for i in range(len(w) - length + 1))


def near_duplicates(rows, length, percent=80):
    """{row number: (n_shingles, component)} of (id, text) rows."""
    sets = [shingles(t, length) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    comp = groups(range(len(rows)), links)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[comp[i]] = min(key, least.get(comp[i], key))
    return [(key, len(sets[i]), least[comp[i]]) for i, (key, _) in enumerate(rows)]


def repeats(texts, window):
    """(words, removed, kept text) of each text."""
    all_words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
