"""Plain versions of the operators, for small tables."""

import hashlib
import re


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def near(rows, k, percent):
    """{id: (set size, component)} by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def hits(docs, items):
    """{id: (n_words, n_hit, n_items, items_sha256)} by sliding every window over every document."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(ascii_lower(t or ""))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = pattern.findall(ascii_lower(t or ""))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if got := windows.get(tuple(w[p : p + n])):
                    found |= got
                    hit[p : p + n] = [1] * n
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def base_spans(text):
    """The base kinds' spans of a text, by the contract's words."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def passages(rows, least=25):
    """{id: (spans, what is left)} of (id, text), by looking every pair of units up in all earlier documents."""
    cut = {}
    for i, t in rows:
        units, at = [], 0
        for piece in re.findall(r"(?s)(?:(?!\n|[\u3002\uff01\uff1f]|[.!?][ \t\r\f]).)*(?:[.!?][ \t\r\f]|[\n\u3002\uff01\uff1f]|$)", t or ""):
            norm = " ".join(piece.lower().split())
            if norm and units and units[-1][0] == norm:
                units[-1] = (norm, units[-1][1], at + len(piece))
            elif norm:
                units.append((norm, at, at + len(piece)))
            at += len(piece)
        cut[i] = units
    size = lambda n: max(len(n.split(" ")), len(n) // 8)
    out = {}
    for i, t in rows:
        u = cut[i]
        n = len(u)
        names = [x[0] for x in u]
        alone, pairs = set(), set()
        for j, other in cut.items():
            if j < i:
                alone |= {x[0] for x in other}
                pairs |= {(a[0], b[0]) for a, b in zip(other, other[1:])}  # noqa: B905
        gone = [False] * n
        for k in range(n):
            if size(names[k]) >= least and (names[k] in alone or names[k] in names[:k]):
                gone[k] = True
        late = [(names[k], names[k + 1]) in pairs or any((names[m], names[m + 1]) == (names[k], names[k + 1]) for m in range(k)) for k in range(n - 1)]
        for a in range(n):
            for b in range(a + 1, n):
                if all(late[a:b]) and sum(map(size, names[a : b + 1])) >= least:
                    gone[a : b + 1] = [True] * (b + 1 - a)
        spans = []
        for k in range(n):
            if gone[k] and k and gone[k - 1]:
                spans[-1] = (spans[-1][0], u[k][2])
            elif gone[k]:
                spans.append((u[k][1], u[k][2]))
        left, at = "", 0
        for a, b in spans:
            left, at = left + t[at:a], b
        out[i] = (spans, left + (t or "")[at:])
    return out
