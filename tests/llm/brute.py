"""Plain versions of the problems' statements, over all pairs, for small tables."""

import json
import unicodedata
from collections import defaultdict


def words(text):
    text = "".join(c for c in text or "" if unicodedata.category(c) != "Cf")
    text = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split(" ") if text.strip() else []


def form(text):
    return " ".join(w for w in words(text) if w)


def grams(f):
    return {f[i : i + 5] for i in range(len(f) - 4)} or {f}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(list)
    for n in nodes:
        out[find(n)].append(n)
    return list(out.values())


def canonical(v):
    if isinstance(v, str):
        return ("s", form(v))
    if isinstance(v, dict):
        return ("o", tuple(sorted(((form(k), canonical(x)) for k, x in v.items()), key=repr)))
    if isinstance(v, list):
        return ("a", tuple(map(canonical, v)))
    if v is None or isinstance(v, bool):
        return ("c", v)
    return ("n", float(v))


def p1(documents, items, least=10):
    windows = defaultdict(set)
    for i, s in items:
        w = form(s).split(" ")
        for k in range(len(w) - least + 1):
            windows[tuple(w[k : k + least])].add(i)
    return {(d, i) for d, t in documents for w in [form(t).split(" ")] for k in range(len(w) - least + 1) for i in windows.get(tuple(w[k : k + least]), ())}


def p2(rows):
    groups = defaultdict(list)
    for r, s, q in rows:
        try:
            groups[form(s), canonical(json.loads(q))].append(r) if form(s) and q is not None else None
        except ValueError:
            pass
    return {(min(v), x) for v in groups.values() for x in v if x != min(v)}


def p3(rows, threshold=0.7):
    reps = {}
    for r, s in rows:
        if form(s):
            reps[form(s)] = min(r, reps.get(form(s), r))
    fs = list(reps)
    pairs = [(reps[a], reps[b]) for i, a in enumerate(fs) for b in fs[:i] if jaccard(a, b) >= threshold]
    return {(min(g), x) for g in groups_of(pairs, list(reps.values())) for x in g if x != min(g)}


def side(split):
    s = (split or "").strip().lower()
    return {"val": "validation", "dev": "validation", "valid": "validation"}.get(s, s) or None


def p4(rows, threshold=0.7):
    usable = [(r, form(s), side(x)) for r, s, x in rows if form(s)]
    return {(min(a, b), max(a, b)) for a, f, x in usable if x == "train" for b, g, y in usable if y in ("validation", "test") and jaccard(f, g) >= threshold}


def p5(rows):
    pairs, first = [], {}
    for r, source, group, state, _ in rows:
        for key in ([("g", form(source), form(group))] if form(group) else []) + ([("s", form(state))] if form(state) else []):
            pairs.append((r, first.setdefault(key, r)))
    splits = {r: side(x) for r, _, _, _, x in rows}
    out = set()
    for g in groups_of(pairs, [r[0] for r in rows]):
        if len({splits[r] for r in g} - {None}) > 1:
            out |= {(min(g), r) for r in g if r != min(g)}
    return out
