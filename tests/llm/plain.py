"""Plain single-machine versions that the operators are compared with."""

import re

ODD = "doc_id long, text string, `Digest` string, kept string, rank int"


def odd_rows(texts):
    """Documents with null and repeated ids, and columns whose names clash with those the operators use."""
    rows = [(i, t, "x", None, i) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], None, "y", None), (None, None, None, None, None), (1, texts[1], "x", None, 1), (2, "another text under a known id", "", "", 7)]


def words(text, pattern):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, low)


def item_words(text):
    return words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k):
    w = words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def links_of(rows, k, percent):
    """All pairs of rows (id, text) that are similar enough, by comparing every two."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                yield i, j


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def python_free(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)
