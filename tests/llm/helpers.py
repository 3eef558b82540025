"""Plain versions of definitions, for comparison."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def shingle_set(text, size):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(sets, percent):
    """{id: smallest id reachable} by comparing all pairs that share a shingle."""
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by, order = {}, sorted(sets)
    for d in order:
        near = set()
        for s in sets[d]:
            near |= by.setdefault(s, set())
            by[s].add(d)
        for o in near:
            both = len(sets[d] & sets[o])
            if 100 * both >= percent * (len(sets[d]) + len(sets[o]) - both):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}
