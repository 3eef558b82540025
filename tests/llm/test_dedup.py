import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.llm.components import components
from meridian.llm.exact_dedup import exact_dedup
from meridian.llm.jaccard_join import jaccard_components, parity_bitmap
from meridian.llm import common
from meridian.llm import exact_dedup as exact
from meridian.llm import jaccard_join
from meridian.llm import substring_dedup as sub
from meridian.llm.substring_dedup import substring_digests, substring_dedup

from . import helpers


@pytest.mark.parametrize("digest_bytes,memtable", [(32, 50), (1, 37)])
def test_exact_dedup_even_where_digests_collide(spark, digest_bytes, memtable):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(400)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for keep, best in (("smallest", min), ("largest", max)):
        got = {r.doc_id: r for r in exact_dedup(df, keep=keep, memtable_rows=memtable, digest_bytes=digest_bytes).collect()}
        for i, t in rows:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(groups[t]), len(groups[t]), i == best(groups[t]))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_compaction_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN", 4)
    rng = random.Random(9)
    rows = [(i, f"text {rng.randrange(300)}") for i in range(1000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), range_rows=10, memtable_rows=40).collect()
    first = {}
    for i, t in rows:
        first.setdefault(t, []).append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, min(first[t]), len(first[t])) for i, t in rows}


def test_filters_prune_unique_digests_however_many_runs():
    rng = np.random.default_rng(3)
    digest = lambda n: np.sort(rng.integers(0, 256, (n, 32), dtype=np.uint8).view("S32").ravel())
    shared = digest(50)
    runs = []
    for k in range(40):
        d = np.sort(np.concatenate((digest(2000), shared)))
        runs.append((d, np.arange(len(d)) + 10_000 * k, np.ones(len(d), dtype=np.int64), exact.bloom(d)))
    tested = passed = 0
    plain = exact.maybe_in

    def counted(digests, other):
        nonlocal tested, passed
        found = plain(digests, other)
        new = ~np.isin(digests, shared)
        tested, passed = tested + new.sum(), passed + (found & new).sum()
        return found

    exact.maybe_in = counted
    try:
        d, i, c, _ = exact.compacted(runs, False)
    finally:
        exact.maybe_in = plain
    assert len(d) == 80_050 and (np.sort(d) == d).all() and (c == np.where(np.isin(d, shared), 40, 1)).all() and (i[c == 40] < 10_000).all()
    assert tested >= 40_000 and passed < 0.1 * tested


def brute_removed(docs, size):
    first = {}
    ws = {d: helpers.words(t) for d, t in docs.items()}
    for d in sorted(ws):
        for i in range(len(ws[d]) - size + 1):
            first.setdefault(tuple(ws[d][i : i + size]), d)
    out = {}
    for d, w in ws.items():
        gone = {i + j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for j in range(size)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_dedup_is_exact(spark):
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{rng.randrange(9)}" for _ in range(30)) for k in range(6)]
    docs = {}
    for i in rng.sample(range(1000), 120):
        parts = [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(20))) for _ in range(3)]
        docs[i] = f" {rng.choice(passages)}\n".join(parts) + rng.choice(["", " " + rng.choice(passages)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    want = brute_removed(docs, 8)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=8).collect()}
    assert got == want
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_digests(df, window=8).collect()}
    assert got == {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for d, (n, m, t) in want.items()}


def test_substring_dedup_with_very_many_ranges(spark, monkeypatch):
    """Runs that are dealt in two steps."""
    monkeypatch.setattr(common, "FAN", 8)
    monkeypatch.setattr(sub, "ranges", lambda rows: 100)
    rng = random.Random(6)
    docs = {i: " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(60))) for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=8).collect()} == brute_removed(docs, 8)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_structured_words_and_windows_stay_apart(spark):
    """A Thue-Morse word and its complement, which polynomials modulo 2**64 take for equal; and windows of such words."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, " ".join(a[:64])), (4, " ".join(b[:64]))], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(df).collect()} == {0}
    pairs = spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y"), (3, " ".join(a)), (4, " ".join(b))], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard_components(pairs).where("doc_id < 3").collect())


def test_rolling_hashes_equal_their_definition():
    d = common.word_digests(" ".join(f"w{i % 7}" for i in range(40)).encode())
    radices = common.drawn_radices()
    h, c = common.rabin_karp(d, 6, radices)
    fresh = [common.rabin_karp(d[i : i + 6], 6, radices) for i in range(35)]
    assert h.tolist() == [int(x[0][0]) for x in fresh] and c.tolist() == [int(x[1][0]) for x in fresh]
    assert len(set(zip(h.tolist(), c.tolist(), strict=True))) == 7
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (common.unmix(common.mix(x)) == x).all()


#: Numbers of words that, one at each of 32 places, hash as ``q0`` there to the radices below.
COLLISION = [
    56584, 124916, 123885, 7695, 106634, 122060, 39084, 78018, 28901, 51656, 12923, 60199, 50354, 10055, 88279, 51697, 76986, 100742, 35988, 72514, 18972, 44169, 49789, 29156,
    97658, 40448, 9857, 60990, 82132, 115704, 46484, 7845,
]
KNOWN_RADICES = (1_103_515_245, 1_566_083_941, 1_812_433_253)


def test_windows_made_to_agree_are_told_apart_by_their_words(spark):
    """Two windows that differ in 32 of 50 words and agree in all residues to known radices: the check by content sees it, and other radices are drawn."""
    end = [f"z{i}" for i in range(18)]
    one, two = " ".join([*(f"q{i}" for i in COLLISION), *end]), " ".join(["q0"] * 32 + end)
    a, b = (common.rabin_karp(common.word_digests(t.encode()), 50, KNOWN_RADICES) for t in (one, two))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    used = []

    def draw():
        used.append(KNOWN_RADICES if not used else common.drawn_radices())
        return used[-1]

    rows = [(1, one), (2, two), (3, f"x {two} y"), (4, one), (5, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_digests(spark.createDataFrame(rows, "doc_id long, text string"), draw=draw).collect()}
    assert got == {1: (50, 0), 2: (50, 0), 3: (52, 50), 4: (50, 50), 5: (1, 0)} and len(used) == 2
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(plain).collect()} == {d: m for d, (_, m) in got.items()}


def test_runs_that_lie_apart_in_the_earlier_document(spark):
    """Consecutive windows whose earlier copies aren't consecutive are claimed one by one."""
    w = [f"w{i}" for i in range(12)]
    docs = {1: " ".join([*w[:8], "x", *w[1:9], "y", *w[2:10]]), 2: " ".join(w), 3: " ".join(["a"] * 300), 4: " ".join(["a"] * 500 + ["b"]), 5: " ".join(["a"] * 7)}
    used = []
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=8, draw=lambda: used.append(1) or common.drawn_radices()).collect()}
    assert got == brute_removed(docs, 8) and got[2][1] == 10 and len(used) == 1


def near_copies(rng, n, edits):
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def check_components(spark, docs, shingle, percent):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    sets = {d: helpers.shingle_set(t, shingle) for d, t in docs.items()}
    want = helpers.components(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, shingle=shingle, percent=percent).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in docs}


def test_join_on_large_groups_of_near_copies(spark, monkeypatch):
    """Long lists, split in blocks, with many pairs on either side of the threshold."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rng = random.Random(11)
    texts = near_copies(rng, 220, 6) + near_copies(rng, 20, 3) + [" ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(60))) for _ in range(100)] + ["short text", "short text", "Short Text", "", None, "one"]
    ids = rng.sample(range(10_000), len(texts))
    check_components(spark, dict(zip(ids, texts, strict=True)), 4, 85)


def test_join_on_the_tables(spark, sf_dir):
    docs = helpers.texts_of(spark, sf_dir)
    check_components(spark, docs, 4, 85)
    check_components(spark, docs, 5, 80)


def chain():
    """Three texts: the ends are less than 0.9 alike, the middle one is over 0.9 like either."""
    w = [f"w{i}" for i in range(104)]
    middle, end = list(w), list(w)
    middle[100:] = ["m1", "m2", "m3", "m4"]
    end[:4] = ["e1", "e2", "e3", "e4"]
    end[100:] = middle[100:]
    return " ".join(w), " ".join(middle), " ".join(end)


def test_links_through_null_and_repeated_ids(spark):
    a, b, c = chain()
    other = " ".join(f"o{i}" for i in range(90))
    link = lambda rows: {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=90).collect()}
    assert link([(1, a), (2, b), (3, c)])[3, 101] == 1 and link([(1, a), (3, c)])[3, 101] == 3
    got = link([(1, a), (None, b), (None, b), (3, c)])
    assert got[3, 101] == got[None, 101] == 1
    # one id, two texts: each has its own links
    assert link([(5, other), (5, b), (1, a), (7, c)])[7, 101] == 1
    assert link([(5, a), (5, other), (9, other + " x"), (8, b)])[9, 88] == 5


def test_hot_tokens_meet_in_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", 500)
    rng = random.Random(12)
    texts = near_copies(rng, 60, 8) + [f"short {i % 9} text of five words" for i in range(60)]
    check_components(spark, dict(enumerate(texts)), 4, 85)


def test_long_disjoint_sets_are_not_paired():
    """Of 3,000 tokens each: the bitmaps grow with the sets."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(30)]
    near = np.unique(np.append(sets[0][:2900], rng.integers(0, 2**63, 700).astype(np.uint64)))
    sets.append(near)
    keys = [jaccard_join.set_key(x) for x in sets]
    table = pa.table({"key": pa.array(keys, pa.binary()), "comp": pa.array(keys, pa.binary()), "n": pa.array([len(x) for x in sets], pa.int32()), "bitmap": pa.array([parity_bitmap(x).tobytes() for x in sets], pa.binary()), "side": pa.array([0] * len(sets), pa.int32())})
    found = jaccard_join._crossing(70)(table).to_pylist()
    assert [{keys.index(p["a"]), keys.index(p["b"])} for p in found] == [{0, 30}]


def test_prefixes_keep_similar_pairs():
    """Any two sets at the threshold share the smaller k among their prefixes."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 5000, 1 << jaccard_join.WIDTH_BITS)
    for _ in range(300):
        n = int(rng.integers(5, 1500))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x.copy()
        for i in rng.choice(len(x), max(1, int(len(x) * rng.uniform(0, 0.09))), replace=False):
            y[i] = rng.integers(0, 2**63)
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            (a, k), (b, m) = (jaccard_join.prefix(s, counts, float(counts.mean()), 85) for s in (x, y))
            assert len(np.intersect1d(a, b)) >= min(k, m)
            p, q = (parity_bitmap(s)[None, :] for s in (x, y))
            words = min(p.shape[1], q.shape[1])
            assert np.bitwise_count(jaccard_join.folded(p, words) ^ jaccard_join.folded(q, words)).sum() <= len(np.setxor1d(x, y))


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "u long, v long").select(*(F.col(c) for c in "uv"))
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and [got[i] for i in (200, 201, 202)] == [200] * 3


def test_groups_of_near_copies_are_sent_once(spark, monkeypatch):
    """Hundreds of different near copies of one text, in blocks of 32: linked within their blocks and through the blocks' hubs, so no two blocks are compared."""

    def never(percent):
        def run(table):
            raise AssertionError("two blocks were compared")

        return run

    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "_crossing", never)
    rng = random.Random(21)
    texts = near_copies(rng, 700, 1)
    got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), shingle=4, percent=85).collect()
    assert {r.component_id for r in got} == {0} and len(set(texts)) > 300
