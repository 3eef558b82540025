import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import line_crf as crf
from meridian.llm import ngram_quality as ng
from meridian.llm import pu_toxicity as pu
from meridian.llm.queries import QUERIES

from . import helpers


# Kneser-Ney ------------------------------------------------------------------------------------
def plain_kneser_ney(texts, order=5):
    counts = {order: Counter()}
    for t in texts:
        b = bytes(order - 1) + t
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p = {}
    for n in range(1, order + 1):
        seen = Counter(counts[n].values())
        d = ng.discounts([seen[k] for k in (1, 2, 3, 4)])
        off = lambda c: d[min(c, 3) - 1]
        total, held = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            held[g[:-1]] += off(c)
        p[n] = {g: (c - off(c) + held[g[:-1]] * (p[n - 1][g[1:]] if n > 1 else 1 / 256)) / total[g[:-1]] for g, c in counts[n].items()}
    return p[order]


def test_kneser_ney_and_counts(spark, sf_dir):
    docs = helpers.texts_of(spark, sf_dir)
    texts = {d: (t or "").encode() for d, t in docs.items()}
    p = plain_kneser_ney(texts.values())
    rows = QUERIES["op2_ngram_quality"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t, b = docs[r.doc_id] or "", bytes(4) + texts[r.doc_id]
        if len(b) > 4:
            want = -sum(math.log(p[b[i : i + 5]]) for i in range(len(b) - 4)) / (len(b) - 4)
            assert r.log_ppl == pytest.approx(want, abs=1e-5)
        w = helpers.words(t)
        lines, runs = [x for x in t.split("\n") if helpers.words(x)], list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(runs)
        again = {i + j for i, x in enumerate(runs) if often[x] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.lower <= r.log_ppl <= r.upper)


def test_rules_do_not_depend_on_ids_or_layout(spark, sf_dir):
    docs = helpers.table(spark, sf_dir, "documents")
    key = lambda df: sorted((r.n_words, r.word_chars, r.kept, round(r.log_ppl or 0, 6)) for r in df.collect())
    want = key(ng.ngram_quality(docs))
    assert key(ng.ngram_quality(docs.withColumn("doc_id", F.xxhash64("doc_id")).repartition(7))) == want
    assert key(ng.ngram_quality(docs.withColumn("doc_id", F.lit(5)).orderBy("text"))) == want


# conditional random field ----------------------------------------------------------------------
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 1, 0, 3])
    scores, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    p, expected, log_z = crf.marginals(scores, moves, lengths)
    at, want_p, want_moves, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in lengths:
        s = scores[at : at + n]
        at += n
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = [math.exp(sum(s[i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))) for y in paths]
        z = sum(w)
        if n:
            want_z += math.log(z)
            want_p += [sum(v for v, y in zip(w, paths, strict=True) if y[i]) / z for i in range(n)]
            for v, y in zip(w, paths, strict=True):
                for a, b in zip(y, y[1:], strict=False):
                    want_moves[a, b] += v / z
    assert np.allclose(p, want_p) and np.allclose(expected, want_moves) and log_z == pytest.approx(want_z)


def test_features_see_neighbours_of_the_same_text_only():
    f, size, lengths = crf.line_features([b"one two\nTHREE!! FOUR!!\n\n", b"", b"five"])
    assert lengths.tolist() == [2, 0, 1] and len(f) == 3 and size.tolist() == [6, 13, 4]
    own = len(crf.OWN)
    before, after = f[:, 1 + 2 * own : 1 + 3 * own], f[:, 1 + 3 * own :]
    assert before[0].any() == False and np.allclose(before[1], f[0, 1 : 1 + own]) and before[2].any() == False and after[1].any() == False  # noqa: E712


def accuracy(spark, sf_dir, name, column):
    rows = QUERIES[name](spark, sf_dir).join(helpers.table(spark, sf_dir, "labels"), "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    return np.mean([r.predicted == r.y for r in rows]), np.mean([r.predicted == 1 for r in rows if r.y == 1])


def test_quality_on_the_held_out_fold(spark, sf_dir):
    right, kept = accuracy(spark, sf_dir.replace("sf0.001", "sf0.01"), "op9_line_crf", "quality")
    assert right > 0.95 and kept > 0.95


def test_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs, labels = helpers.table(spark, sf_dir, "documents"), helpers.table(spark, sf_dir, "labels")
    a, b = ({r.doc_id: r.score for r in crf.crf_quality(d, labels).collect()} for d in (docs, docs.repartition(7)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


# positive-unlabelled learning --------------------------------------------------------------------
def test_toxicity_on_the_held_out_fold(spark, sf_dir):
    right, found = accuracy(spark, sf_dir.replace("sf0.001", "sf0.1"), "op3_pu_toxicity", "toxic")
    assert right > 0.97 and found > 0.9


def test_nnpu_separates_what_it_has_no_negatives_for():
    rng = np.random.default_rng(2)
    toxic = lambda n: np.concatenate([rng.random((n, 3)) < 0.8, rng.random((n, 20)) < 0.1], axis=1).astype(float)
    clean = lambda n: (rng.random((n, 23)) < np.array([0.02] * 3 + [0.1] * 20)).astype(float)
    positive, unlabelled = toxic(300), np.concatenate([toxic(200), clean(1800)])
    w, b = pu.train_nnpu(positive, unlabelled, 0.1)
    at, where = np.unique(np.concatenate((positive, unlabelled)) @ w + b, return_inverse=True)
    cut = pu.best_cut(at, np.bincount(where[:300], minlength=len(at)), np.bincount(where[300:], minlength=len(at)), 0.1)
    assert (toxic(500) @ w + b > cut).mean() > 0.9 and (clean(2000) @ w + b > cut).mean() < 0.05


def test_slots_hold_words_and_prefixes():
    s, owner = pu.slots([b"Idiot!!", b"", "ÉTÉ idiot".encode()])
    t, _ = pu.slots(["été IDIOT".encode()])
    assert set(s[owner == 0]) < set(s[owner == 2]) and sorted(t) == sorted(s[owner == 2]) and 1 not in owner


def test_ranges_of_counts_in_parts_give_the_same_model(spark, sf_dir):
    """Parts of a few bytes instead of 64 MB: the counts are added up in two steps, and each part looks the model up."""
    from meridian.llm.ngram_quality import ngram_quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda **how: sorted((r.doc_id, r.kept, round(r.log_ppl or 0, 5)) for r in ngram_quality(docs, **how).collect())
    assert rows() == rows(part_bytes=2000)


def test_chunks_are_bounded_by_bytes(spark, tmp_path):
    from meridian.llm.ngram_quality import in_chunks

    sizes = [0, 100, 10_000, 20_000, 40_000, 1_000_000, 3_000_000]
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.expr(f"repeat('x', element_at(array({', '.join(map(str, sizes))}), cast(id % 7 + 1 as int)))").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    chunks = in_chunks(docs, [F.col("doc_id"), F.octet_length("text").alias("n")], F.col("text"))
    again = {r.doc_id: r.chunk for r in in_chunks(docs, [F.col("doc_id")], F.col("text")).collect()}
    by = {}
    for r in chunks.collect():
        assert again[r.doc_id] == r.chunk
        by.setdefault(r.chunk, []).append(r.n)
    assert max(map(sum, by.values())) <= 1 << 26 and max(map(len, by.values())) >= 200
