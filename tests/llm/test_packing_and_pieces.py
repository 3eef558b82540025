import math
import os
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from meridian.llm.best_fit_packing import best_fit, best_fit_packing
from meridian.llm.exact_dedup import exact_dedup
from meridian.llm.line_crf import crf_quality
from meridian.llm.queries import PIECE_MODEL, QUERIES
from meridian.llm import sentencepiece_sampling as pieces
from meridian.llm.sentencepiece_sampling import Lattices, Vocabulary, decoded, sample_group, sampled_encodings

from . import helpers


# packing ---------------------------------------------------------------------------------------
def plain_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for size, _, source, cluster in pieces:
        ok = [(capacity - sum(p[0] for p in b) - size, i) for i, b in enumerate(bins) if sum(p[0] for p in b) + size <= capacity and all(p[3] != cluster for p in b) and sum(p[2] == source for p in b) < per_source]
        i = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([])
        out.append((i, sum(p[0] for p in bins[i])))
        bins[i].append((size, 0, source, cluster))
    return out


def test_best_fit_equals_a_full_scan():
    rng = random.Random(1)
    for _ in range(20):
        pieces = [(rng.randrange(1, 60), i, rng.choice("aaabcd"), rng.randrange(40)) for i in range(150)]
        assert best_fit(pieces, 100, 2) == plain_best_fit(pieces, 100, 2)


def check_bins(rows, capacity, per_source, info):
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= capacity
        if len(members) > 1:
            assert max(Counter(info[r.doc_id][0] for r in members).values()) <= per_source
            assert len({info[r.doc_id][1] for r in members}) == len(members)
    return bins


def test_packed_tables(spark, sf_dir):
    docs = {r.doc_id: r for r in helpers.table(spark, sf_dir, "documents").collect()}
    info = {d: (r.source, tuple(helpers.words((r.text or "").translate(helpers.LOWER)))) for d, r in docs.items()}
    rows = best_fit_packing(helpers.table(spark, sf_dir, "documents"), capacity=1000, per_source=3, shard_pieces=64).collect()
    bins = check_bins(rows, 1000, 3, info)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for d, (_, words) in info.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(words)
    assert sum(r.n_tokens for r in rows) / 1000 / len(bins) > 0.8


# pieces ----------------------------------------------------------------------------------------
def test_round_trip_and_distinct_samples(spark, sf_dir):
    docs = helpers.table(spark, sf_dir, "documents")
    found = sampled_encodings(docs, PIECE_MODEL, k=3)
    rows, texts = found.collect(), helpers.texts_of(spark, sf_dir)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for d, found_rows in by.items():
        found_rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in found_rows] == [1, 2, 3] and len({bytes(r.ids) for r in found_rows}) == 3
        assert all(a.perturbed > b.perturbed for a, b in zip(found_rows, found_rows[1:], strict=False)) and all(0 < r.inclusion <= 1 for r in found_rows)
    assert all(bytes(r.text).decode() == texts[r.doc_id] for r in decoded(found, PIECE_MODEL).collect())


def test_query_gives_ids_and_decoded_texts(spark, sf_dir):
    rows, texts = QUERIES["op7_sentencepiece_sampling"](spark, sf_dir).collect(), helpers.texts_of(spark, sf_dir)
    v, by = Vocabulary(PIECE_MODEL), {}
    for r in rows:
        assert len(r.ids) == 4 * r.n_pieces and bytes(r.text).decode() == texts[r.doc_id] == v.decode(np.frombuffer(r.ids, np.int32)).decode()
        by.setdefault(r.doc_id, set()).add((r.rank, bytes(r.ids)))
    assert by.keys() == texts.keys()
    assert all({rank for rank, _ in found} == {1, 2, 3, 4} and len({ids for _, ids in found}) == 4 for found in by.values())


def test_odd_texts_come_back():
    v = Vocabulary(PIECE_MODEL)
    texts = ["▁ weird ▁x  two  spaces ".encode(), b"", "日本語 😀\n\n\t".encode(), b"bad \xff\xfe", b" ", b"\n", b"x" * 5000, "\x00\x01".encode()]
    for t, found in zip(texts, sample_group(texts, list(range(len(texts))), 4, v), strict=True):
        assert found and all(v.decode(ids) == t for _, _, _, ids in found)


def test_words_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "é", " ", "  ", "\n", "▁", "x y"]) for _ in range(rng.randrange(12))).encode() for _ in range(300)]
    distinct, numbers = pieces.words_of(texts)
    assert len(set(distinct)) == len(distinct)
    for t, n in zip(texts, numbers, strict=True):
        assert [distinct[i] for i in n] == (re.findall(r" *[^ \n]+| +|\n", " " + t.decode()) if t else [])


def test_few_segmentations_are_all_found():
    """Sets are counted by paths, however little mass they have."""
    v = Vocabulary(PIECE_MODEL)
    v.logs = np.where(np.arange(len(v.logs)) % 2, v.logs, v.logs - 60)  # masses far below what a double's sum can hold
    for text in (b"a", b"th", b"the", b"of a"):
        one, all_ids = Lattices(["".join(w) for w in pieces.words_of([text])[0]], v), set()
        n = int(np.prod(one.paths[one.first]))
        found = sample_group([text], [3], 400, v)[0]
        all_ids = {tuple(x[3].tolist()) for x in found}
        assert n <= 400 and len(found) == len(all_ids) == n and found[0][2] == 1.0


def test_samples_depend_on_the_key_and_not_on_neighbours():
    v = Vocabulary(PIECE_MODEL)
    alone = sample_group([b"some words here"], [7], 3, v)[0]
    among = sample_group([b"other words", b"some words here", b"some words here"], [1, 7, 8], 3, v)
    same = lambda a, b: [x[3].tolist() for x in a] == [x[3].tolist() for x in b]
    assert same(alone, among[1]) and not same(alone, among[2])


def test_sampling_without_replacement_has_the_right_distribution():
    v, text, n = Vocabulary(PIECE_MODEL), b"the cat", 4000
    every = {tuple(ids.tolist()): phi for phi, _, _, ids in sample_group([text], [5], 40, v)[0]}
    p = {s: math.exp(phi) for s, phi in every.items()}
    assert abs(sum(p.values()) - 1) < 1e-9
    seen, first, weighted = Counter(), Counter(), Counter()
    for found in sample_group([text] * n, list(range(n)), 2, v):
        first[tuple(found[0][3].tolist())] += 1
        for phi, _, q, ids in found:
            seen[tuple(ids.tolist())] += 1
            weighted[tuple(ids.tolist())] += math.exp(phi) / q
    for s in sorted(p, key=p.get)[-4:]:
        second = sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)
        assert abs(first[s] / n - p[s]) < 4 * math.sqrt(p[s] / n) and abs(seen[s] / n - p[s] - second) < 4 * math.sqrt(p[s] / n) + 0.01
    # inclusion scores make the weighted sample unbiased
    assert abs(sum(weighted.values()) / n - 1) < 0.05


def test_model_scores_are_a_distribution():
    v = Vocabulary(PIECE_MODEL)
    assert abs(np.exp(v.logs).sum() - 1) < 1e-9


def test_vocabulary_is_built_once_a_worker(monkeypatch, tmp_path):
    model = tmp_path / "pieces.model"
    model.write_bytes(open(PIECE_MODEL, "rb").read())
    monkeypatch.setattr(pieces.SparkFiles, "get", lambda name: str(tmp_path / name))
    one = pieces._open("pieces.model", 1.0)
    assert pieces._open("pieces.model", 1.0) is one
    os.utime(model, ns=(1, 1))  # another file of that name
    assert pieces._open("pieces.model", 1.0) is not one


def test_ends_of_words_are_shared():
    v, words = Vocabulary(PIECE_MODEL), [" nation", " station", "nation", "ion", " on", "\n", " ", " é", "é", "日本語", " 日本語", " ▁x"]
    one, known = Lattices(words, v), {v.raw[i] for i in v.ids.tolist()}
    assert len(one.chars) == len({w[i:] for w in words for i in range(len(w))})

    def paths(w):
        return sum(paths(w[n:]) for n in range(1, len(w) + 1) if n == 1 or "▁" not in w[:n] and w[:n].encode() in known) if w else 1

    assert one.paths[one.first].tolist() == [paths(w) for w in words]
    for w in words:  # neighbours don't matter
        alone = Lattices([w], v)
        (a, n), (b, m) = (x.sample(np.array([i] * 50), np.arange(50, dtype=np.uint64)) for x, i in ((one, words.index(w)), (alone, 0)))
        assert n.tolist() == m.tolist() and one.ids[a].tolist() == alone.ids[b].tolist() and np.allclose(one.log_p[a], alone.log_p[b], atol=1e-9)


def test_splits_leave_out_no_set_that_can_come_up(monkeypatch):
    """The first words, if they are enough, give what all words give."""
    v, rng = Vocabulary(PIECE_MODEL), random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "nation", "thonre", "a"]) for _ in range(rng.randrange(1, 900))).encode() for _ in range(60)]
    found, looked = {}, []
    for reach in (2, 10**6):
        monkeypatch.setattr(pieces, "REACH", reach)
        queue = pieces._Search._queue
        monkeypatch.setattr(pieces._Search, "_queue", lambda self, todo, width, *rest, queue=queue: looked.append((width, len(todo))) or queue(self, todo, width, *rest))
        found[reach] = [[(x[3].tolist(), *(round(y, 6) for y in x[:3])) for x in rows] for rows in sample_group(texts, list(range(60)), 4, v)]
        monkeypatch.undo()
    assert found[2] == found[10**6]
    assert 0 < sum(n for width, n in looked if width == 1024) < 60  # of four splits of 60 texts


# pipeline --------------------------------------------------------------------------------------
def test_pipeline_equals_its_plain_version(spark, sf_dir):
    docs = helpers.table(spark, sf_dir, "documents")
    stages = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        stages[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").distinct().collect()) for name, df in stages.items()}
    texts = helpers.texts_of(spark, sf_dir)
    good = sorted(r.doc_id for r in crf_quality(docs, helpers.table(spark, sf_dir, "labels")).where("predicted = 1").collect())
    assert ids["quality"] == good
    last = {}
    for d in good:
        last[texts[d]] = max(d, last.get(texts[d], d))
    assert ids["exact copies"] == sorted(last.values())
    near = helpers.components({d: helpers.shingle_set(texts[d], 5) for d in last.values()}, 80)
    assert ids["near copies"] == sorted(d for d, c in near.items() if c == d)
    assert ids["personal data"] == ids["near copies"] == ids["packing"]
    clean = {r.doc_id: r for r in stages["personal data"].collect()}
    from .test_urls_and_pii import plain_spans

    for d, r in clean.items():
        spans = plain_spans(texts[d])
        assert (r.n_chars == len(r.text) or r.text == texts[d]) and not any(texts[d][a:b] in r.text for a, b, _ in spans)
        if "[" not in r.text:
            assert r.text == texts[d]
    info = {d: (r.source, tuple(helpers.words(r.text.translate(helpers.LOWER)))) for d, r in clean.items()}
    packed = stages["packing"].collect()
    check_bins(packed, 4096, 4, info)
    assert sum(r.n_tokens for r in packed) == sum(len(w) for _, w in info.values())
    assert exact_dedup(stages["near copies"]).where("not kept").count() == 0
    for df in stages.values():
        df.unpersist()


def test_pipeline_leaves_the_tables_of_its_last_stage_only(spark, sf_dir):
    import os

    import corpus_pipeline

    from meridian.session import shared_root

    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    rows = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(root)) - before
    assert rows.count() and len(left) <= 4  # what the last stage reads: its input, and its own tables
