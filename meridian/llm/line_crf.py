"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is good or bad; its features are those of the line and of its
neighbours. The field is trained in numpy on the lines of a bounded sample of labelled documents. At
first each line takes its document's label; then, in rounds, lines whose marginals contradict it most
change sides, up to half of a document's length, and the field is trained on: so a junk line in a
good text may be bad, and the moves between states are learnt from texts of both. A document's
quality is the mean of its lines' marginal probabilities of being good, weighted by their length,
and mapped so that the best cut over all labelled documents of the training folds lies at 0.7. In
choosing the cut a good text that is lost weighs as much as three bad ones that pass: a filter
should leave clean documents alone.

Defined results: null, empty or blank text has no lines and scores 0; a null id is scored like any
other; repeated rows get equal scores; very long texts are scored whole, while of a sampled one at most
4,096 lines train the field (``doc_lines``; 2**18 lines in all, ``sample_lines``); without
labelled rows of both kinds every text with a line scores 0.7 (nothing is known against it); an empty
table gives an empty result; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BY_SHUFFLE, RUNTIME_FILTER, SPACE, as_bytes, cut, only_ids, run_hashes, settings, tidy
from .labelled import fold, smallest_hashes

GROUP_BYTES = 1 << 20  # documents are worked on together up to this size
OWN = ["upper", "lower", "digit", "symbol", "exclaim", "bar", "other", "end_symbol", "per_word", "repeats", "twins", "length"]


def _classes() -> np.ndarray:
    """Each byte's class: upper, lower (and all non-ASCII), digit, symbol, exclamation mark, bar, other, white space."""
    c = np.full(256, 6, dtype=np.uint8)
    c[ord("A") : ord("Z") + 1] = 0
    c[ord("a") : ord("z") + 1] = 1
    c[128:] = 1
    c[ord("0") : ord("9") + 1] = 2
    for ch in b"#*$%&<>=~^_{}[]\\@":
        c[ch] = 3
    c[ord("!")], c[ord("|")] = 4, 5
    c[SPACE] = 7
    return c


CLASS = _classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, F) of all lines with a word, their lengths in bytes, and the number of lines of each text."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buf == 10) + 1
    starts = np.concatenate(([0], ends[:-1]))
    kind = CLASS[buf]
    counts = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(8)], axis=1)
    space = kind == 7
    first = ~space & np.concatenate(([True], space[:-1]))
    word_line = np.repeat(np.arange(len(starts)), np.add.reduceat(first, starts, dtype=np.int64))
    n_words = np.bincount(word_line, minlength=len(starts))
    odd = (kind >= 3) & (kind <= 4)
    end_symbol = np.add.reduceat(odd & np.concatenate((space[1:], [True])), starts, dtype=np.int64)
    begins = np.flatnonzero(first)
    hashes = run_hashes(buf, begins, np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 - begins)[0]
    same_line = word_line[1:] == word_line[:-1]
    twins = np.bincount(word_line[1:][same_line & (hashes[1:] == hashes[:-1])], minlength=len(starts))
    order = np.lexsort((hashes, word_line))
    h, w = hashes[order], word_line[order]
    repeats = np.bincount(w[1:][(h[1:] == h[:-1]) & (w[1:] == w[:-1])], minlength=len(starts))
    text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    has = n_words > 0
    counts, n, text_of = counts[has], np.maximum(1, n_words[has]), text_of[has]
    visible = np.maximum(1, counts[:, :7].sum(axis=1))
    own = np.concatenate(
        [counts[:, :7] / visible[:, None], np.stack([end_symbol[has] / n, np.minimum(3, visible / n / 8), repeats[has] / n, twins[has] / n, np.log1p(n) / 5], axis=1)], axis=1
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (text_of[1:] == text_of[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    features = np.concatenate([np.ones((len(own), 1)), own, own**2, before, after], axis=1)
    return features, visible.astype(np.float64), np.bincount(text_of, minlength=len(texts))


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: P(good) of each line, expected moves (2, 2), and the sum of log Z.

    ``scores``: of state good against bad; ``moves[i, j]``: score of going from i to j (0 bad, 1 good).
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    node = np.stack([np.zeros(n), scores], axis=1)
    lengths = lengths[lengths > 0]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # chains longer than t
    forward, backward = node.copy(), np.zeros((n, 2))
    for t in range(1, lengths[0]):
        at = starts[: active[t]] + t
        forward[at] += np.logaddexp(forward[at - 1, 0, None] + moves[0], forward[at - 1, 1, None] + moves[1])
    for t in range(lengths[0] - 1, 0, -1):
        at = starts[: active[t]] + t
        x = node[at] + backward[at]
        backward[at - 1] = np.logaddexp(x[:, 0, None] + moves[:, 0], x[:, 1, None] + moves[:, 1])
    total = forward + backward
    p = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    log_z = np.logaddexp(total[:, 0], total[:, 1])
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + moves[None] + (node + backward)[at][:, None, :] - log_z[at][:, None, None]
    return p, np.exp(pair).sum(axis=0), float(log_z[starts].sum())


def train(features: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = 250, l2: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that maximise the likelihood of the lines' labels (Adam, full batches)."""
    lengths = lengths[lengths > 0]
    weights, moves = start or (np.zeros(features.shape[1]), np.zeros((2, 2)))
    inner = np.ones(len(good), dtype=bool)
    inner[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[at - 1], good[at]), 1)
    m = v = np.zeros(len(weights) + 4)
    for step in range(1, rounds + 1):
        p, moved, _ = marginals(features @ weights, moves, lengths)
        grad = np.concatenate([features.T @ (p - good) / len(good) + l2 * weights, ((moved - seen) / len(good)).ravel() + l2 * moves.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, moves = weights - change[:-4], moves - change[-4:].reshape(2, 2)
    return weights, moves


def quality_of(p: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals; 0 for texts without lines."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.bincount(text, size, minlength=len(lengths))
    return np.bincount(text, p * size, minlength=len(lengths)) / np.maximum(weight, 1e-9)


def contradicted(p: np.ndarray, size: np.ndarray, good: np.ndarray, lengths: np.ndarray, sure: float = 0.9) -> np.ndarray:
    """The documents' labels of all lines, but for those lines that the marginals are ``sure`` to be otherwise: the surest first, up to half of a document's length."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    labels = good[text]
    against = np.where(labels == 1, 1 - p, p)
    order = np.lexsort((-against, text))
    upto = np.cumsum(size[order])
    before = np.concatenate(([0.0], upto))[np.searchsorted(text[order], text[order])]
    whole = np.bincount(text, size, minlength=len(lengths))[text[order]]
    flip = order[(against[order] > sure) & (2 * (upto - before) <= whole)]
    labels[flip] = 1 - labels[flip]
    return labels


def learn(features: np.ndarray, size: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves, the lines' labels being re-estimated ``rounds`` times."""
    model = train(features, lengths, np.repeat(good, lengths))
    for _ in range(rounds):
        p = marginals(features @ model[0], model[1], lengths)[0]
        model = train(features, lengths, contradicted(p, size, good, lengths), rounds=100, start=model)
    return model


def best_cut(at: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best accuracies, from counts of texts by quality; losing a good text weighs as much as passing three bad ones."""
    if len(at) < 2:
        return 0.5
    hit = 3 * (1 - np.cumsum(good)[:-1] / max(1, good.sum())) + np.cumsum(bad)[:-1] / max(1, bad.sum())
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    i = max(best.tolist(), key=lambda i: at[i + 1] - at[i])
    return float(np.clip((at[i] + at[i + 1]) / 2, 0.02, 0.98))


def grouped(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _extract(doc_lines: int):
    """Features and sizes of the lines of each sampled text; of a longer one, of ``doc_lines`` lines from its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(2)):
                f, size, _ = line_features([text])
                middle = slice(at := max(0, (len(size) - doc_lines) // 2), at + doc_lines)
                out.append((len(size[middle]), f[middle].astype(np.float32).tobytes(), size[middle].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], names=["label_id", "label", "n", "features", "sizes"])

    return run


def qualities(model, texts: list[bytes]) -> np.ndarray:
    """Length-weighted marginals of the texts; -1 for texts without lines."""
    out = [np.zeros(0)]
    for group in grouped(texts):
        features, size, lengths = line_features(group)
        p = np.ones(len(size)) if model is None else marginals(features @ model[0], model[1], lengths)[0]
        out.append(np.where(lengths > 0, quality_of(p, size, lengths), -1))
    return np.concatenate(out)


def _rate(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(qualities(model, as_bytes(batch.column(1))))], names=["doc_id", "x"])

    return run


def _keep(model, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(qualities(model, as_bytes(batch.column(at))) >= least))

    return run


def labelled(labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(label_id, label) of the training folds, one row an id (the worse one where there are several)."""
    known = labels.where(F.col("quality").isin(0, 1)).where(fold("doc_id", folds) != held_out)
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("label"))


DOC_LINES, SAMPLE_LINES = 4096, 1 << 18


def fit(rows: DataFrame, known: DataFrame, sample_docs: int, doc_lines: int = DOC_LINES, sample_lines: int = SAMPLE_LINES):
    """Weights and moves from a bounded sample of (doc_id, text), or nothing without labels of both kinds.

    The sample has at most ``sample_docs`` texts, ``doc_lines`` lines of each, and ``sample_lines`` lines
    in all, half for each label: 100 MB of features at 2**18 lines, however long the texts are.
    """
    # half of the sample for each label, at most; one text an id, so that repeated ids don't break the bound
    sample = [smallest_hashes(known.where(F.col("label") == y), "label_id", sample_docs // 2) for y in (0, 1)]
    sample = rows.join(F.broadcast(sample[0].unionByName(sample[1])), rows.doc_id == F.col("label_id")).groupBy("label_id", "label").agg(F.min("text").alias("text")).select("label_id", "label", "text")
    lines = cut(sample.mapInArrow(tidy(_extract(doc_lines)), "label_id long, label int, n int, features binary, sizes binary"))
    upto = F.sum("n").over(W.partitionBy("label").orderBy(F.xxhash64("label_id", F.lit(17)), "label_id"))  # of sample_docs rows
    found = lines.withColumn("upto", upto).where(F.col("upto") <= sample_lines // 2).select("label", "features", "sizes").collect()
    width = 1 + 4 * len(OWN)
    found = sorted(((r.label, bytes(r.features), bytes(r.sizes)) for r in found if len(r.sizes)), key=lambda r: r[1:])
    y = np.array([r[0] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    features = np.concatenate([np.frombuffer(r[1], np.float32).reshape(-1, width) for r in found]).astype(np.float64)
    sizes = [np.frombuffer(r[2], np.float64) for r in found]
    return learn(features, np.concatenate(sizes), np.array([len(s) for s in sizes]), y)


STEPS = 2000  # the cut is chosen in steps of 1/2000 of the quality


def rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, sample_docs: int, every: bool):
    """The model, the cut, and (doc_id, x) of ``every`` document, or of those whose labels are known; without a model the cut is 0.5 and x is 1 for texts with lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labelled(labels, folds, held_out)
    model = fit(rows, known, sample_docs)
    with settings(docs.sparkSession, **RUNTIME_FILTER, **BY_SHUFFLE):
        rows = rows if every or model is None else only_ids(rows, known.select(F.col("label_id").alias("doc_id")), "doc_id")
        x = cut(rows.mapInArrow(tidy(_rate(model)), "doc_id long, x double"))
    if model is None:
        return None, 0.5, x
    seen = x.where("x >= 0").join(known, F.col("doc_id") == F.col("label_id"))
    counts = sorted(seen.groupBy(F.floor(F.col("x") * STEPS).alias("step")).agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")).collect())  # 2,001 steps at most
    return model, best_cut((np.array([r.step for r in counts]) + 0.5) / STEPS, *(np.array([r[c] for r in counts]) for c in ("bad", "good"))), x


def crf_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, sample_docs: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels (doc_id, quality) are learnt from the other folds only; ``sample_docs`` bounds the labelled
    documents that the field is fitted on (those with the smallest hash of their id, half per label).
    """
    model, least, x = rated(docs, labels, id_col, text_col, folds, held_out, sample_docs, every=True)
    q = F.col("x")
    score = F.lit(0.7) if model is None else F.when(q < least, 0.7 * q / least).otherwise(F.least(F.lit(1.0), 0.7 + 0.3 * (q - least) / (1 - least)))
    score = F.when(q >= 0, score).otherwise(0.0)
    return x.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def crf_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, sample_docs: int = 4000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches 0.7; without a shuffle of texts."""
    model, least, _ = rated(docs, labels, id_col, text_col, folds, held_out, sample_docs, every=False)
    return docs.mapInArrow(tidy(_keep(model, docs.columns.index(text_col), least)), docs.schema)
