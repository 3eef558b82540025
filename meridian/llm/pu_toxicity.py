"""Toxicity by non-negative positive-unlabelled learning.

Features are letter runs (A-Z and Latin-1 capitals lower-cased) and their prefixes of 4 to 8 bytes,
hashed. 1. Spark counts, over all documents, in how many texts each hash slot occurs, and in how many
confirmed toxic ones; the slots that toxic texts hold most in excess become features. 2. A linear
model is trained in numpy on a bounded sample of confirmed toxic texts against unlabelled ones: the
risk of the unlabelled as negative, less the class prior's share of the positives' risk as negative,
never below zero. 3. All texts get their margin; the cut that minimises the same corrected risk of the
0-1 loss over all texts of the training folds is mapped to 0.7.

Only positive labels are learnt from; the class prior is the share of them among labelled rows of the
training folds. Defined results: null, empty and letterless texts get the score of a text without
features; a null id is scored like any other; repeated rows get equal scores; without a confirmed
toxic row all texts score 0; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, RUNTIME_FILTER, U64, as_bytes, mix, only_ids, planes, polynomial, settings, summed, unplanes
from .common import cut as written
from .labelled import fold, smallest_hashes
from .line_crf import grouped

SLOT_BITS = 19
PREFIXES = (4, 5, 6, 7, 8)
CHUNKS = 16
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = True


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all letter runs and prefixes, and the index of the text that each is from."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8).copy()
    buf[(buf >= 65) & (buf <= 90)] += 32
    latin = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3) & (buf[1:] != 0x97)) + 1
    buf[latin] += 0x20
    edges = np.diff(np.concatenate(([False], LETTER[buf], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    codes, out, owner = BYTE_CODE[buf], [], []
    for size in (0, *PREFIXES):
        has = np.ones(len(starts), dtype=bool) if not size else ends - starts > size
        a = starts[has]
        h = polynomial(codes, a, a + size if size else ends)
        out.append((mix(h + U64(size)) >> U64(64 - SLOT_BITS)).astype(np.int64))
        owner.append(text[has])
    return np.concatenate(out), np.concatenate(owner)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every slot, the texts that hold it."""
    counts, n = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for group in grouped(texts):
            slot, owner = slots(group)
            counts += np.bincount(np.unique((owner << SLOT_BITS) | slot) & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
        n += len(texts)
    part = TaskContext.get().partitionId()
    parts = [planes(x) for x in np.split(counts, CHUNKS)]
    yield pa.RecordBatch.from_arrays([pa.array([part] * CHUNKS, pa.int32()), pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([n] * CHUNKS, pa.int64()), pa.array(parts, pa.binary())], names=["part", "chunk", "n", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(unplanes(x, np.int64) for x in table.column("counts").to_pylist())
    counts = pa.array([planes(total)], pa.binary())
    return pa.table({"part": table.column("part")[:1], "chunk": table.column("chunk")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "counts": counts})


def occurrences(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each slot, and all texts: 2**19 counters, whatever the input."""
    found = sorted(summed(texts.mapInArrow(_occurrences, "part int, chunk int, n long, counts binary"), _sum).collect(), key=lambda r: r.chunk)
    if not found:
        return np.zeros(1 << SLOT_BITS), 0
    return np.concatenate([unplanes(bytes(r.counts), np.int64) for r in found]).astype(np.float64), found[0].n


def pick(counts: np.ndarray, n: int, n_toxic: int, most: int) -> np.ndarray:
    """Slots that stand out among confirmed toxic texts: by the excess over their share of all texts, in standard errors."""
    rate = (counts[0] + 1) / (n + 2)
    excess = (counts[1] / n_toxic - rate) / np.sqrt(rate / n_toxic)
    ok = np.flatnonzero((counts[1] >= 3) & (excess > 3))
    return np.sort(ok[np.lexsort((ok, -excess[ok]))[:most]])


def _features(chosen: np.ndarray):
    """Feature numbers by slot (-1: none) and the matrix of log-counts of a group of texts."""
    number = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, owner = slots(texts)
        f = number[slot]
        has = f >= 0
        key, count = np.unique(owner[has].astype(np.int64) * len(chosen) + f[has], return_counts=True)
        return key // len(chosen), key % len(chosen), np.log1p(count)

    return of


def _extract(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _features(chosen)
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                _, f, x = of([text])
                rows.append((f.astype(np.int32).tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "features", "values"])

    return run


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the logistic loss (Adam, full batches)."""
    d = positive.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    p1, u1 = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (positive, unlabelled))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, rounds + 1):
        zp, zu = p1 @ w, u1 @ w
        as_positive = p1.T @ (sig(zp) - 1) * (prior / len(p1))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = u1.T @ sig(zu) / len(u1) - prior * (p1.T @ sig(zp)) / len(p1)
        # below zero the model has begun to fit single unlabelled texts: step back on that part alone
        grad = as_positive + g_negative if negative >= 0 else -g_negative
        grad = grad + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(at: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut of least corrected 0-1 risk: prior * missed positives + the unlabelled above it that are not the prior's share.

    ``positive`` and ``unlabelled`` count the texts that score ``at`` each of the ascending values.
    """
    hit, above = (1 - np.cumsum(x)[:-1] / max(1, x.sum()) for x in (positive, unlabelled))
    if not len(hit):
        return float(at[0])
    risk = prior * (1 - hit) + np.maximum(0, above - prior * hit)
    best = int(np.argmin(risk))
    return float((at[best] + at[best + 1]) / 2)


def _margins(chosen: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _features(chosen)
        for batch in batches:
            found = [np.zeros(0)]
            for texts in grouped(as_bytes(batch.column(2))):
                owner, f, x = of(texts)
                found.append(bias + np.bincount(owner, x * weights[f], minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found))], names=["doc_id", "held_out", "z"])

    return run


def fit(rows: DataFrame, toxic: DataFrame, prior: float, folds: int, held_out: int, sample_docs: int, features: int):
    """Slots, weights and bias, or nothing where no confirmed text stands out."""
    everywhere, n = occurrences(rows.select("text"))
    with settings(rows.sparkSession, **RUNTIME_FILTER):
        confirmed, n_toxic = occurrences(only_ids(rows, toxic.withColumnRenamed("label_id", "doc_id"), "doc_id").select("text"))
    chosen = pick(np.stack([everywhere, confirmed]), n, n_toxic, features) if n_toxic else np.zeros(0)
    if not len(chosen):
        return None
    others = rows.where(fold("doc_id", folds) != held_out).join(toxic, rows.doc_id == toxic.label_id, "left_anti").select(F.col("doc_id").alias("label_id"), F.lit(0).alias("label"))
    sample = smallest_hashes(toxic.select("label_id", F.lit(1).alias("label")), "label_id", sample_docs).unionByName(smallest_hashes(others.distinct(), "label_id", 2 * sample_docs))
    # one text an id, so that repeated ids don't break the bound
    found = rows.join(F.broadcast(sample), rows.doc_id == sample.label_id).groupBy("label_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    found = found.mapInArrow(_extract(chosen), "label int, features binary, values binary").collect()  # bounded by sample_docs
    found = sorted((r.label, bytes(r.features), bytes(r["values"])) for r in found)
    x = np.zeros((len(found), len(chosen)), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r[1], np.int32)] = np.frombuffer(r[2], np.float64)
    y = np.array([r[0] for r in found])
    # the unlabelled are all texts: the confirmed ones at their prior's share
    positive, others = x[y == 1], x[y == 0]
    if not len(positive):
        return None
    share = min(len(positive), max(1, round(prior * len(others) / (1 - prior)))) if prior < 1 else len(positive)
    return chosen, *train_nnpu(positive, np.concatenate([others, positive[:: max(1, len(positive) // share)][:share]]), prior)


STEPS = 64  # the cut is chosen in steps of 1/64 of the margin


def pu_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, sample_docs: int = 3000, features: int = 768) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels (doc_id, toxic) are learnt from the other folds only. ``sample_docs`` bounds the confirmed
    toxic texts, and twice it the unlabelled ones, that the weights are fitted on; ``features`` bounds
    the slots. The cut is chosen on the margins of all texts of the training folds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1)).where(fold("doc_id", folds) != held_out).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    totals = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    prior = (totals.toxic or 0) / max(1, totals.n)
    toxic = written(known.where("label = 1").select("label_id"))
    model = fit(rows, toxic, prior, folds, held_out, sample_docs, features) if totals.toxic else None
    out = (fold("doc_id", folds) == held_out).alias("held_out")
    if model is None:
        return rows.select("doc_id", out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = written(rows.select("doc_id", out, "text").mapInArrow(_margins(*model), "doc_id long, held_out boolean, z double"))
    step = F.least(F.lit(50 * STEPS), F.greatest(F.lit(-50 * STEPS), F.floor(F.col("z") * STEPS))).cast("int")
    seen = scored.where("not held_out").join(toxic, F.col("doc_id") == F.col("label_id"), "left").groupBy(step.alias("step")).agg(F.count("label_id").alias("positive"), F.count("*").alias("every"))
    steps = sorted(seen.collect())  # 6,401 steps at most
    cut = best_cut(np.array([r.step for r in steps]) / STEPS + 0.5 / STEPS, np.array([r.positive for r in steps]), np.array([r.every for r in steps]), prior) if steps else 0.0
    score = 1 / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.col("z") - cut + math.log(0.7 / 0.3)))))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))
