"""Compression of vectors to codes: integer codebooks of the vectors' parts, trained by Lloyd rounds.

Each component x becomes the integer floor(256 * x) and each vector is cut into equal consecutive parts.
A part position's codebook starts as that part of the vectors with the smallest ids. A round assigns
every part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces each
entry by its parts' componentwise floor(sum / count); entries without parts stay.

1. The codebooks, of ``parts`` x ``entries`` x a part's length integers whatever the input, go to the
   tasks by broadcast. Arrow batches compute all distances at once by norm expansion and exact int64
   matrix products, and take the first least one.
2. A task keeps the sums and the count of each entry and emits them once; a grouped shuffle adds these
   up, which is ``parts`` x ``entries`` groups with a map-side combine. The new codebooks, of that many
   rows, come to the driver.
3. The last assignment gives codes and errors. Errors of equal labels are summed; labels with more rows
   than one in four partitions' share, of which there can be but few, meet their rows by broadcast, all
   others by a shuffle, so that a label that a third of all rows carry makes no large task.

Defined results: vectors that are null, or hold null or non-finite components, are dropped. The length
is that of the kept vector with the smallest id; it must be a multiple of ``parts`` (ValueError), and
vectors of another length keep their row with null code and error. Ids that are null come after all
others, repeated rows are coded like any other, rows with one id take part in the start in the order of
their components, and fewer vectors than entries make smaller codebooks. Without a kept vector the
result is empty. Components so large that a squared distance has no exact long (740,000 at a length of
64) end in OverflowError. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import cut, partitions

SCALE = 256
STEP = 4096  # vectors that are compared at a time


def integers(flat: np.ndarray, length: int) -> np.ndarray:
    """floor(256 * x), where squared distances of vectors of ``length`` components fit a long."""
    x, most = np.floor(flat.astype(np.float64) * SCALE), math.isqrt(2**61 // max(1, length))
    if len(x) and np.abs(x).max() > most:
        raise OverflowError(f"a component of {np.abs(x).max() / SCALE} is beyond {most / SCALE}")
    return x.astype(np.int64)


def vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``length`` components, and these as integers (rows, length)."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(offsets) == length)
    values = lists.values.to_numpy(zero_copy_only=False)
    at = (offsets[fits][:, None] + np.arange(length)).ravel()
    return fits, integers(values[at], length).reshape(len(fits), length)


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance to it, of each part of the vectors (n, length): (n, parts) each."""
    parts, _, length = codebooks.shape
    x = x.reshape(len(x), parts, length)
    index, distance = np.empty((len(x), parts), dtype=np.int64), np.empty((len(x), parts), dtype=np.int64)
    norms = (codebooks * codebooks).sum(axis=2)
    for at in range(0, len(x), STEP):
        some = slice(at, at + STEP)
        for p in range(parts):
            part = np.ascontiguousarray(x[some, p])
            d = norms[p] - 2 * (part @ codebooks[p].T)  # without the part's own norm, the same for all entries
            index[some, p] = first = d.argmin(axis=1)
            distance[some, p] = d[np.arange(len(part)), first] + (part * part).sum(axis=1)
    return index, distance


def _sums(shared, length: int):
    """Sums and counts by part and entry, of all vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = shared.value
        parts, entries, each = codebooks.shape
        counts, sums = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, each), dtype=np.int64)
        for batch in batches:
            _, x = vectors(batch.column(0), length)
            index, _ = nearest(x, codebooks)
            slot = (index + entries * np.arange(parts)).ravel()
            counts += np.bincount(slot, minlength=parts * entries)
            np.add.at(sums, slot, x.reshape(-1, each))
        used = np.flatnonzero(counts)
        columns = [pa.array(used), pa.array(counts[used]), *(pa.array(np.ascontiguousarray(sums[used, i])) for i in range(each))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *(f"s{i}" for i in range(each))])

    return run


def _codes(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = vectors(batch.column(0), length)
            index, distance = nearest(x, shared.value)
            raw, width = index.astype(np.uint8).tobytes().hex(), 2 * index.shape[1]
            code, error = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
            code[fits] = [raw[i * width : (i + 1) * width] for i in range(len(fits))]
            error[fits] = distance.sum(axis=1)
            none = np.ones(batch.num_rows, dtype=bool)
            none[fits] = False
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(code, pa.string()), pa.array(error, mask=none)], names=["vec_id", "label", "code", "error"])

    return run


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (label, error, ...) with the sum of the errors of equal labels, nulls together."""
    rows = cut(rows)
    totals = cut(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    share = 4 * partitions(rows.sparkSession)
    most = (totals.agg(F.sum("rows")).first()[0] or 0) // share  # at most ``share`` labels have more rows
    same = F.col("label").eqNullSafe(F.col("of"))
    hot, others = totals.where(F.col("rows") > most), totals.where(F.col("rows") <= most)
    known = rows.join(F.broadcast(hot), same, "left")
    columns = [*rows.columns, "label_error"]
    rest = known.where(F.col("rows").isNull()).select(*rows.columns).join(others, same)
    return known.where(F.col("rows").isNotNull()).select(*columns).unionByName(rest.select(*columns))


def start(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks (parts, entries, length of a part), of the vectors with the smallest ids; none without vectors."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    length = len(first[0].embedding)
    if length % parts:
        raise ValueError(f"vectors of {length} components aren't cut into {parts} equal parts")
    found = kept.where(F.size("embedding") == length).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    x = integers(np.array([r.embedding for r in found], dtype=np.float64).ravel(), length).reshape(len(found), parts, length // parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def trained(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all vectors (vec_id, embedding)."""
    codebooks = start(kept, parts, entries)
    _, held, each = codebooks.shape
    schema = ", ".join(["slot long", "n long", *(f"s{i} long" for i in range(each))])
    for _ in range(rounds if held and each else 0):
        shared = kept.sparkSession.sparkContext.broadcast(codebooks)
        merged = kept.select("embedding").mapInArrow(_sums(shared, parts * each), schema).groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(each)))
        new = codebooks.copy().reshape(-1, each)
        for r in merged.collect():  # parts x entries rows at most
            new[r.slot] = [r[f"s{i}"] // r.n for i in range(each)]
        codebooks = new.reshape(codebooks.shape)
    return codebooks


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, embedding, label) of the rows whose vector has finite components only."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("embedding"), F.col(label_col).alias("label"))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept vector.

    ``codebooks_sha256`` is that of all integers of the codebooks by part, entry and position, joined by commas.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codebooks have 1 to 256 entries, as a code has two hex digits a part")
    kept = kept_vectors(rows, id_col, vector_col, label_col)
    codebooks = trained(kept, parts, entries, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    made = kept.select("embedding", "vec_id", "label").mapInArrow(_codes(shared, parts * codebooks.shape[2]), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    named = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return with_label_error(made).select("vec_id", "label", "code", "error", "label_error", F.lit(named).alias("codebooks_sha256"))


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``codes`` (with code) with ``vector``: each code's entries, as numbers of the vectors' own scale."""
    shared = codes.sparkSession.sparkContext.broadcast(codebooks)
    names = codes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            out = []
            for code in batch.column(batch.schema.get_field_index("code")).to_pylist():
                out.append(None if code is None else (np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))]) / SCALE).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, "vector"])

    return codes.mapInArrow(run, StructType([*codes.schema.fields, StructField("vector", ArrayType(DoubleType()))]))
