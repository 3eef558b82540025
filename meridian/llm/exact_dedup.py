"""Exact deduplication by a log-structured merge index of text digests.

1. *Memtables*: every task collects (digest, id) pairs and flushes them as sorted runs, one per
   digest range, each with a Bloom filter sized by its entries. A run holds one entry per digest (best
   id, count), so a group that holds a third of all rows shrinks to one entry per run.
2. *Compaction*: the runs of a digest range meet in one task and are merged level by level, two runs of
   like size at a time: entries that the other run's filter rules out go over unseen, the others are
   looked up there; of equal digests the best id and the sum of the counts stay. The number of ranges
   follows the number of rows; where there are very many, runs are first merged and dealt by coarse range.
3. *Byte verification*: only digests with several rows are looked at again. Their texts are reduced
   to the smallest and the largest one per digest; where these differ (a digest collision), the
   rows are grouped by the text itself.

Digests with a thousandth of all rows or more (a thousand at most) are joined back by broadcast, so
that no task gets all rows of one.

Defined results: null text counts as empty; a null id sorts below all others and gets the same
treatment; repeated rows count as members; an empty table gives an empty result; only the id and
text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUNTIME_FILTER, cut, first_fan, groups, only_ids, partitions, settings

NO_ID = -(2**63)
FILTER_BITS, FILTER_HASHES = 12, 4
RANGE_ROWS = 500_000
RUN = "digest_range int, digests binary, ids binary, counts binary, filter binary"
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # digests (sorted), best ids, counts, filter


def _positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Filter bits of each digest, (n, FILTER_HASHES)."""
    raw = np.zeros((len(digests), 32), dtype=np.uint8)
    width = digests.dtype.itemsize
    raw[:, :width] = digests.view(np.uint8).reshape(len(digests), width)
    words = raw.view(np.uint64)
    first, second = words[:, 0] ^ (words[:, 2] >> np.uint64(3)), words[:, 1] ^ words[:, 3] | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) % np.uint64(bits) for i in range(FILTER_HASHES)], axis=1).astype(np.int64)


def bloom(digests: np.ndarray) -> np.ndarray:
    found = np.zeros(max(64, FILTER_BITS * len(digests)), dtype=bool)
    found[_positions(digests, len(found)).ravel()] = True
    return found


def maybe_in(digests: np.ndarray, other: np.ndarray) -> np.ndarray:
    return other[_positions(digests, len(other))].all(axis=1)


def _reduce(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, largest: bool):
    order = np.lexsort((ids, digests))
    digests, ids, counts = digests[order], ids[order], counts[order]
    starts, lengths = groups(digests)
    if not len(starts):
        return digests, ids, counts
    return digests[starts], ids[starts + lengths - 1] if largest else ids[starts], np.add.reduceat(counts, starts)


def merge(a: Run, b: Run, largest: bool) -> Run:
    """One run of two: ``a``'s entries that ``b``'s filter lets through are looked up in ``b``."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    hit = np.flatnonzero(maybe_in(a[0], b[3]))
    at = np.minimum(np.searchsorted(b[0], a[0][hit]), len(b[0]) - 1)
    same = b[0][at] == a[0][hit]
    hit, at = hit[same], at[same]
    ids, counts = b[1].copy(), b[2].copy()
    ids[at] = (np.maximum if largest else np.minimum)(ids[at], a[1][hit])
    counts[at] += a[2][hit]
    left = np.ones(len(a[0]), dtype=bool)
    left[hit] = False
    digests = np.concatenate((b[0], a[0][left]))
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    return digests, np.concatenate((ids, a[1][left]))[order], np.concatenate((counts, a[2][left]))[order], bloom(digests)


def compacted(runs: list[Run], largest: bool) -> Run:
    """All runs merged level by level, two neighbours in size at a time."""
    while len(runs) > 1:
        runs = sorted(runs, key=lambda r: len(r[0]))
        runs = [merge(runs[i], runs[i + 1], largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _range_of(digests: np.ndarray, n_ranges: int) -> np.ndarray:
    width = digests.dtype.itemsize
    lead = digests.view(np.uint8).reshape(len(digests), width)[:, :4].astype(np.int64)
    key = lead @ np.array([1 << 24, 1 << 16, 1 << 8, 1])[: lead.shape[1]]
    return (key * n_ranges) >> 32  # in the digests' own order


def _written(d: np.ndarray, i: np.ndarray, c: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    at = _range_of(d, n_ranges)
    starts, lengths = groups(at)
    parts = [slice(a, a + n) for a, n in zip(starts, lengths, strict=True)]
    columns = [[x[p].tobytes() for p in parts] for x in (d, i, c)] + [[np.packbits(bloom(d[p])).tobytes() for p in parts]]
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["digest_range", "digests", "ids", "counts", "filter"])


def _read(row: dict, width: int) -> Run:
    d = np.frombuffer(row["digests"], f"S{width}")
    return d, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), np.unpackbits(np.frombuffer(row["filter"], np.uint8), count=max(64, FILTER_BITS * len(d))).astype(bool)


def _memtables(n_ranges: int, width: int, largest: bool, memtable_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, ids, rows = [], [], 0
        flush = lambda: _written(*_reduce(np.concatenate(digests), np.concatenate(ids), np.ones(rows, dtype=np.int64), largest), n_ranges)
        for batch in batches:
            if batch.num_rows:
                digests.append(np.array(batch.column(1).to_pylist(), dtype=f"S{width}"))
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                rows += batch.num_rows
                if rows >= memtable_rows:
                    yield flush()
                    digests, ids, rows = [], [], 0
        if rows:
            yield flush()

    return run


def _deal_finer(n_ranges: int, width: int, largest: bool, rows: int):
    """Runs of coarse ranges, merged up to ``rows`` entries and written by fine range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(_read(row, width))
                size += len(held[-1][0])
                if size >= rows:
                    yield _written(*compacted(held, largest)[:3], n_ranges)
                    held, size = [], 0
        if held:
            yield _written(*compacted(held, largest)[:3], n_ranges)

    return run


def _compact(width: int, largest: bool):
    def run(table: pa.Table) -> pa.Table:
        d, i, c, _ = compacted([_read(r, width) for r in table.to_pylist()], largest)
        hit = c > 1
        raw = d[hit].tobytes()
        return pa.table({"digest": pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary()), "keep_id": pa.array(i[hit], pa.int64()), "group_size": pa.array(c[hit], pa.int64())})

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 200_000, digest_bytes: int = 32, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` (1 to 32) shortens the index's digests; results don't depend on it, as hits are
    compared byte by byte. ``range_rows`` bounds the rows of a digest range. Of repeated rows with the
    kept id, all count as kept.
    """
    if keep not in ("smallest", "largest") or not 1 <= digest_bytes <= 32:
        raise ValueError("keep is 'smallest' or 'largest', digest_bytes from 1 to 32")
    spark = docs.sparkSession
    largest, total = keep == "largest", docs.count()
    n = max(4 * partitions(spark), -(-total // range_rows))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes))
    fan = first_fan(n)
    runs = rows.select("id", "digest").mapInArrow(_memtables(fan, digest_bytes, largest, memtable_rows), RUN)
    if fan < n:
        runs = runs.repartition("digest_range").mapInArrow(_deal_finer(fan * -(-n // fan), digest_bytes, largest, 8 * memtable_rows), RUN)
    index = cut(runs.groupBy("digest_range").applyInArrow(_compact(digest_bytes, largest), "digest binary, keep_id long, group_size long"))
    # every row with its entry, if its digest has one: entries of a thousandth of the rows or more, a thousand at most, by broadcast;
    # rows that have found theirs so take keys of their own in the join with the rest
    hot = index.where(F.col("group_size") * 1000 >= total).select("digest", F.struct("keep_id", "group_size").alias("hot"))
    cold = index.where(F.col("group_size") * 1000 < total).select(F.col("digest").alias("key"), F.struct("keep_id", "group_size").alias("cold"))
    away = F.concat(F.lit("-" * 33), F.col("id").cast("string")).cast("binary")  # longer than any digest
    found = rows.select("id", "sha", "digest").join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(away))
    entry = F.coalesce("hot", "cold")
    out = cut(found.join(cold, "key", "left").select("id", "sha", "digest", entry["keep_id"].alias("keep_id"), entry["group_size"].alias("group_size")))
    # bytes of the hits: fetched by id, then one partial result per task and digest
    hits = out.where("group_size is not null").select("id")
    with settings(spark, **RUNTIME_FILTER):
        texts = only_ids(rows, hits, "id").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        collided = cut(texts.where(F.col("a") != F.col("b")).select("digest"))
    done = ["id", "keep_id", "group_size", "sha"]
    single = [F.col("id"), F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("sha")]
    if collided.isEmpty():
        result = out.select(*single)
    else:
        again = rows.join(collided, "digest", "left_semi")
        best = again.groupBy("digest", "text").agg((F.max if largest else F.min)("id").alias("keep_id"), F.count("*").alias("group_size"))
        result = out.join(collided, "digest", "left_anti").select(*single).unionByName(again.join(best, ["digest", "text"]).select(*done))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return result.select(null("id").alias("doc_id"), null("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
