"""Best-fit packing of texts into bins of a fixed number of tokens, under conflicts.

Texts are cut into pieces of at most ``capacity`` tokens (words); full pieces are bins of their own.
The rest are dealt by hash to shards of a bounded number of pieces, so that a hot source or a large
group of copies spreads over all of them, and each shard is packed by best fit, largest first: bins
are kept in the order of their residual room; the search starts at the tightest bin that has room
and goes on to its successors until one is compatible. A bin carries a bitmap of the duplicate
clusters it holds (never two pieces of one cluster) and bitmaps of its sources (at most
``per_source`` pieces of one source).

Defined results: null, empty or blank texts have no tokens: one row without a bin; a null source is a
source of its own; a null id is packed like any other; repeated rows are pieces of one cluster; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, tidy

SHARD_PIECES = 4096
PLACED = "doc_id long, piece int, start long, n_tokens long, bin_id string, bin_offset long"


def best_fit(pieces: list[tuple[int, int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece (size, tie-break, source, cluster), taken in the order given."""
    bits: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    clusters: list[int] = []  # each bin's bitmap of duplicate clusters
    sources: list[list[int]] = []  # each bin's bitmaps: in the j-th, sources with more than j pieces
    placed = []
    for size, _, source, cluster in pieces:
        c = 1 << bits.setdefault(("c", cluster), len(bits))
        s = 1 << bits.setdefault(("s", source), len(bits))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (clusters[order[at][1]] & c or sources[order[at][1]][-1] & s):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        clusters[number] |= c
        planes = sources[number]
        planes[next(j for j in range(per_source) if not planes[j] & s)] |= s
        placed.append((number, capacity - room))
        insort(order, (room - size, number))
    return placed


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text, and a key of its duplicate cluster: the words, A-Z lower-cased."""
    for batch in batches:
        words = [t.lower().split() for t in as_bytes(batch.column(2))]
        keys = [int.from_bytes(hashlib.blake2b(b" ".join(w), digest_size=8).digest(), "little", signed=True) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "source", "total", "cluster"])


def _pack(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # bits are handed out as sources and clusters come up; the order doesn't depend on the rows' arrival
        rows.sort(key=lambda r: (-r["n_tokens"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["source"] or "", r["cluster"]))
        placed = best_fit([(r["n_tokens"], r["doc_id"], r["source"], r["cluster"]) for r in rows], capacity, per_source)
        out = {c: [r[c] for r in rows] for c in ("doc_id", "piece", "start", "n_tokens")}
        out |= {"bin_id": [f"{r['shard']}-{b}" for r, (b, _) in zip(rows, placed, strict=True)], "bin_offset": [o for _, o in placed]}
        types = {"piece": pa.int32(), "bin_id": pa.string()}
        return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 4096, per_source: int = 4, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start (word of the text), n_tokens, bin_id, bin_offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sizes = cut(rows.mapInArrow(tidy(_measure), "doc_id long, source string, total long, cluster long"))
    sizes = sizes.withColumn("row", F.monotonically_increasing_id())  # of a written table: the same on every attempt
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(total - 1) div {capacity}").cast("int")))
    pieces = sizes.withColumn("piece", F.explode(numbers)).withColumn("start", F.col("piece").cast("long") * capacity).withColumn("n_tokens", F.least(F.col("total") - F.col("start"), F.lit(capacity)))
    whole = pieces.where((F.col("n_tokens") == capacity) | (F.col("total") == 0)).select("doc_id", "piece", "start", "n_tokens", F.when(F.col("total") > 0, F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string"))).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    rest = pieces.where((F.col("n_tokens") < capacity) & (F.col("total") > 0))
    shards = max(1, -(-sizes.where(f"total > 0 and total % {capacity} > 0").count() // shard_pieces))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards))).select("shard", "doc_id", "source", "cluster", "piece", "start", "n_tokens")
    return dealt.groupBy("shard").applyInArrow(_pack(capacity, per_source), PLACED).unionByName(whole)
