"""Helpers shared by the text operators: word hashing in numpy, packing, shared-folder tables.

A *word* is a maximal run of bytes outside ``{0x20, 0x09..0x0D}``; ``bytes.split()`` splits on
exactly that set, so both forms below agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.session import shared_folder

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
SEGMENT = 1 << 20  # bytes of a text that are split into words at a time
MOST_WORDS = 1 << 18  # distinct words whose digests are kept
GROUP_WORDS = 1 << 17
GAP = re.compile(rb"[\x20\x09-\x0D]")
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_cuts: list[str] | None = None


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends in files that outlive executors."""
    path = shared_folder(df.sparkSession, "cut")
    if _cuts is not None:
        _cuts.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cuts():
    """A list that takes the folders of all tables cut meanwhile, for ``discard`` once nothing reads them any more."""
    global _cuts
    outer, _cuts = _cuts, []
    try:
        yield _cuts
    finally:
        _cuts = outer


def discard(spark: SparkSession, folders: list[str]) -> None:
    for path in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Holds SQL settings (``__`` for ``.``) while an eager step runs."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, by a join that Spark may prune by a runtime Bloom filter.

    The comparison on the id makes the ids' side count as selective, which that rule asks for.
    """
    return docs.join(ids.where(F.col(id_col) >= F.lit(-(2**63))), id_col, how)


RUNTIME_FILTER = {
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1g",
}
#: Joins alike at every size: a small side isn't broadcast.
BY_SHUFFLE = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> U64(33))
    x = x * U64(pow(0xC4CEB9FE1A85EC53, -1, 2**64))
    x = x ^ (x >> U64(33))
    x = x * U64(pow(0xFF51AFD7ED558CCD, -1, 2**64))
    return x ^ (x >> U64(33))


# words -----------------------------------------------------------------------------------------
class Words(dict):
    """Numbers distinct words as they come up and keeps a 128-bit BLAKE2b digest of each."""

    def __init__(self):
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        number = len(self.raw) // 16
        self.raw += blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            self[word] = number
        return number

    def digests(self, words: list[bytes]) -> np.ndarray:
        if len(self.raw) > 16 * MOST_WORDS:
            self.clear()
            self.raw.clear()
        if not words:
            return np.zeros((0, 2), dtype=U64)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.raw, U64).reshape(-1, 2)[numbers]


_words = Words()
_libc = ctypes.CDLL(None)


def free() -> None:
    """Gives memory that a task has used back to the system: a Python worker lives on after its task."""
    _words.clear()
    _words.raw.clear()
    Powers.held.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(run):
    """The function of a mapInArrow, followed by ``free``."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free()

    return tidied


def word_digests(data: bytes) -> np.ndarray:
    """128-bit digests of all words of ``data``, in order, as (n, 2); works through segments, so memory stays bounded."""
    out, at = [np.zeros((0, 2), dtype=U64)], 0
    while at < len(data):
        gap = GAP.search(data, at + SEGMENT)  # never inside a word
        end = gap.start() if gap else len(data)
        out.append(_words.digests(data[at:end].split()))
        at = end
    return np.concatenate(out)


def word_hashes(data: bytes) -> np.ndarray:
    """The first 64 bits of each word's digest."""
    return word_digests(data)[:, 0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; the words are folded in one by one through ``mix``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = mix(words[:n] + U64(size))
    for i in range(1, size):
        h = mix(h * U64(BASE) + words[i : i + n])
    return h


# Rabin-Karp hashes over the prime field of 2**31 - 1 -----------------------------------------------
PRIME = U64(2**31 - 1)


def drawn_radices() -> tuple[int, int, int]:
    """A radix for each of the three residues, new at each call."""
    return tuple(secrets.randbelow(int(PRIME) - 2**20) + 2**20 for _ in range(3))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62."""
    x = (x & PRIME) + (x >> U64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a radix and of its inverse, grown on demand by doubling."""

    held: dict[int, np.ndarray] = {}

    @classmethod
    def upto(cls, radix: int, n: int) -> np.ndarray:
        have = cls.held.get(radix, np.ones(1, dtype=U64))
        while len(have) < n:
            have = np.concatenate((have, _reduced(have * U64(pow(radix, len(have), int(PRIME))))))
        cls.held[radix] = have
        return have[:n]


def rabin_karp(digests: np.ndarray, size: int, radices: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words: 64 bits (from two residues) and 31 bits more (a third one), 93 bits in all.

    Each residue is a polynomial of other bits of the words' digests, to a radix of its own, modulo a
    prime. Two different runs agree in one for at most ``size`` of the 2**31 radices, so none are sure
    to agree while the radices aren't known; to known radices such runs can be made.
    """
    n = len(digests) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.uint32)
    codes = (digests[:, 0] & PRIME, digests[:, 0] >> U64(33), digests[:, 1] & PRIME)
    found = []
    for radix, code in zip(radices, codes, strict=True):
        sums = np.zeros(len(code) + 1, dtype=U64)
        np.cumsum(_reduced(code * Powers.upto(radix, len(code))), out=sums[1:])
        found.append(_reduced(_reduced(sums[size:] - sums[:-size]) * Powers.upto(pow(radix, -1, int(PRIME)), n)))
    return mix((found[0] << U64(31)) | found[1]), found[2].astype(np.uint32)


def windows_of(texts: list[bytes], size: int, radices: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash, check) of all windows of ``size`` words that lie within one text, a group of texts at a time."""
    held, owners, words = [], [], 0
    for i, text in enumerate(texts):
        d = word_digests(text)
        if len(d) >= size:
            held.append(d)
            owners.append(i)
            words += len(d)
        if held and (words >= GROUP_WORDS or i + 1 == len(texts)):
            lengths = np.array([len(d) for d in held])
            h, c = rabin_karp(np.concatenate(held), size, radices)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(words)  # words to the text's end
            inside = left[: len(h)] >= size
            yield np.repeat(np.array(owners), lengths)[: len(h)][inside], h[inside], c[inside]
            held, owners, words = [], [], 0


MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=U64)


def run_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A 64-bit hash of each run of bytes, and its bytes as numbers of eight: (runs that are so long, number) for each eighth byte.

    For features, and where equal hashes are followed by a look at the bytes.
    """
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    h, found, at, begin = mix(lengths.astype(U64)), [], np.arange(len(starts), dtype=np.int32), 0
    while len(at):
        values = padded[(starts[at] + begin)[:, None] + np.arange(8, dtype=np.int32)].view("<u8").ravel() & MASK[np.minimum(8, lengths[at] - begin)]
        h[at] = mix(h[at] * U64(BASE) ^ values)
        found.append((at, values))
        begin += 8
        at = at[lengths[at] > begin]
    return h, found


# byte codes of the letter runs and characters that models take as features --------------------------
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


class _Powers64:
    """BASE**i and its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            step, back = np.full(n, BASE, dtype=U64), np.full(n, pow(BASE, -1, 2**64), dtype=U64)
            step[0] = back[0] = 1
            cls.up, cls.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return cls.up[:n], cls.down[:n]


def polynomial(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of short runs codes[start:end] from one prefix sum, modulo 2**64: for features and look-ups that a wrong match can't break."""
    up, down = _Powers64.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def planes(a: np.ndarray) -> bytes:
    """Bytes of ``a`` by significance, so that the shuffle's compression finds the many equal high bytes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Planes of the differences of a sorted uint64 array."""
    return planes(np.diff(a, prepend=U64(0)).astype(U64)) if len(a) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, U64), dtype=U64)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def small(data: bytes) -> bytes:
    return _squeeze.compress(data)


def large(data: bytes) -> bytes:
    return _expand.decompress(data)


# packed runs: arrays of one range of a 64-bit key in one row ----------------------------------------
def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the key space, of ``buckets`` equal ones, that each key lies in."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def deal(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Bucket numbers, and for each bucket with rows its packed keys and columns; ``keys`` are sorted."""
    at = bucket_of(keys, buckets)
    starts, counts = groups(at)
    parts = [slice(a, a + n) for a, n in zip(starts, counts, strict=True)]
    return at[starts], [[small(pack_sorted(keys[p])) for p in parts], *([small(planes(c[p])) for p in parts] for c in columns)]


def run_batch(numbers: np.ndarray, columns: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", *names])


def runs_in(rows: list[dict], names: list[str], types: list) -> list[np.ndarray]:
    """The arrays of packed runs, one after the other."""
    first = np.concatenate([unpack_sorted(large(r[names[0]])) for r in rows])
    return [first, *(np.concatenate([unplanes(large(r[c]), t) for r in rows]) for c, t in zip(names[1:], types[1:], strict=True))]


FAN = 4096  # ranges that a task deals its rows to at a time
RUN_BYTES = 16 << 20


def first_fan(buckets: int) -> int:
    """Ranges to deal to at first: all, or few enough that packed runs stay long; ``dealt`` splits them further."""
    return buckets if buckets <= FAN else min(FAN, -(-buckets // 64))


def dealt(runs: DataFrame, buckets: int, names: list[str], types: list) -> DataFrame:
    """Packed runs of ``first_fan(buckets)`` ranges, as runs of all ``buckets`` (or a few more): one more exchange where those are very many."""
    coarse = first_fan(buckets)
    if coarse == buckets:
        return runs
    fine = coarse * -(-buckets // coarse)

    def split(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for apart in (False, True):  # runs of negative numbers keep apart
            part = [r for r in rows if (r["bucket"] < 0) == apart]
            if part:
                arrays = runs_in(part, names, types)
                order = np.argsort(arrays[0], kind="stable")
                at, columns = deal(arrays[0][order], fine, *(a[order] for a in arrays[1:]))
                yield run_batch(-1 - at if apart else at, columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += sum(len(row[c]) for c in names)
                if size >= RUN_BYTES:
                    yield from split(held)
                    held, size = [], 0
        if held:
            yield from split(held)

    return runs.repartition("bucket").mapInArrow(run, runs.schema)


def ranges(texts: DataFrame, text_col: str = "text", each: int = 16 << 20) -> int:
    """A number of ranges for work on texts: by their bytes, so that a range's share doesn't grow with the input; four per shuffle partition at least, which evens them out."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4 * partitions(texts.sparkSession), -(-size // each))


def summed(counters: DataFrame, add) -> DataFrame:
    """Adds up rows (part, chunk, ...) by chunk, at most 64 rows of a chunk at a time; ``part`` numbers the tasks that made them."""
    counters = cut(counters)
    most = counters.agg(F.max("part")).first()[0] or 0
    while True:
        counters = counters.withColumn("part", F.expr("part div 64").cast("int")).groupBy("chunk", "part").applyInArrow(add, counters.schema)
        most //= 64
        if not most:
            return counters


def batches_of(rows: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python values of each row; text columns (named ``text``) as bytes."""
    for batch in rows:
        cols = [as_bytes(batch.column(batch.schema.get_field_index(c))) if c == "text" else batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        yield from zip(*cols, strict=True)
