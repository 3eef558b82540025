"""Substring deduplication: words covered by a fixed-length window that an earlier document holds too.

1. Every task hashes each window of ``window`` words (Rabin-Karp over word digests, to radices drawn for
   this run) and keeps one posting per distinct window of its batch, with the smallest id; windows that
   a smaller id of the same batch holds too are decided on the spot. So a window that a third of all
   documents share leaves one posting per batch.
2. Postings meet by hash range; of each window all ids but the smallest are told to drop it, and which
   document has it before them. The number of ranges follows the bytes of the texts.
3. The answers go to their documents, whose windows are hashed again; covered words form maximal
   removal intervals.
4. Every match is checked by content. A document claims each run of windows that it drops for one
   earlier document, with the SHA-256 of the run's words; equal claims are one. The earlier documents
   look for the claims' words in their own texts. Where a run isn't found as a whole (its windows may
   lie apart there) its windows are claimed one by one. If even one window isn't found, two different
   windows agreed in their hashes: everything is done again with other radices.

Windows are judged on the input, not on what is left. Equal windows always have equal hashes, and all
matches are checked, so the result is that of comparing the words themselves. The hash has 93 bits; some
two different windows of n agree with odds of about n**2 / 2**94 (1e-9 for the windows of 30 GB of text),
and as the radices are new each time, no text can be made that has them agree.

Defined results: null or empty text has no words; texts shorter than the window lose nothing; a
null id neither removes nor loses words; rows with the same id don't remove from one another; ids must
be integers of 64 bits (others end in Spark's cast error); an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RUNTIME_FILTER, U64, as_bytes, cut, deal, dealt, drawn_radices, first_fan, groups, mix, only_ids, planes, ranges, run_batch, runs_in, settings, tidy, unmix, unplanes, windows_of

BATCH_WINDOWS = 1_000_000
IDS_RANGE = 4  # ranges of windows to one of ids: answers are far fewer than postings
CLAIMS = 4096  # that a copy of an earlier document's text looks for
#: Packed runs of postings (window, id, check) and, in buckets numbered -1 and below, of answers (mixed id, window, earlier id).
RUNS = "bucket int, first binary, second binary, third binary"
NAMES, TYPES = ["first", "second", "third"], (U64, U64, U64)


def _decide(h: np.ndarray, c: np.ndarray, ids: np.ndarray):
    """Distinct (window, check, id) by window, and the smallest id of each one's window."""
    order = np.lexsort((ids, c, h))
    h, c, ids = h[order], c[order], ids[order]
    other = np.ones(len(h), dtype=bool)  # another window than the one before
    other[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    least = ids[np.maximum.accumulate(np.where(other, np.arange(len(h)), 0))]
    fresh = other.copy()
    fresh[1:] |= ids[1:] != ids[:-1]
    return h[fresh], c[fresh], ids[fresh], least[fresh]


def _answered(h: np.ndarray, ids: np.ndarray, least: np.ndarray, buckets: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """Packed runs of (id, window, earlier id) to drop, by range of the mixed ids."""
    who = mix(ids.astype(U64))
    order = np.lexsort((h, who))
    return deal(who[order], buckets, h[order], least[order].astype(U64))


def _postings(size: int, buckets: int, radices: tuple[int, int, int]):
    fan = first_fan(buckets)

    def flush(held: list) -> pa.RecordBatch:
        h, c, d, least = _decide(*(np.concatenate(x) for x in zip(*held, strict=True)))
        first = d == least
        at, posted = deal(h[first], fan, d[first].astype(U64), c[first].astype(U64))
        own_at, own = _answered(h[~first], d[~first], least[~first], first_fan(-(-buckets // IDS_RANGE)))
        return run_batch(np.concatenate((at, -1 - own_at)), [a + b for a, b in zip(posted, own, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for text, h, c in windows_of(as_bytes(batch.column(1)), size, radices):
                held.append((h, c, ids[text]))
                n += len(h)
                if n >= BATCH_WINDOWS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _answers(buckets: int):
    """The answers to all postings of a range of windows; those that tasks gave themselves go on."""
    fan = first_fan(-(-buckets // IDS_RANGE))

    def run(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        if number < 0:
            return table.set_column(0, "bucket", pa.array([-1 - number] * table.num_rows, pa.int32()))
        h, d, c = runs_in(table.to_pylist(), NAMES, TYPES)
        h, _, d, least = _decide(h, c, d.view(np.int64))
        later = d != least
        return pa.Table.from_batches([run_batch(*_answered(h[later], d[later], least[later], fan), NAMES)])

    return run


def _by_id(table: pa.Table) -> pa.Table:
    who, h, least = runs_in(table.to_pylist(), NAMES, TYPES)
    order = np.lexsort((least, h, who))
    who, h, least = who[order], h[order], least[order]
    starts, counts = groups(who)
    parts = [slice(a, a + n) for a, n in zip(starts, counts, strict=True)]
    return pa.table({"doc_id": pa.array(unmix(who[starts]).view(np.int64)), "drops": pa.array([planes(h[p]) for p in parts], pa.binary()), "before": pa.array([planes(least[p]) for p in parts], pa.binary())})


def answers(rows: DataFrame, window: int, radices: tuple[int, int, int]) -> DataFrame:
    """(doc_id, drops, before) of the documents that lose words, from rows (doc_id, text): windows, and an earlier document that holds each."""
    buckets = ranges(rows)
    posted = rows.where("doc_id is not null").mapInArrow(tidy(_postings(window, buckets, radices)), RUNS)
    told = dealt(posted, buckets, NAMES, TYPES).groupBy("bucket").applyInArrow(_answers(buckets), RUNS)
    return cut(dealt(told, -(-buckets // IDS_RANGE), NAMES, TYPES).groupBy("bucket").applyInArrow(_by_id, "doc_id long, drops binary, before binary"))


def hashes_of(text: bytes, size: int, radices: tuple[int, int, int]) -> np.ndarray:
    """The hash of each window of a text."""
    return np.concatenate([np.zeros(0, U64), *(h for _, h, _ in windows_of([text], size, radices))])


def matches(h: np.ndarray, drops: bytes, before: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows to drop, and for each the earlier document that holds it."""
    dropped, least = unplanes(drops, U64), unplanes(before, U64)
    at = np.minimum(np.searchsorted(dropped, h), max(0, len(dropped) - 1))
    gone = np.flatnonzero(dropped[at] == h) if len(dropped) else np.zeros(0, np.int64)
    return gone, least[at[gone]].view(np.int64)


def intervals(gone: np.ndarray, windows: int, size: int) -> list[list[int]]:
    """Maximal intervals of words that the windows ``gone`` cover."""
    cover = np.zeros(windows + size, dtype=np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + size, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).reshape(-1, 2).tolist()


CLAIM = "earlier long, first long, last long, n long, sha binary"


def claimed(words: list[bytes], h: np.ndarray, gone: np.ndarray, least: np.ndarray, size: int, single: bool) -> list[tuple]:
    """A claim for each run of windows that the same earlier document holds, or for each window."""
    if not len(gone):
        return []
    new = np.ones(len(gone), dtype=bool)
    if not single:
        new[1:] = (gone[1:] != gone[:-1] + 1) | (least[1:] != least[:-1])
    starts = np.flatnonzero(new)
    counts, signed = np.diff(np.append(starts, len(gone))), h.view(np.int64)
    return [(int(least[i]), int(signed[gone[i]]), int(signed[gone[i] + n - 1]), int(n), hashlib.sha256(b" ".join(words[gone[i] : gone[i] + n - 1 + size])).digest()) for i, n in zip(starts, counts, strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
CLAIM_TYPE = pa.struct([("earlier", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("sha", pa.binary())])


def _remove(size: int, radices: tuple[int, int, int]):
    """What is left of (doc_id, text, drops, before), and the claims that this rests on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, whole, left, removed, claims = [], [], [], [], [], []
            for text, drops, before in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, kept, at = text.split(), [], 0
                h = hashes_of(text, size, radices)
                gone, least = matches(h, drops, before)
                spans = intervals(gone, len(h), size)
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                whole.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                left.append(b" ".join(kept))
                removed.append([{"start": a, "end": b} for a, b in spans])
                claims.append([dict(zip(("earlier", "first", "last", "n", "sha"), c, strict=True)) for c in claimed(words, h, gone, least, size, single=False)])
            columns = [batch.column(0), pa.array(whole, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, SPANS), pa.array(left, pa.binary()).cast(pa.string()), pa.array(claims, pa.list_(CLAIM_TYPE))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words_key", "n_words", "n_removed", "removed", "kept_text", "claims"])

    return run


REMOVED = f"doc_id long, words_key binary, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string, claims array<struct<{CLAIM.replace(' ', ':').replace(',:', ',')}>>"


def _one_by_one(size: int, radices: tuple[int, int, int]):
    """A claim for each window to drop of (doc_id, text, drops, before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, drops, before in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                h = hashes_of(text, size, radices)
                rows = claimed(text.split(), h, *matches(h, drops, before), size, single=True)
                yield pa.RecordBatch.from_pylist([dict(zip(("earlier", "first", "last", "n", "sha"), c, strict=True)) for c in rows], schema=pa.schema(list(CLAIM_TYPE)))

    return run


def _prove(size: int, radices: tuple[int, int, int]):
    """Which claims hold, from (text, claims) of the earlier documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, claims in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words, h = text.split(), hashes_of(text, size, radices).view(np.int64)
                order = np.argsort(h, kind="stable")
                ordered = h[order]
                for claim in claims:
                    starts = order[slice(*np.searchsorted(ordered, [claim["first"], claim["first"] + 1]))]
                    starts = starts[starts + claim["n"] <= len(h)]
                    starts = starts[h[starts + claim["n"] - 1] == claim["last"]]
                    good = any(hashlib.sha256(b" ".join(words[i : i + claim["n"] - 1 + size])).digest() == claim["sha"] for i in starts.tolist())
                    rows.append(claim | {"good": good})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*CLAIM_TYPE, ("good", pa.bool_())]))

    return run


def refuted(rows: DataFrame, claims: DataFrame, window: int, radices: tuple[int, int, int]) -> DataFrame:
    """The claims (earlier, first, last, n, sha) whose words no row of the earlier document holds."""
    claims = cut(claims.distinct())
    counts = claims.groupBy("earlier").agg(F.ceil(F.count("*") / CLAIMS).alias("parts"))
    asked = claims.join(counts, "earlier").groupBy(F.col("earlier").alias("doc_id"), F.pmod(F.xxhash64("first", "n", "sha"), "parts").alias("part")).agg(F.collect_list(F.struct("earlier", "first", "last", "n", "sha")).alias("claims"))
    with settings(rows.sparkSession, **RUNTIME_FILTER):
        checked = only_ids(rows, cut(asked), "doc_id", "inner").select("text", "claims").mapInArrow(tidy(_prove(window, radices)), f"{CLAIM}, good boolean")
        return cut(checked.groupBy("earlier", "first", "last", "n", "sha").agg(F.max("good").alias("good")).where("not good").drop("good"))


def _checked(rows: DataFrame, told: DataFrame, found: DataFrame, window: int, radices: tuple[int, int, int]) -> bool:
    """Whether earlier documents hold the words of all windows that are dropped."""
    each = found.select("doc_id", F.explode("claims").alias("claim")).select("doc_id", "claim.*")
    apart = refuted(rows, each.drop("doc_id"), window, radices)
    if apart.isEmpty():
        return True
    again = each.join(apart, ["earlier", "first", "last", "n", "sha"], "left_semi").select("doc_id").distinct()
    texts = rows.join(told.join(again, "doc_id", "left_semi"), "doc_id").select("doc_id", "text", "drops", "before")
    return refuted(rows, texts.mapInArrow(tidy(_one_by_one(window, radices)), CLAIM), window, radices).isEmpty()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, draw=drawn_radices) -> DataFrame:
    """The rows that lose words: doc_id, words_key (digest of the row's words), n_words, n_removed, removed (word intervals, end exclusive), kept_text (kept words joined by a space).

    Only their texts, and those of the documents that they repeat, are shuffled: the others stay behind
    a runtime Bloom filter, as far as that has room for the ids. ``draw`` gives the radices of a trial.
    """
    rows = _named(docs, id_col, text_col)
    while True:
        radices = draw()
        told = answers(rows, window, radices)
        with settings(docs.sparkSession, **RUNTIME_FILTER):
            found = cut(only_ids(rows, told, "doc_id", "inner").select("doc_id", "text", "drops", "before").mapInArrow(tidy(_remove(window, radices)), REMOVED).where("n_removed > 0"))
        if _checked(rows, told, found, window, radices):
            return found.drop("claims").dropDuplicates(["doc_id", "words_key"])


def _plain(with_text: bool):
    """Key, number and digest of the words of each text, and the words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = text.split()
                joined = b" ".join(words)
                rows.append((hashlib.blake2b(joined, digest_size=16).digest(), len(words), hashlib.sha256(joined).hexdigest(), joined if with_text else b""))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:3], columns[3].cast(pa.string())], names=["doc_id", "words_key", "n_words", "whole_sha256", "whole"])

    return run


def _every(docs: DataFrame, id_col: str, text_col: str, changed: DataFrame, with_text: bool) -> DataFrame:
    every = _named(docs, id_col, text_col).mapInArrow(tidy(_plain(with_text)), "doc_id long, words_key binary, n_words long, whole_sha256 string, whole string")
    return every.join(changed.drop("n_words"), ["doc_id", "words_key"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, draw=drawn_radices) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, removed and kept_text, as in ``removals``."""
    out = _every(docs, id_col, text_col, removals(docs, id_col, text_col, window, draw), with_text=True)
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return out.select("doc_id", "n_words", "n_removed", F.coalesce("removed", none).alias("removed"), F.coalesce("kept_text", "whole").alias("kept_text"))


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, draw=drawn_radices) -> DataFrame:
    """Every row: doc_id, n_words, n_removed and kept_sha256. Texts that lose nothing are digested where they are read."""
    changed = removals(docs, id_col, text_col, window, draw).select("doc_id", "words_key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return _every(docs, id_col, text_col, changed, with_text=False).select("doc_id", "n_words", "n_removed", F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
