"""Near-duplicate components by an exact n-gram Jaccard join with adaptive multi-match prefixes.

Tokens are hashes of word shingles, in one global order: rarest first, by counts of all documents in
a fixed-size table of counters, then by hash. Two sets whose Jaccard similarity reaches the threshold
share at least k tokens among the first ``n - required + k`` of each, for every k. Each document picks
its own k: a longer prefix adds postings, but fewer documents share k tokens of it. A pair is verified
if its prefixes share as many tokens as the smaller k of the two.

1. One pass counts shingles and describes each document: set size, a 128-bit BLAKE2b key of the set, and
   a parity bitmap with at least as many bits as the set has tokens. Equal sets are one *class* from
   here on, named by its key (copies are never expanded into pairs).
2. A second pass posts the prefixes, packed by token range, one posting per class and batch.
3. Per token range: short lists make counted candidate pairs. Long lists come back as rows (tokens that
   the counts show to be hot don't meet in one range at all); their members are compared block by
   block through the parity bitmaps, whose differing bits never exceed the size of the sets'
   difference, so that no similar pair is lost. Of a long list first every member's nearest partner in
   its block and each block's best connected member are tried, and these members among one another; then
   all remaining pairs of the members outside the list's largest component so far with all others. A
   group of near copies is one component by then, so its list is sent once and isn't compared again.
4. Pairs are verified on the whole sets; verified links make components. A class's set is that of any
   of its rows, found again by the row's hash and recognised by the set's key.

Words are told apart by 128-bit digests, shingles by 64-bit hashes folded word by word: of a pair's
some thousands of shingles two differing ones fall together with odds of about 1e-13.

Defined results: null or empty text has no shingles and is linked with nothing; texts with fewer
words than a shingle have one shingle, the whole sequence; documents with a null id take part as
members of their class but name no component; repeated rows are members of one class, rows with one
id and different texts are members of several, which it doesn't link; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_SHUFFLE, RUNTIME_FILTER, U64, as_bytes, bucket_of, cut, deal, dealt, first_fan, groups, mix, planes, ranges, run_batch, runs_in, settings, shingle_hashes, summed, tidy, unplanes, word_hashes
from .components import components

WIDTH_BITS = 20  # counters for the token order: 2**20 of 4 bytes
CHUNKS = 16
LEAST_BITS = 512
SHORT = 32  # lists up to this length make pairs at once
HOT = 1 << 16  # tokens counted more often than this don't meet in one range
BLOCK = 2048  # members of a long list that are compared with one another at a time
MOST_K = 6
BATCH_TOKENS = 1_000_000
NO_ID = -(2**63)
PAIR = "a binary, b binary"
NAMES, TYPES = ["tokens", "keys", "sizes", "ks"], (U64, "S16", np.uint32, np.uint8)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text, A-Z lower-cased."""
    words = word_hashes(text.lower())
    return np.unique(shingle_hashes(words, min(size, max(1, len(words)))))


def set_key(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one bit; so two bitmaps differ in at most as many bits as the sets in tokens, folded to the same length or not."""
    bits = max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    flips = np.bincount((mix(tokens + U64(77)) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(U64)


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (n, more words) as those of ``words`` words."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def keys_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "S16")


DESCRIBED = "part int, chunk int, doc_id long, hash long, n int, key binary, bitmap binary, counts binary"


def _describe(size: int):
    names = [f.split()[0] for f in DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, part = np.zeros(1 << WIDTH_BITS, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            n, key, maps = [], [], []
            for text in as_bytes(batch.column(2)):
                tokens = shingles(text, size)
                np.add.at(counters, (tokens >> U64(64 - WIDTH_BITS)).astype(np.int64), 1)
                n.append(len(tokens))
                key.append(set_key(tokens) if len(tokens) else None)
                maps.append(parity_bitmap(tokens).tobytes() if len(tokens) else None)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.int32()), pa.nulls(rows, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(maps, pa.binary()), pa.nulls(rows, pa.binary())], names=names)
        counts = [planes(np.minimum(c, 2**32 - 1).astype(np.uint32)) for c in np.split(counters, CHUNKS)]
        none = [pa.nulls(CHUNKS, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([part] * CHUNKS, pa.int32()), pa.array(np.arange(CHUNKS, dtype=np.int32)), *none, pa.array(counts, pa.binary())], names=names)

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(unplanes(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist())
    return table.slice(0, 1).set_column(2, "counts", pa.array([planes(np.minimum(total, 2**32 - 1).astype(np.uint32))], pa.binary()))


def prefix(tokens: np.ndarray, counts: np.ndarray, mean: float, percent: int) -> tuple[np.ndarray, int]:
    """The tokens to post, rarest first, and k: the number that a similar document must share."""
    n = len(tokens)
    seen = counts[(tokens >> U64(64 - WIDTH_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    first = n - -(-percent * n // 100) + 1
    last = min(n, first + MOST_K - 1)
    # expected lengths of the lists, and pairs that share k of them (at most their sum over k)
    cost = np.cumsum(np.maximum(1.0, seen[order[:last]] - mean))
    k = 1 + int(np.argmin([cost[first - 1 + j] * (1 + 4 / (1 + j)) for j in range(last - first + 1)]))
    return tokens[order[: first + k - 1]], k


def _post(size: int, percent: int, buckets: int, shared):
    fan = first_fan(buckets)

    def flush(held: list, hot: np.ndarray, batch: int) -> pa.RecordBatch:
        tokens = np.concatenate([x[0] for x in held])
        lengths = [len(x[0]) for x in held]
        cols = [np.repeat(np.array([x[j] for x in held], dtype=t), lengths) for j, t in enumerate(TYPES[1:], 1)]
        runs = []
        often = hot[(tokens >> U64(64 - WIDTH_BITS)).astype(np.int64)]
        for which in (~often, often):
            order = np.flatnonzero(which)
            order = order[np.argsort(tokens[order], kind="stable")]
            runs.append(deal(tokens[order], fan, *(c[order] for c in cols)))
        # hot tokens: in buckets numbered -1 and below, another one for each batch
        away = -1 - bucket_of(mix(runs[1][0].astype(U64) * U64(2**20) + U64(batch)), fan)
        return run_batch(np.concatenate((runs[0][0], away)), [a + b for a, b in zip(runs[0][1], runs[1][1], strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint32).astype(np.int64)
        mean, hot, number = counts.mean(), counts > HOT, TaskContext.get().partitionId() << 8
        held, total, classes = [], 0, set()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                tokens = shingles(text, size)
                if len(tokens):
                    key = set_key(tokens)
                    if key not in classes:
                        classes.add(key)
                        head, k = prefix(tokens, counts, mean, percent)
                        held.append((head, key, len(tokens), k))
                        total += len(head)
                        if total >= BATCH_TOKENS:
                            yield flush(held, hot, number)
                            held, total, classes, number = [], 0, set(), number + 1
        if held:
            yield flush(held, hot, number)

    return run


LISTS = "a binary, b binary, token long, n int, k int, c long"


def _lists(percent: int):
    """Counted candidate pairs (a < b) of the short lists; and postings (token, b, its size n) of long lists."""

    def run(table: pa.Table) -> pa.Table:
        t, names, n, k = runs_in(table.to_pylist(), NAMES, TYPES)
        names, key = np.unique(names, return_inverse=True)
        order = np.lexsort((key, t))
        t, key, n, k = t[order], key[order], n[order].astype(np.int64), k[order]
        fresh = np.ones(len(t), dtype=bool)
        fresh[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        t, key, n, k = t[fresh], key[fresh], n[fresh], k[fresh]
        starts, lengths = groups(t)
        if table.column("bucket")[0].as_py() < 0:
            lengths = np.full(len(starts), SHORT + 1)  # parts of longer lists
            long = np.arange(len(t))
        else:
            long = np.flatnonzero(np.repeat(lengths > SHORT, lengths))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(lengths[(lengths > 1) & (lengths <= SHORT)]):
            i, j = np.triu_indices(m, 1)  # keys are in order within a list
            at = starts[lengths == m]
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            left.append(x[ok])
            right.append(y[ok])
        x, y = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((key[y], key[x]))
        x, y = x[order], y[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (key[x][1:] != key[x][:-1]) | (key[y][1:] != key[y][:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(x)))
        x, y = x[at], y[at]
        pairs = [binary(names[key[x]]), binary(names[key[y]]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int32()), pa.array(np.minimum(k[x], k[y]).astype(np.int32)), pa.array(count)]
        posts = [pa.nulls(len(long), pa.binary()), binary(names[key[long]]), pa.array(t[long].view(np.int64)), pa.array(n[long].astype(np.int32)), pa.nulls(len(long), pa.int32()), pa.nulls(len(long), pa.int64())]
        return pa.table({f.split()[0]: pa.chunked_array(c) for f, c in zip(LISTS.split(", "), zip(pairs, posts, strict=True), strict=True)})

    return run


FAR = 1 << 30


class Side:
    """Members of one side of a block: keys, sizes, components (numbers) and bitmaps."""

    def __init__(self, table: pa.Table, rows: np.ndarray, components: np.ndarray):
        self.key, self.n = keys_of(table.column("key"))[rows], table.column("n").to_numpy()[rows].astype(np.int64)
        maps = table.column("bitmap").to_pylist()
        self.maps = [maps[i] for i in rows]
        self.words, self.comp = np.array([len(m) // 8 for m in self.maps]), components[rows]

    def bitmaps(self, rows: np.ndarray, words: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(self.maps[i] for i in rows), U64)
        return folded(raw.reshape(len(rows), -1), words)


def compared(x: Side, y: Side, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y, and the bits that each pair of them differs in: ``FAR`` where sizes or bits rule it out."""
    for a in np.unique(x.words):
        for b in np.unique(y.words):
            xs, ys, words = np.flatnonzero(x.words == a), np.flatnonzero(y.words == b), min(a, b)
            if 100 * min(x.n[xs].max(), y.n[ys].max()) < percent * max(x.n[xs].min(), y.n[ys].min()):
                continue
            bx, by, ny = x.bitmaps(xs, words), y.bitmaps(ys, words), y.n[ys][None, :]
            step = max(1, (1 << 22) // (len(ys) * int(words)))
            for i in range(0, len(xs), step):
                nx = x.n[xs[i : i + step]][:, None]
                total = nx + ny
                ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
                differ = np.bitwise_count(bx[i : i + step, None, :] ^ by[None, :, :]).sum(axis=2, dtype=np.int64)
                ok &= differ <= total - 2 * -(-percent * total // (100 + percent))
                yield xs[i : i + step], ys, np.where(ok, differ, FAR)


def _sides(table: pa.Table) -> tuple[Side, Side]:
    """The two sides of one block of a long list; a block of one side stands against itself."""
    side = table.column("side").to_numpy()
    order = np.argsort(keys_of(table.column("key")), kind="stable")
    components = np.unique(keys_of(table.column("comp")), return_inverse=True)[1]
    first, second = (order[side[order] == s] for s in (0, 1))
    x = Side(table, first, components)
    return x, Side(table, second, components) if len(second) else x


def _pairs_table(pairs: list) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, "S16"), *(p[i] for p in pairs)]) for i in (0, 1))
    return pa.table({"a": binary(a), "b": binary(b)})


LINKS = f"token long, {PAIR}"


def _nearest(percent: int):
    """Every member of a block with its nearest partner there, and with the member that has most partners, the block's hub: at most two pairs a member. The hub with itself stands for the block."""

    def run(table: pa.Table) -> pa.Table:
        x, _ = _sides(table)
        degree, best, partner, pairs = np.zeros(len(x.key), dtype=np.int64), np.full(len(x.key), FAR), np.zeros(len(x.key), dtype=np.int64), []
        for xs, ys, d in compared(x, x, percent):
            d[xs[:, None] == ys[None, :]] = FAR
            degree[ys] += (d < FAR).sum(axis=0)
            j = d.argmin(axis=1)
            least = d[np.arange(len(xs)), j]
            nearer = least < best[xs]
            best[xs[nearer]], partner[xs[nearer]] = least[nearer], ys[j[nearer]]
        ok = np.flatnonzero(best < FAR)
        pairs.append((x.key[ok], x.key[partner[ok]]))
        hub = int(degree.argmax())
        if degree[hub]:
            one = Side.__new__(Side)
            one.key, one.n, one.maps, one.words, one.comp = x.key[hub : hub + 1], x.n[hub : hub + 1], x.maps[hub : hub + 1], x.words[hub : hub + 1], x.comp[hub : hub + 1]
            for xs, _, d in compared(x, one, percent):
                near = xs[(d[:, 0] < FAR) & (x.key[xs] != x.key[hub])]
                pairs.append((x.key[near], np.repeat(one.key, len(near))))
        pairs.append((x.key[hub : hub + 1], x.key[hub : hub + 1]))
        found = _pairs_table(pairs)
        return found.add_column(0, "token", pa.array([table.column("token")[0].as_py()] * len(found), pa.int64()))

    return run


def _crossing(percent: int):
    """All pairs of two blocks that the bitmaps allow and that lie in different components."""

    def run(table: pa.Table) -> pa.Table:
        x, y = _sides(table)
        pairs = []
        if len(np.unique(np.concatenate((x.comp, y.comp)))) > 1:
            for xs, ys, d in compared(x, y, percent):
                i, j = np.nonzero((d < FAR) & (x.comp[xs][:, None] != y.comp[ys][None, :]))
                i, j = xs[i], ys[j]
                if x is y:
                    i, j = i[i < j], j[i < j]
                pairs.append((x.key[i], y.key[j]))
        return _pairs_table(pairs)

    return run


def _sets(size: int):
    """Key and tokens of each row's set, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, sets = [], []
            for text in as_bytes(batch.column(0)):
                tokens = shingles(text, size)
                key = set_key(tokens)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "tokens"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def jaccard_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64 of the text), n_shingles, component (the key of one of its classes; null without shingles) and component_id.

    ``component_id`` is the smallest id that links of similarity ``percent`` / 100 or more reach; null where all ids of a component are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    buckets = ranges(rows)
    described = cut(rows.select("doc_id", "hash", "text").mapInArrow(tidy(_describe(shingle)), DESCRIBED))
    members = described.where("chunk is null").select("doc_id", F.col("hash").alias("text_hash"), F.col("n").cast("long").alias("n_shingles"), "key")
    found = _components(rows, buckets, described, shingle, percent)
    empty = members.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"))
    return members.where("n_shingles > 0").join(found, "key", "left").select("doc_id", "text_hash", "n_shingles", "component", "component_id").unionByName(empty)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of ``jaccard_members``."""
    return jaccard_members(docs, id_col, text_col, shingle, percent).select("doc_id", "n_shingles", "component_id")


def _components(rows: DataFrame, buckets: int, described: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, component, component_id) of every class."""
    spark, members = rows.sparkSession, described.where("chunk is null")
    counts = summed(described.where("chunk is not null").select("part", "chunk", "counts"), _add_counts).orderBy("chunk").collect()  # 2**20 counters, whatever the input
    shared = spark.sparkContext.broadcast(b"".join(unplanes(bytes(r.counts), np.uint32).tobytes() for r in counts) or bytes(4 << WIDTH_BITS))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    classes = cut(members.where("n > 0").groupBy("key").agg(least.alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")).select("key", F.col("rep.doc_id").alias("rep"), F.col("rep.hash").alias("hash"), "n", "bitmap"))
    posted = rows.select("text").mapInArrow(tidy(_post(shingle, percent, buckets, shared)), "bucket int, tokens binary, keys binary, sizes binary, ks binary")
    lists = cut(dealt(posted, buckets, NAMES, TYPES).groupBy("bucket").applyInArrow(_lists(percent), LISTS))
    short = lists.where("token is null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("k").alias("k")).where("c >= k").select("a", "b")
    long = lists.where("token is not null").select("token", F.col("b").alias("key")).distinct()
    long = cut(long)

    def in_order(links: DataFrame) -> DataFrame:
        return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def blocked(lists: DataFrame, name: str) -> DataFrame:
        """``lists`` (token, key, ...) with the number of blocks of each list, and each member's block, under ``name``."""
        sizes = lists.groupBy("token").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias(f"{name}s"))
        return lists.join(sizes, "token").withColumn(name, F.pmod(F.xxhash64("key"), F.col(f"{name}s")).cast("int"))

    def nearby() -> DataFrame:
        """Pairs within the blocks of each long list, then within the blocks of these blocks' hubs, until a list is one block: each member is sent once."""
        found, members = None, long
        while True:
            sent = blocked(members, "block").join(labels, "key").withColumns({"comp": F.col("key"), "side": F.lit(0)})
            links = cut(sent.groupBy("token", "block").applyInArrow(_nearest(percent), LINKS))
            found = in_order(links) if found is None else found.union(in_order(links))
            hubs = links.where("a = b").select("token", F.col("a").alias("key"))
            members = cut(hubs.join(hubs.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "token"))
            if members.isEmpty():
                return found.distinct()

    def apart(now: DataFrame) -> DataFrame:
        """Pairs of each long list that lie in different components: of every member with those outside the list's largest component, block by block."""
        members = cut(long.join(now, "key"))
        counts = members.groupBy("token", "comp").agg(F.count("*").alias("c"))
        largest = counts.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("top.comp").alias("main"))
        split = cut(blocked(members.join(largest, "token"), "block"))
        rest = cut(blocked(split.where("comp <> main"), "other"))
        others = rest.select("token", "others").distinct()
        every = split.join(others, "token").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        again = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = lambda rows, n: rows.select("token", "block", "other", "key", "n", "bitmap", "comp", F.lit(n).alias("side"))
        return in_order(side(every, 0).unionByName(side(again, 1)).groupBy("token", "block", "other").applyInArrow(_crossing(percent), PAIR))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs with ``linked``, by the whole sets of the two classes."""
        pairs = cut(pairs)
        named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key")
        wanted = cut(named.select("hash", F.coalesce("rep", F.lit(NO_ID)).alias("row_id")).distinct())
        texts = rows.select("hash", F.coalesce("doc_id", F.lit(NO_ID)).alias("row_id"), "text")
        with settings(spark, **RUNTIME_FILTER, **BY_SHUFFLE):
            found = texts.join(wanted.where(F.col("row_id") >= F.lit(NO_ID)), ["hash", "row_id"], "left_semi")
            sets = cut(found.select("text").mapInArrow(tidy(_sets(shingle)), "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens")))
        side = lambda c: sets.select(F.col("key").alias(c), F.col("tokens").alias(f"{c}_tokens"))
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(tidy(_verify(percent)), "a binary, b binary, linked boolean"))

    def linked(checked: DataFrame) -> DataFrame:
        return components(checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))

    labels = classes.select("key", "n", "bitmap")
    has_long = not long.isEmpty()
    checked = verified(short.union(nearby()).distinct() if has_long else short)
    found = linked(checked)
    if has_long:
        now = labels.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "bitmap", F.coalesce("component", "key").alias("comp"))
        rest = apart(now).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = linked(checked.union(verified(rest)))
    # a component is named by its smallest document
    named = classes.select("key", "rep").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    return named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "component", "component_id")
