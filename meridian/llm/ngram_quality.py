"""Quality rules: surface counts, and perplexity under a modified Kneser-Ney model of byte 5-grams.

1. *Counting*. Tasks count the 5-grams of their texts, chunk by chunk (a chunk is a run of rows of one
   file, whatever their ids, of 128 MB at most, or one text), as sorted arrays of codes, dealt by range of
   the codes' hashes; Spark adds them up, a range in as many parts as its counts' size asks for. The code of a 5-gram is its five bytes in a long, a hash without collisions.
2. *Model*. Continuation counts, context totals, discounts and interpolated probabilities of the
   orders 1 to 5 are DataFrame aggregations and joins keyed by gram, context or suffix. The model
   grows with the text and is never broadcast: it is written to the shared folder as one pair of
   arrays (sorted codes, log-probabilities) for each hash range.
3. *Scoring*. Each chunk's distinct grams are looked up in these arrays, and the answers, in the
   grams' order, meet the chunk's texts. As the model is made of all texts, every gram of a text is in it.
4. *Bands*. Per language, the median and the quartiles of the perplexity's logarithm (per byte) over
   all texts that pass the counts; texts too far below or above the median are rejected. Short
   texts vary more, so the bands widen with 1 / sqrt(bytes).

Defined results: null or empty text has no words and fails the counts; a null language is a language
of its own; rows with a null id and repeated rows get the results of their texts; long texts are
worked on as a whole, a chunk at a time; an empty table gives an empty result; columns other than id,
text and lang aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, as_bytes, cut, mix, pack_sorted, partitions, planes, unpack_sorted, unplanes
from .line_crf import grouped

ORDER = 5
CHUNK_ROWS, SMALL_BITS = 2048, 16
PART_BYTES = 64 << 20  # of compressed counts that are worked on together
FLUSH_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
COUNTED = "bucket int, chunk long, grams binary, counts binary"


def small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 5-gram that ends at each byte (zeros before a text's first), and the text of each."""
    pad = bytes(ORDER - 1)
    buf = np.frombuffer(pad + pad.join(texts), np.uint8).astype(U64)
    code = np.zeros(max(0, len(buf) - ORDER + 1), dtype=U64)
    for i in range(ORDER):
        code = (code << U64(8)) | buf[i : i + len(code)]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    # a text's grams begin (ORDER - 1) bytes after those of the text before end
    return code[np.arange(len(owner)) + owner * (ORDER - 1)], owner


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams) >> U64(32)).astype(np.int64) * buckets >> 32


def _count(buckets: int):
    def flush(chunk: int, texts: list[bytes]) -> pa.RecordBatch:
        grams, counts = np.unique(gram_codes(texts)[0], return_counts=True)
        bucket = bucket_of(grams, buckets)
        order = np.argsort(bucket, kind="stable")  # within a bucket by code
        grams, counts, edges = grams[order], counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = [(b, grams[i:j], counts[i:j]) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([small(pack_sorted(r[1])) for r in out], pa.binary()), pa.array([small(planes(r[2].astype(np.int64))) for r in out], pa.binary())],
            names=["bucket", "chunk", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        sizes: Counter = Counter()
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if text:
                    held.setdefault(chunk, []).append(text)
                    sizes[chunk] += len(text)
                    if sizes[chunk] >= FLUSH_BYTES:
                        yield flush(chunk, held.pop(chunk))
                        del sizes[chunk]
                    elif sizes.total() >= 4 * FLUSH_BYTES:  # many chunks in one task
                        for c in list(held):
                            yield flush(c, held.pop(c))
                        sizes.clear()
        for c in list(held):
            yield flush(c, held.pop(c))

    return run


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([unpack_sorted(large(x)) for x in table.column("grams").to_pylist()])
    counts = np.concatenate([unplanes(large(x), np.int64) for x in table.column("counts").to_pylist()])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.add.reduceat(counts, starts)


def _add_up(table: pa.Table) -> pa.Table:
    grams, counts = _totals(table)
    return pa.table({"gram": pa.array(grams.view(np.int64)), "c": pa.array(counts)})


def _add_part(table: pa.Table) -> pa.Table:
    grams, counts = _totals(table)
    return pa.table({"bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "grams": pa.array([small(pack_sorted(grams))], pa.binary()), "counts": pa.array([small(planes(counts))], pa.binary())})


def part_of(parts: int) -> Column:
    """A bucket's rows are worked on in so many parts, by chunk."""
    return F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part")


def added_up(counted: DataFrame, parts: int) -> DataFrame:
    """(gram, c): the counts of all chunks, added up in parts of each bucket, and these 16 at a time, so that no group grows with the input."""
    runs = counted.select("bucket", part_of(parts), "grams", "counts")
    while parts > 1:
        runs = runs.groupBy("bucket", "part").applyInArrow(_add_part, "bucket int, part int, grams binary, counts binary").withColumn("part", F.expr("cast(part div 16 as int)"))
        parts = -(-parts // 16)
    return cut(runs.groupBy("bucket").applyInArrow(_add_up, "gram long, c long"))


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of grams seen 1, 2, 3 and 4 times."""
    if not all(n[:2]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp): the interpolated probability of each gram's last byte after the others."""
    tables = {order: counts.select("gram", "c")}
    for n in range(order - 1, 0, -1):  # continuation counts: how many bytes stand before the gram
        tables[n] = cut(tables[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count("*").alias("c")))
    seen = {n: t.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first() for n, t in tables.items()}  # 4 numbers an order
    p = None
    for n in range(1, order + 1):
        d = discounts(list(seen[n]))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = tables[n].withColumn("context", F.shiftright("gram", 8))
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off).alias("held_back"))
        t = t.join(contexts, "context").withColumn("lower", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        t = t.withColumn("p_lower", F.lit(1 / 256)) if p is None else t.join(p.withColumnRenamed("gram", "lower").withColumnRenamed("p", "p_lower"), "lower")
        p = t.select("gram", ((F.col("c") - off + F.col("held_back") * F.col("p_lower")) / F.col("total")).alias("p"))
        if n in (2, 4):
            p = cut(p)
    return p.select("gram", F.log("p").cast("float").alias("logp"))


def _store(table: pa.Table) -> pa.Table:
    """A bucket of the model as arrays sorted by code."""
    grams = table.column("gram").to_numpy().view(U64)
    order = np.argsort(grams)
    arrays = small(pack_sorted(grams[order])), small(planes(table.column("logp").to_numpy()[order].astype(np.float32)))
    return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "grams": pa.array([arrays[0]], pa.binary()), "logps": pa.array([arrays[1]], pa.binary())})


def _look_up(asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each chunk the log-probabilities of its distinct grams in this bucket, by code; the chunk has the grams themselves."""
    if not asked.num_rows:  # no chunk of this part has a gram of the bucket
        return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "logps": pa.array([], pa.binary())})
    stored = model.to_pylist()[0]
    grams, logp = unpack_sorted(large(stored["grams"])), unplanes(large(stored["logps"]), np.float32)
    parts: dict[int, list[bytes]] = {}
    for r in asked.to_pylist():
        parts.setdefault(r["chunk"], []).append(r["grams"])
    answers = []
    for packed in parts.values():
        at = np.searchsorted(grams, np.unique(np.concatenate([unpack_sorted(large(x)) for x in packed])))
        answers.append(small(planes(logp[at])))
    return pa.table({"chunk": pa.array(list(parts), pa.int64()), "bucket": pa.array(asked.column("bucket").to_pylist()[:1] * len(parts), pa.int32()), "logps": pa.array(answers, pa.binary())})


def surface(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= sum(len(w) - len(w.decode("utf-8", "surrogatepass")) for w in words if not w.isascii())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    runs = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(runs)) < len(runs):
        often, covered = Counter(runs), -1  # covered: the last word counted so far
        for i, run in enumerate(runs):
            if often[run] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk as compressed blocks, half as large in the shuffle as rows are."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        blocks = []
        for parts in held.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as w:
                for p in parts:
                    w.write_batch(p)
            blocks.append(small(sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blocks, pa.binary())], names=["chunk", "block"])

    for batch in batches:
        chunks = batch.column(0).to_numpy()
        rows = batch.select(["doc_id", "lang", "text"])
        for chunk in np.unique(chunks):
            part = rows.take(pa.array(np.flatnonzero(chunks == chunk)))
            held.setdefault(int(chunk), []).append(part)
            size += part.nbytes
        if size >= FLUSH_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _measure(buckets: int):
    """The surface counts of each text of a chunk, and the sum of its bytes' log-probabilities."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [pa.ipc.open_stream(large(x)).read_all() for x in docs.column("block").to_pylist()]
        found = [np.unique(gram_codes(held)[0]) for part in rows for held in grouped(as_bytes(part.column("text").combine_chunks()))]
        grams = np.unique(np.concatenate([np.zeros(0, U64), *found]))
        bucket, logps = bucket_of(grams, buckets), np.zeros(len(grams))
        order = np.argsort(bucket, kind="stable")  # within a bucket by code, as the answers are
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for r in answers.to_pylist():
            logps[order[edges[r["bucket"]] : edges[r["bucket"] + 1]]] = unplanes(large(r["logps"]), np.float32)
        return pa.concat_tables([_measured(part, grams, logps) for part in rows])

    return run


def _measured(docs: pa.Table, grams: np.ndarray, logps: np.ndarray) -> pa.Table:
    texts = as_bytes(docs.column("text").combine_chunks())
    sums, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= 1 << 20 or i + 1 == len(texts):
            codes, owner = gram_codes(held)
            sums.append(np.bincount(owner, logps[np.searchsorted(grams, codes)], minlength=len(held)) if len(codes) else np.zeros(len(held)))
            held, size = [], 0
    counts = np.array([surface(t) for t in texts], dtype=np.int64).reshape(-1, 5)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return pa.table({"doc_id": docs.column("doc_id").combine_chunks(), "lang": docs.column("lang").combine_chunks(), **{c: pa.array(counts[:, i]) for i, c in enumerate(names)}, "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "log_p": pa.array(np.concatenate(sums) if sums else np.zeros(0))})


MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_p double"


def bands(scored: DataFrame) -> DataFrame:
    """Per language: median and quartile spread of log_ppl, from a histogram of steps of 1/1000."""
    steps = scored.where("not base_failed").groupBy("lang", F.floor(F.col("log_ppl") * 1000).alias("step")).agg(F.count("*").alias("n"))
    w = W.partitionBy("lang").orderBy("step")
    steps = steps.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) + 0.5) / 1000
    found = steps.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return found.select(F.col("lang").alias("band_lang"), F.col("q2").alias("middle"), ((F.col("q3") - F.col("q1")) / 1.349).alias("spread"))


def in_chunks(docs: DataFrame, columns: list[Column], text: Column) -> DataFrame:
    """The columns with ``chunk``, a hash of the row's file, of its place there in steps of CHUNK_ROWS, and of its text's size.

    A text of at least 2**16 bytes has a step half as long for each power of two: a chunk has 2**27 bytes
    at most, or one text. Shorter ones share chunks, whatever their sizes: each chunk asks for its distinct
    grams, so few texts in a chunk cost more than many. Rows that aren't read from files are written first.
    """
    size = F.greatest(F.lit(0), F.length(F.bin(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))) - SMALL_BITS)
    steps = F.greatest(F.lit(1), F.call_function("shiftright", F.lit(CHUNK_ROWS), F.least(size, F.lit(30))))
    chunk = F.xxhash64(F.col("_metadata.file_path"), size, F.floor(F.col("_metadata.row_index") / steps)).alias("chunk")
    try:
        return docs.select(*columns, chunk)
    except AnalysisException:
        written = cut(docs.select(*columns))
        return written.select(*written.columns, chunk)


def ngram_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 2.0, short: float = 3.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, the surface counts, base_failed, log_ppl (per byte), lower, upper, kept.

    A text is kept if it passes the counts and lies within ``width`` spreads plus ``short`` / sqrt(bytes) of its language's median.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = in_chunks(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")], F.col(text_col))
    counted = cut(rows.select("chunk", "text").mapInArrow(_count(buckets), COUNTED))
    size = counted.agg(F.sum(F.octet_length("grams") + F.octet_length("counts"))).first()[0] or 0
    parts = max(1, -(-size // (buckets * part_bytes)))
    model = kneser_ney(added_up(counted, parts))
    asked = counted.select("bucket", part_of(parts), "chunk", "grams")
    dealt = model.mapInArrow(_bucket_of(buckets), "bucket int, gram long, logp float")
    stored = cut(dealt.groupBy("bucket").applyInArrow(_store, "bucket int, grams binary, logps binary"))
    if parts > 1:  # a bucket of the model goes to each of its parts: it holds distinct grams, which grow far slower than what is asked
        stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    else:
        stored = stored.withColumn("part", F.lit(0))
    answers = asked.groupBy("bucket", "part").cogroup(stored.groupBy("bucket", "part")).applyInArrow(_look_up, "chunk long, bucket int, logps binary")
    packed = rows.select("chunk", "doc_id", "lang", "text").mapInArrow(_pack, "chunk long, block binary")
    measured = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_measure(buckets), MEASURED)
    scored = cut(
        measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("log_ppl", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes")))
    )
    limits = bands(scored)
    out = scored.join(limits, scored.lang.eqNullSafe(limits.band_lang), "left")
    reach = width * F.col("spread") + short / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    out = out.withColumn("lower", F.col("middle") - reach).withColumn("upper", F.col("middle") + reach)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_ppl", "lower", "upper")


def _bucket_of(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy()
            bucket = bucket_of(gram.view(U64), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), batch.column(1)], names=["bucket", "gram", "logp"])

    return run
