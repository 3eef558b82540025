"""Token ids of a corpus in binary files that can be read document by document.

A file is a sequence of independent zstandard frames, each of the ids (little-endian, unsigned, 2 or 4
bytes each) of consecutive documents, and at its end a skippable frame with the documents' ids and
lengths and one with the seek table: compressed size, size and checksum (the low 32 bits of XXH64) of
every frame. That is the public seekable format of zstandard, so any decoder reads the ids in a row,
and a reader that wants a few documents decompresses their frames only.

1. Rows are sorted by id into ranges, whose number follows the bytes of the texts. Ties are in the order
   of the texts' hashes, so that one id with a third of all rows lies in many ranges.
2. A task encodes its rows and writes them as they come, one file a range, with never more than a frame
   and the list of its documents in memory. A file's name holds the task's attempt; the manifest, a
   table written at the end, names the files that count, so lost or repeated attempts leave no trace in
   it. Files go to any store that pyarrow opens by its URI.
3. What a document's ids come after is the sum of the files before, one row each in the manifest, and of
   the documents before in its file.

Encoding: the library's normaliser and splitter never join what white space separates, so each distinct
run between white spaces is encoded once as long as it is remembered. Runs of printable ASCII and Latin-1
letters are split here as the library splits them, and its model encodes each distinct unit; all other
runs, and whole texts for tokenizers with another splitter, go through the library as they are. Tests
compare this with the encoding of whole texts.

Defined results: a null text counts as empty, and an empty text has the end id alone; ids that are null
come first; repeated rows are documents of their own; very long texts run over as many frames as they
need; an empty table has no files; other columns aren't read.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meridian.session import qualified, store

from .common import as_bytes, free, partitions

# fixed values of the file format
SKIPPABLE, SEEK_TABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 16
FILE_BYTES = 64 << 20  # of text for a file
GROUP_BYTES = 1 << 20  # of text encoded at a time
MOST_RUNS = 1 << 19
LONG_RUN = 64  # bytes; longer runs aren't kept
END = None  # stands for the end id among runs
#: The splitter that ``UNIT`` follows; texts for a tokenizer with another one are left to the library whole.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


# encoding -------------------------------------------------------------------------------------------
#: Letters whose class and case all versions of Unicode agree on, in UTF-8 and after A-Z are lower-cased.
LETTER = rb"[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: What the library's splitter makes of a run between white spaces that holds nothing but such letters and printable ASCII; a run that ``ODD`` finds something in is left to the library as it is.
UNIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:LETTER)+|[0-9]|[!-/:-@\[-`{-~]+".replace(b"LETTER", LETTER))
ODD = re.compile(rb"[^\x21-\x7E\x80-\xBF\xC3]|\xC3[\x97\xB7]|[^\xC3][\x80-\xBF]")
SPECIAL = b"<|"  # how the library's special tokens begin


class Units(dict):
    """Ids of the units of runs, found by the tokenizer's model as they come up."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.of = model, {}
        levels = ByteLevel(add_prefix_space=False, use_regex=False)
        for n in range(0xC0, 0x100):  # the characters that stand for the bytes of these letters
            shown = levels.pre_tokenize_str(chr(n))[0][0]
            self.of |= dict(zip(chr(n).encode(), shown, strict=True))

    def __missing__(self, unit: bytes) -> list[int]:
        word = unit.decode() if unit.isascii() else unit.decode().lower().encode().decode("latin-1").translate(self.of)
        self[unit] = ids = [t.id for t in self.model.tokenize(word)]
        return ids


class Encoder(dict):
    """Numbers the distinct runs between white spaces as they come up; their ids are found once as long as a run is remembered."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.library, self.end_id = Tokenizer.from_file(path), end_id
        made = json.loads(self.library.to_str())
        normalizers, splitters = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        steps = [n["type"] for n in normalizers.get("normalizers", [])], [p["type"] for p in splitters.get("pretokenizers", [])]
        self.known = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and splitters["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        self.units = Units(self.library.model) if self.known else None
        self.forget()

    @property
    def width(self) -> int:
        return 2 if max(self.library.get_vocab_size(), self.end_id + 1) <= 1 << 16 else 4

    def forget(self) -> None:
        self.clear()
        if self.known:
            self.units.clear()
        self.new, self.ids, self.lengths = [], np.array([self.end_id], np.uint32), np.ones(1, np.int64)
        self[END] = 0

    def __missing__(self, run: bytes) -> int:
        number = len(self.lengths) + len(self.new)
        self.new.append(run)
        if len(run) <= LONG_RUN:
            self[run] = number
        return number

    def runs(self, text: bytes) -> list[bytes]:
        if not self.known:
            return [text]
        if SPECIAL not in text:
            return text.lower().split()
        return [run if SPECIAL in run else run.lower() for run in text.split()]

    def resolve(self) -> list[list[int]]:
        """Ids of the new runs: those of their units, or what the library makes of a run."""
        found: list[list[int]] = []
        rest, units = [], self.units
        for run in self.new:
            if not self.known or ODD.search(run) or SPECIAL in run:
                rest.append(len(found))
                found.append([])
                continue
            parts = UNIT.findall(run)
            found.append(units[parts[0]] if len(parts) == 1 else [i for u in parts for i in units[u]])
        for i, e in zip(rest, self.library.encode_batch_fast([self.new[i].decode() for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with the end id, and their numbers."""
        if len(self.lengths) > MOST_RUNS:
            self.forget()
        runs: list[bytes | None] = []
        for text in texts:
            runs += self.runs(text)
            runs.append(END)
        numbers = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        if self.new:
            found = self.resolve()
            self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, found), np.int64, len(found))))
            self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32)))
            self.new = []
        each, starts = self.lengths[numbers], (np.cumsum(self.lengths) - self.lengths)[numbers]
        ends = np.cumsum(each)
        ids = self.ids[np.repeat(starts - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = ends[np.flatnonzero(numbers == 0)]
        return ids, np.diff(last, prepend=0)


# files ----------------------------------------------------------------------------------------------
class Writer:
    """One file; documents come in order."""

    def __init__(self, out, width: int):
        self.out, self.form = out, f"<u{width}"
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.squeeze = zstandard.ZstdCompressor(level=3)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= FRAME_IDS:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        until = len(ids) if last else len(ids) // FRAME_IDS * FRAME_IDS
        for at in range(0, until, FRAME_IDS):
            raw = ids[at : min(at + FRAME_IDS, until)].astype(self.form).tobytes()
            frame = self.squeeze.compress(raw)
            self.out.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.waiting = [ids[until:]], len(ids) - until

    def close(self) -> None:
        self._flush(last=True)
        none = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths]).astype("<i8")
        index = self.squeeze.compress(struct.pack("<BQ", int(self.form[2]), len(ids)) + none.tobytes() + ids.tobytes() + lengths.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class Reader:
    """One file, of which frames are read as documents are asked for; ``read`` counts them."""

    def __init__(self, file):
        self.file, size = file, file.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: no seek table at its end")
        length = 12 * frames + 9
        head = self._at(size - length - 8, length + 8)
        if struct.unpack_from("<II", head) != (SEEK_TABLE, length):
            raise ValueError("not a token file: damaged seek table")
        table = np.frombuffer(head, "<u4", 3 * frames, 8).reshape(-1, 3).astype(np.int64)
        self.sizes, self.checks = table[:, :2], table[:, 2]
        self.places = np.cumsum(table[:, 0]) - table[:, 0]
        index = self._at(int(self.places[-1]) + 8, int(self.sizes[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != self.checks[-1]:
            raise ValueError("damaged token file: its list of documents doesn't match the checksum")
        index = zstandard.ZstdDecompressor().decompress(index)
        self.width, n = struct.unpack_from("<BQ", index)
        none, ids, self.lengths = np.frombuffer(index, np.uint8, n, 9), np.frombuffer(index, "<i8", n, 9 + n), np.frombuffer(index, "<i8", n, 9 + 9 * n)
        self.doc_ids = [None if x else int(i) for x, i in zip(none, ids, strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ends = np.cumsum(self.sizes[:-1, 1]) // self.width  # of the frames, in ids
        self.expand, self.read, self.last = zstandard.ZstdDecompressor(), 0, (-1, None)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            raw = self.expand.decompress(self._at(int(self.places[i]), int(self.sizes[i, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
                raise ValueError(f"damaged token file: frame {i} doesn't match its checksum")
            self.last, self.read = (i, np.frombuffer(raw, f"<u{self.width}")), self.read + 1
        return self.last[1]

    def pieces(self, document: int) -> Iterator[np.ndarray]:
        """The ids of the file's n-th document, frame by frame."""
        at, end = int(self.starts[document]), int(self.starts[document] + self.lengths[document])
        i = int(np.searchsorted(self.ends, at, side="right"))
        while at < end:
            ids, first = self.frame(i), int(self.ends[i]) - len(self.frame(i))
            upto = min(end, int(self.ends[i]))
            yield ids[at - first : upto - first]
            at, i = upto, i + 1

    def ids(self, document: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.pieces(document)]).astype(np.uint32)


# Spark ----------------------------------------------------------------------------------------------
MANIFEST = "part int, file string, documents long, ids long, least long, most long, nulls long"


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, file, out, writer = task.partitionId(), "", None, None
        encoder = Encoder(path, end_id)
        gc.disable()  # there are no cycles, and its passes would go through all that is remembered
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
                at = 0
                while at < len(texts):
                    upto, size = at, 0
                    while upto < len(texts) and (upto == at or size + len(texts[upto]) <= GROUP_BYTES):
                        size, upto = size + len(texts[upto]), upto + 1
                    if writer is None:
                        file = f"part-{part:06d}-{task.taskAttemptId()}.ids.zst"
                        files, place = store(folder)
                        files.create_dir(place, recursive=True)
                        out = files.open_output_stream(f"{place}/{file}", compression=None)  # not by the name: the frames are compressed as they are
                        writer = Writer(out, encoder.width)
                    writer.add(doc_ids[at:upto], *encoder.encode(texts[at:upto]))
                    at = upto
            if writer is not None:
                writer.close()
        finally:
            if out is not None:
                out.close()
            gc.enable()
            free()
        if writer is not None:
            known = [d for d in writer.doc_ids if d is not None]
            row = [part, file, len(writer.doc_ids), writer.total, min(known, default=None), max(known, default=None), len(writer.doc_ids) - len(known)]
            yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in MANIFEST.split(", ")), row, strict=True))], schema=pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in MANIFEST.split(", ")]))

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by ``end_id``, as files of ``folder``/data in ascending order of ids, and ``folder``/manifest.

    ``tokenizer`` is the path of a file of the tokenizers library, which every worker must have.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(partitions(spark), -(-size // FILE_BYTES))
    # equal rows have no order of their own, but may lie in different ranges
    order = ["doc_id", "tie", "nth"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_write(f"{qualified(spark, folder)}/data", tokenizer, end_id), MANIFEST).write.parquet(f"{folder}/manifest")


def _read(folder: str, wanted: frozenset | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{place}/{file}") as opened:
                    reader = Reader(opened)
                    which = [i for i, d in enumerate(reader.doc_ids) if wanted is None or d in wanted]
                    for at in range(0, len(which), 1024 if not with_ids else 16):
                        some = which[at : at + (1024 if not with_ids else 16)]
                        crc, ids = [], []
                        for i in some:
                            check, held = 0, []
                            for piece in reader.pieces(i):
                                piece = piece.astype("<u4")
                                check = zlib.crc32(piece, check)
                                if with_ids:
                                    held.append(piece)
                            crc.append(check)
                            ids.append(np.concatenate(held).astype(np.int32) if held else None)
                        columns = [pa.array([reader.doc_ids[i] for i in some], pa.int64()), pa.array([base + int(reader.starts[i]) for i in some], pa.int64()), pa.array([int(reader.lengths[i]) for i in some], pa.int64()), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return run


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of all documents of ``folder``, or of those with the ids ``wanted``.

    Files without a wanted document aren't opened, frames without one not decompressed.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before)  # one row a file
    if wanted is not None:
        files = files.where(F.exists(F.lit(sorted(wanted)).cast("array<long>"), lambda d: d.between(F.col("least"), F.col("most"))))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    spread = files.select("file", "base").repartition(max(partitions(spark), 1), "file")
    return spread.mapInArrow(_read(f"{qualified(spark, folder)}/data", None if wanted is None else frozenset(wanted), with_ids), schema)
