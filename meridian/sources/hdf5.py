"""NetCDF-4 files, which are HDF5 containers: fields in and out, in numpy.

Read are datasets of the root group that hold fixed or floating point numbers: contiguous, compact or
chunked, the chunks found by a B-tree of version 1, a fixed array, an implicit or a single-chunk index
and undone from shuffle, deflate, zstandard and Fletcher-32; superblocks 0 to 3, both kinds of object
headers, groups and attributes kept in the header, in symbol tables or in fractal heaps. Bytes are asked
for as they are needed: headers, and the block or the chunks that hold the rows wanted. Other filters
and indexes, committed types and compound values make a dataset ``Unreadable``.

Dimensions are those that DIMENSION_LIST names. A file without dimension scales has its dimensions named
after the one-dimensional datasets of their length, where each length belongs to one of them only;
otherwise the dataset's dimensions stay unknown and it isn't taken for a field. Nothing is guessed.

Written are datasets of doubles and floats, contiguous or in compressed chunks, with attributes and
dimension scales, in the oldest version of each structure, which every reader knows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from .ranged import Source

SIGNATURE = b"\x89HDF\r\n\x1a\n"
# fixed values of the file format: message types, filters, chunk indexes
DATASPACE, LINK_INFO, DATATYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x4, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15
DEFLATE, SHUFFLE, FLETCHER32, ZSTANDARD = 1, 2, 3, 32015
SINGLE, IMPLICIT, FIXED_ARRAY = 1, 2, 3
SCALE, NO_VARIABLE = "DIMENSION_SCALE", "This is a netCDF dimension but not a netCDF variable."
MOST_RANK = 32
MOST_BYTES = 1 << 32  # of an array: a damaged header may ask for anything


class Unreadable:
    """Stands for a dataset that is there but can't be read; the reason comes up when it is asked for."""

    def __init__(self, reason: str):
        self.reason = reason


@dataclass
class Variable:
    """A variable of a file; ``read(first, last)`` gives its values, or those of some rows: of its first dimension that is longer than 1."""

    dims: list[str | None]
    shape: list[int]
    dtype: np.dtype
    notes: dict
    read: Callable[..., np.ndarray]
    references: list[int] | None = field(default=None, repr=False)


def rows_axis(shape: list[int]) -> int:
    return next((i for i, n in enumerate(shape) if n > 1), 0)


def _bytes_for(most: int) -> int:
    """Bytes that the format takes for numbers up to ``most``."""
    return (max(1, most).bit_length() - 1) // 8 + 1


class _File:
    def __init__(self, source: Source):
        self.source = source
        version = self.raw(8, 1)[0]
        if version in (0, 1):
            self.o, self.l = self.raw(13, 2)
            at = 24 if version == 0 else 28
            self.base = self.number(at, self.o)
            self.root = self.number(at + 5 * self.o, self.o) + self.base  # after four addresses and the entry's name
        elif version in (2, 3):
            self.o, self.l = self.raw(9, 2)
            self.base = self.number(12, self.o)
            self.root = self.number(12 + 3 * self.o, self.o) + self.base
        else:
            raise ValueError(f"HDF5 superblock {version}")
        if self.o not in (2, 4, 8) or self.l not in (2, 4, 8):
            raise ValueError("damaged HDF5 superblock")
        self.seen: set[tuple[str, int]] = set()

    def raw(self, at: int, n: int) -> bytes:
        return self.source.read(at, n)

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.raw(at, size), "little")

    def place(self, at: int) -> int | None:
        """The offset that an address points to, or nothing."""
        n = self.number(at, self.o)
        return None if n == (1 << 8 * self.o) - 1 else n + self.base

    def enter(self, what: str, at: int | None) -> int:
        """An offset that is visited once: damaged files may go in circles."""
        if at is None or (what, at) in self.seen:
            raise ValueError(f"damaged HDF5 {what}")
        self.seen.add((what, at))
        return at

    def expect(self, at: int | None, signature: bytes) -> int:
        if at is None or self.raw(at, 4) != signature:
            raise ValueError(f"damaged HDF5 file: no {signature.decode()}")
        return at

    # object headers ---------------------------------------------------------------------------------
    def messages(self, at: int) -> list[tuple[int, int, int]]:
        """(type, offset, size) of all messages of an object header; shared ones, which are kept elsewhere, have type -1."""
        found, blocks, visited = [], [], set()
        if self.raw(at, 4) == b"OHDR":
            flags, at = self.raw(at + 5, 1)[0], at + 6
            at += 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width, head = 1 << (flags & 3), 4 + 2 * bool(flags & 4)
            blocks, kind_size, rest = [(at + width, self.number(at, width))], 1, (4, 8)
        else:
            if self.raw(at, 1)[0] != 1:
                raise ValueError("damaged HDF5 object header")
            blocks, kind_size, head, rest = [(at + 16, self.number(at + 8, 4))], 2, 8, (0, 0)
        while blocks:
            at, size = blocks.pop(0)
            if at in visited:
                raise ValueError("damaged HDF5 object header")
            visited.add(at)
            end = at + size
            while at + head <= end:
                kind, n, flags = self.number(at, kind_size), self.number(at + kind_size, 2), self.raw(at + kind_size + 2, 1)[0]
                if kind == CONTINUATION:
                    blocks.append((self.place(at + head) + rest[0], self.number(at + head + self.o, self.l) - rest[1]))
                found.append((-1 if flags & 2 else kind, at + head, n))
                at += head + n
        return found

    def link(self, at: int) -> tuple[str, int] | None:
        """Name and object header of a hard link."""
        flags, at = self.raw(at + 1, 1)[0], at + 2
        soft = bool(flags & 8) and self.raw(at, 1)[0] != 0
        at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 0x10)
        width = 1 << (flags & 3)
        size, at = self.number(at, width), at + width
        return None if soft else (self.raw(at, size).decode(), self.place(at + size))

    def members(self, header: int) -> dict[str, int]:
        """Object headers of a group's members by name."""
        out: dict[str, int] = {}
        for kind, at, _ in self.messages(header):
            if kind == SYMBOL_TABLE:
                heap = self.expect(self.place(at + self.o), b"HEAP")
                self._walk(self.place(at), self.place(heap + 8 + 2 * self.l), out)
            elif kind == LINK and (one := self.link(at)):
                out[one[0]] = one[1]
            elif kind == LINK_INFO:
                at += 2 + 8 * bool(self.raw(at + 1, 1)[0] & 1)
                if self.place(at) is not None:
                    heap = _Heap(self, self.place(at))
                    for record in self.records(self.place(at + self.o)):
                        if one := self.link(heap.find(record[4:])):
                            out[one[0]] = one[1]
        return out

    def _walk(self, at: int | None, names: int, out: dict[str, int]) -> None:
        at = self.enter("group", at)
        if self.raw(at, 4) == b"TREE":
            child = at + 8 + 2 * self.o + self.l
            for i in range(self.number(at + 6, 2)):
                self._walk(self.place(child + i * (self.o + self.l)), names, out)
        else:
            self.expect(at, b"SNOD")
            for i in range(self.number(at + 6, 2)):
                entry = at + 8 + i * (2 * self.o + 24)
                out[self.text(names + self.number(entry, self.o))] = self.place(entry + self.o)

    def text(self, at: int) -> str:
        """A text that ends in a zero byte."""
        out = b""
        while b"\0" not in out:
            out += self.raw(at + len(out), min(64, self.source.size - at - len(out)) or 1)
        return out.split(b"\0")[0].decode()

    def records(self, at: int | None) -> Iterator[bytes]:
        """The records of a B-tree of version 2."""
        self.expect(at, b"BTHD")
        node, size, depth = self.number(at + 6, 4), self.number(at + 10, 2), self.number(at + 12, 2)
        if not size or node < 10 + size or depth > 8:
            raise ValueError("damaged HDF5 B-tree")
        root, n = self.place(at + 16), self.number(at + 16 + self.o, 2)
        most = [(node - 10) // size]  # records of a node, and of all below it, by depth
        total, pointers = [most[0]], [0]
        for d in range(1, depth + 1):
            pointers.append(self.o + _bytes_for(most[0]) + (_bytes_for(total[-1]) if d > 1 else 0))
            most.append((node - 10 - pointers[d]) // (size + pointers[d]))
            total.append((most[d] + 1) * total[d - 1] + most[d])

        def visit(at: int | None, n: int, depth: int) -> Iterator[bytes]:
            self.expect(self.enter("B-tree", at), b"BTIN" if depth else b"BTLF")
            if depth:
                first = at + 6 + n * size
                for i in range(n + 1):
                    child = first + i * pointers[depth]
                    yield from visit(self.place(child), self.number(child + self.o, _bytes_for(most[0])), depth - 1)
            yield from (self.raw(at + 6 + i * size, size) for i in range(n))

        if root is not None:
            yield from visit(root, n, depth)

    # types and values -------------------------------------------------------------------------------
    def space(self, at: int) -> list[int]:
        version, rank = self.raw(at, 2)
        if rank > MOST_RANK or version not in (1, 2):
            raise ValueError("damaged HDF5 dataspace")
        if version == 2 and self.raw(at + 3, 1)[0] == 2:
            return [0]  # no value at all
        first = at + (8 if version == 1 else 4)
        return [self.number(first + i * self.l, self.l) for i in range(rank)]

    def kind(self, at: int) -> str | None:
        """A numpy type, or nothing for what isn't a number or a text of fixed length."""
        what, flags, size = self.raw(at, 1)[0] & 15, self.raw(at + 1, 1)[0], self.number(at + 4, 4)
        order = ">" if flags & 1 else "<"
        if what == 0 and size in (1, 2, 4, 8):
            return f"{order}{'i' if flags & 8 else 'u'}{size}"
        if what == 1 and size in (2, 4, 8):
            return f"{order}f{size}"
        return f"S{size}" if what == 3 and size else None

    def heap_object(self, at: int) -> bytes:
        """What a length, an address and an index in a global heap stand for."""
        n, heap, wanted = self.number(at, 4), self.place(at + 4), self.number(at + 4 + self.o, 4)
        if not n or heap is None or not wanted:
            return b""
        end = self.expect(heap, b"GCOL") + self.number(heap + 8, self.l)
        at = heap + 8 + self.l
        while at + 8 + self.l <= end:
            index, size = self.number(at, 2), self.number(at + 8, self.l)
            if index == wanted:
                return self.raw(at + 8 + self.l, size)
            if not index:
                break
            at += 8 + self.l + -(-size // 8) * 8
        raise ValueError("damaged HDF5 global heap")

    def attribute(self, at: int):
        """Name and value: an array of numbers, a text, a list of object addresses for references; nothing for what else there is."""
        version, flags, *_ = self.raw(at, 2)
        sizes = [self.number(at + 2 + 2 * i, 2) for i in range(3)]
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = at + 8 + (version == 3)
        kind = name + pad(sizes[0])
        space = kind + pad(sizes[1])
        data, text = space + pad(sizes[2]), self.raw(name, sizes[0]).split(b"\0")[0].decode()
        if flags & 3:
            return text, None  # its type or space is kept elsewhere
        shape, what = self.space(space), self.raw(kind, 1)[0] & 15
        n = math.prod(shape)
        if what == 9:  # of variable length: texts, or references to dimension scales
            step, inner = 8 + self.o, self.raw(kind + 8, 1)[0] & 15
            held = [(self.number(data + i * step, 4), self.heap_object(data + i * step)) for i in range(min(n, MOST_RANK))]
            if self.raw(kind + 1, 1)[0] & 15 == 1:
                return text, held[0][1][: held[0][0]].split(b"\0")[0].decode() if held else ""
            return text, [int.from_bytes(x[: self.o], "little") + self.base for _, x in held] if inner == 7 else None
        form = self.kind(kind)
        if form is None:
            return text, None
        size = np.dtype(form).itemsize
        values = np.frombuffer(self.raw(data, n * size), form, n)
        return text, values[0].decode() if form[0] == "S" and n else values

    def attributes(self, header: int, messages: list[tuple[int, int, int]]) -> dict:
        found = [self.attribute(at) for kind, at, _ in messages if kind == ATTRIBUTE]
        for kind, at, _ in messages:
            if kind == ATTRIBUTE_INFO:
                at += 2 + 2 * bool(self.raw(at + 1, 1)[0] & 1)
                if self.place(at) is not None:
                    heap = _Heap(self, self.place(at))
                    found += [self.attribute(heap.find(r)) for r in self.records(self.place(at + self.o))]
        return {name: value for name, value in found if value is not None}

    # datasets ---------------------------------------------------------------------------------------
    def filters(self, at: int) -> list[int]:
        version, n = self.raw(at, 2)
        at, found = at + (8 if version == 1 else 2), []
        for _ in range(n):
            kind = self.number(at, 2)
            named = version == 1 or kind >= 256
            name = self.number(at + 2, 2) if named else 0
            values = self.number(at + 4 + 2 * named, 2)
            at += 6 + 2 * named + (-(-name // 8) * 8 if version == 1 else name) + 4 * (values + (values % 2 if version == 1 else 0))
            found.append(kind)
        return found

    def fill(self, kind: int, at: int, form: str) -> float:
        size_at = at if kind == OLD_FILL else None
        if kind == FILL:
            version, flags = self.raw(at, 2)
            if version == 3:
                size_at = at + 2 if flags & 0x20 else None
            elif self.raw(at + 3, 1)[0]:
                size_at = at + 4
        size = self.number(size_at, 4) if size_at else 0
        return np.frombuffer(self.raw(size_at + 4, size), form, 1)[0] if size == np.dtype(form).itemsize else np.zeros(1, form)[0]

    def dataset(self, header: int) -> Variable | None:
        """A dataset of numbers, or nothing for another object."""
        shape = form = layout = None
        filters, fills, messages = [], [], self.messages(header)
        for kind, at, _ in messages:
            if kind == -1:
                raise ValueError("HDF5 dataset with a committed type or shared message")
            if kind == DATASPACE:
                shape = self.space(at)
            elif kind == DATATYPE:
                form = self.kind(at)
            elif kind == FILTERS:
                filters = self.filters(at)
            elif kind in (OLD_FILL, FILL):
                fills.append((kind, at))
            elif kind == LAYOUT:
                layout = at
        if shape is None or form is None or form[0] == "S" or layout is None:
            return None
        notes = self.attributes(header, messages)
        references = notes.pop("DIMENSION_LIST", None)
        fill = self.fill(*fills[-1], form) if fills else np.zeros(1, form)[0]
        version, what = self.raw(layout, 2)
        if version not in (3, 4):
            raise ValueError(f"HDF5 layout {version}")
        if what == 2:
            if unknown := [f for f in filters if f not in (DEFLATE, SHUFFLE, FLETCHER32, ZSTANDARD)]:
                raise ValueError(f"HDF5 filter {unknown[0]}")
            read = _Chunks(self, layout, shape, np.dtype(form), filters, fill).read
        elif what in (0, 1):
            place = layout + 4 if what == 0 else self.place(layout + 2)
            read = lambda first=None, last=None: self.block(place, shape, np.dtype(form), fill, first, last)
        else:
            raise ValueError(f"HDF5 layout of class {what}")
        return Variable([None] * len(shape), shape, np.dtype(form), notes, read, references if isinstance(references, list) else None)

    def block(self, place: int | None, shape: list[int], dtype: np.dtype, fill, first: int | None, last: int | None) -> np.ndarray:
        """Rows of contiguous values: only their bytes are read."""
        axis = rows_axis(shape)
        a, b = (0, shape[axis] if shape else 1) if first is None else (min(first, shape[axis]), min(last, shape[axis]))
        part = shape[:axis] + [b - a] + shape[axis + 1 :] if shape else []
        row = math.prod(shape[axis + 1 :]) * dtype.itemsize
        if (b - a) * row > MOST_BYTES:
            raise ValueError("HDF5 dataset too large")
        if place is None:  # never written
            return np.full(part, fill, dtype)
        return np.frombuffer(self.raw(place + a * row, (b - a) * row), dtype, math.prod(part)).reshape(part)


class _Heap:
    """A fractal heap: objects of a group's links or an object's attributes."""

    def __init__(self, file: _File, at: int | None):
        self.file, o, l = file, file.o, file.l
        at = file.expect(at, b"FRHP")
        filtered, largest = file.number(at + 7, 2), file.number(at + 10, 4)
        if filtered:
            raise ValueError("filtered HDF5 heap")
        at += 14 + l + o + l + o + 8 * l
        self.width, self.start, self.direct = file.number(at, 2), file.number(at + 2, l), file.number(at + 2 + l, l)
        bits = file.number(at + 2 + 2 * l, 2)
        self.root, self.rows = file.place(at + 6 + 2 * l), file.number(at + 6 + 2 * l + o, 2)
        self.offset, self.length = -(-bits // 8), _bytes_for(min(self.direct, largest))
        if not (self.width and self.start and self.direct >= self.start and bits <= 64):
            raise ValueError("damaged HDF5 heap")

    def find(self, record: bytes) -> int:
        """The place of an object that a heap id names."""
        if record[0] >> 4:
            raise ValueError("HDF5 heap object of another kind")
        return self._within(self.root, self.rows, int.from_bytes(record[1 : 1 + self.offset], "little"), 0)

    def _within(self, block: int | None, rows: int, wanted: int, before: int) -> int:
        if block is None:
            raise ValueError("damaged HDF5 heap")
        if not rows:
            self.file.expect(block, b"FHDB")
            return block + wanted - before
        entry = self.file.expect(block, b"FHIB") + 5 + self.file.o + self.offset
        for row in range(min(rows, 64)):
            size = self.start << max(0, row - 1)
            for _ in range(self.width):
                if before <= wanted < before + size:
                    below = 0 if size <= self.direct else (size // (self.start * self.width)).bit_length()
                    return self._within(self.file.place(entry), below, wanted, before)
                before, entry = before + size, entry + self.file.o
        raise ValueError("damaged HDF5 heap")


class _Chunks:
    """Values in chunks; only those chunks are read and undone that hold wanted rows."""

    def __init__(self, file: _File, at: int, shape: list[int], dtype: np.dtype, filters: list[int], fill):
        self.file, self.shape, self.dtype, self.filters, self.fill = file, shape, dtype, filters, fill
        version, rank = file.raw(at, 1)[0], len(shape)
        if version == 3:
            n, self.index = file.raw(at + 2, 1)[0], None
            self.at = file.place(at + 3)
            self.dims = [file.number(at + 3 + file.o + 4 * i, 4) for i in range(n - 1)]
        else:
            flags, n, width = file.raw(at + 2, 3)
            self.dims = [file.number(at + 5 + width * i, width) for i in range(n - 1)]
            at += 5 + width * n
            self.index, at = file.raw(at, 1)[0], at + 1
            self.single = None
            if self.index == SINGLE:
                if flags & 2:
                    self.single, at = (file.number(at, file.l), file.number(at + file.l, 4)), at + file.l + 4
            elif self.index == FIXED_ARRAY:
                at += 1
            elif self.index != IMPLICIT:
                raise ValueError(f"HDF5 chunk index {self.index}")
            self.at = file.place(at)
        if n - 1 != rank or not all(self.dims) or math.prod(self.dims) > 1 << 31:
            raise ValueError("damaged HDF5 chunks")
        self.size = math.prod(self.dims) * dtype.itemsize

    def listed(self) -> Iterator[tuple[tuple[int, ...], int | None, int, int]]:
        """(offsets, place, stored size, mask of skipped filters) of each chunk."""
        if self.at is None:
            return
        if self.index is None:
            yield from self._tree(self.at, 0)
            return
        counts = [-(-n // d) for n, d in zip(self.shape, self.dims, strict=True)]
        if math.prod(counts) > self.file.source.size:
            raise ValueError("damaged HDF5 chunks")
        where = [tuple(i * d for i, d in zip(np.unravel_index(k, counts), self.dims, strict=True)) for k in range(math.prod(counts))] if math.prod(counts) else []
        if self.index == SINGLE:
            yield tuple([0] * len(self.dims)), self.at, *(self.single or (self.size, 0))
        elif self.index == IMPLICIT:
            for k, offsets in enumerate(where):
                yield offsets, self.at + k * self.size, self.size, 0
        else:
            for offsets, (place, size, mask) in zip(where, self._array(len(where)), strict=False):
                if place is not None:
                    yield offsets, place, size, mask

    def _tree(self, at: int | None, depth: int) -> Iterator:
        file, rank = self.file, len(self.dims)
        if at is None or depth > 32:
            raise ValueError("damaged HDF5 chunk index")
        file.expect(at, b"TREE")
        level, n, key = file.raw(at + 5, 1)[0], file.number(at + 6, 2), 8 + 8 * (rank + 1)
        first = at + 8 + 2 * file.o
        for i in range(n):
            place = first + i * (key + file.o)
            child = file.place(place + key)
            if level:
                yield from self._tree(child, depth + 1)
            else:
                yield tuple(file.number(place + 8 + 8 * j, 8) for j in range(rank)), child, file.number(place, 4), file.number(place + 4, 4)

    def _array(self, n: int) -> Iterator[tuple[int | None, int, int]]:
        file = self.file
        head = file.expect(self.at, b"FAHD")
        filtered, size, bits = file.raw(head + 5, 3)
        block = file.expect(file.place(head + 8 + file.l), b"FADB")
        at, page = block + 6 + file.o, 1 << min(bits, 62)
        paged, pages = n > page, -(-n // page)
        used = file.raw(at, -(-pages // 8)) if paged else b""
        at += len(used) + 4 if paged else 0
        for k in range(n):
            if paged and not used[k // page // 8] & 0x80 >> k // page % 8:
                yield None, 0, 0
                continue
            place = at + k * size + (k // page * 4 if paged else 0)
            if filtered == 1:
                yield file.place(place), file.number(place + file.o, size - file.o - 4), file.number(place + size - 4, 4)
            else:
                yield file.place(place), self.size, 0

    def undone(self, data: bytes, mask: int) -> bytes:
        for i in reversed(range(len(self.filters))):
            if mask >> i & 1:
                continue
            kind, width = self.filters[i], self.dtype.itemsize
            if kind == DEFLATE:
                undo = zlib.decompressobj()
                data = undo.decompress(data, self.size + 4096)
            elif kind == ZSTANDARD:
                import zstandard

                data = zstandard.ZstdDecompressor().decompress(data, max_output_size=self.size + 4096)
            elif kind == SHUFFLE:
                n = len(data) // width
                data = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.tobytes() + data[n * width :]
            else:
                if int.from_bytes(data[-4:], "little") != fletcher32(data[:-4]):
                    raise ValueError("HDF5 chunk with a wrong checksum")
                data = data[:-4]
        return data

    def read(self, first: int | None = None, last: int | None = None) -> np.ndarray:
        axis = rows_axis(self.shape)
        a, b = (0, self.shape[axis] if self.shape else 1) if first is None else (min(first, self.shape[axis]), min(last, self.shape[axis]))
        part = [b - a if i == axis else n for i, n in enumerate(self.shape)]
        if math.prod(part) * self.dtype.itemsize > MOST_BYTES:
            raise ValueError("HDF5 dataset too large")
        out = np.full(part, self.fill, self.dtype)
        for offsets, place, size, mask in self.listed():
            if place is None or offsets[axis] >= b or offsets[axis] + self.dims[axis] <= a or any(o >= n for o, n in zip(offsets, self.shape, strict=True)):
                continue
            values = np.frombuffer(self.undone(self.file.raw(place, size), mask), self.dtype, math.prod(self.dims)).reshape(self.dims)
            low = [max(o, a) - a if i == axis else o for i, o in enumerate(offsets)]
            skip = [max(o, a) - o if i == axis else 0 for i, o in enumerate(offsets)]
            n = [min(d - s, m - at) for d, s, m, at in zip(self.dims, skip, part, low, strict=True)]
            out[tuple(slice(at, at + k) for at, k in zip(low, n, strict=True))] = values[tuple(slice(s, s + k) for s, k in zip(skip, n, strict=True))]
        return out


def fletcher32(data: bytes) -> int:
    """The format's checksum, of big-endian pairs of bytes."""
    words = np.frombuffer(data[: len(data) // 2 * 2], ">u2").astype(np.uint64)
    a = b = 0
    for at in range(0, len(words), 1 << 16):
        some = words[at : at + (1 << 16)]
        sums = np.cumsum(some) + np.uint64(a)
        b = (b + int(sums.sum())) % 65535
        a = int(sums[-1]) % 65535
    if len(data) % 2:
        a = (a + (data[-1] << 8)) % 65535
        b = (b + a) % 65535
    # the sums are kept from 1 to 65535, as ones' complement has two zeros
    ones = lambda x, any_: 65535 if x == 0 and any_ else x
    some = any(data)
    return ones(b, some) << 16 | ones(a, some)


def variables(source: Source) -> dict[str, Variable | Unreadable]:
    """Datasets of the root group; all that is wrong with the file comes up as ValueError."""
    if source.size < 8 or source.read(0, 8) != SIGNATURE:
        raise ValueError("not an HDF5 file")
    try:
        file = _File(source)
        found: dict[str, Variable] = {}
        out: dict[str, Variable | Unreadable] = {}
        names: dict[int, str] = {}
        for name, header in file.members(file.root).items():
            try:
                one = file.dataset(header)
            except Exception as e:
                out[name] = Unreadable(str(e) or type(e).__name__)
                continue
            names[header] = name
            if one is not None:
                found[name] = one
    except Exception as e:
        raise ValueError(str(e) if "HDF5" in str(e) else f"damaged HDF5 file: {e or type(e).__name__}") from e
    scaled = any(v.notes.get("CLASS") == SCALE for v in found.values())
    lengths: dict[int, list[str]] = {}
    for name, v in found.items():
        if len(v.shape) == 1:
            lengths.setdefault(v.shape[0], []).append(name)
    for name, v in found.items():
        if v.references and len(v.references) == len(v.shape):
            v.dims = [names.get(r) for r in v.references]
        elif len(v.shape) == 1 and (not scaled or v.notes.get("CLASS") == SCALE):
            v.dims = [name]
        elif not scaled and len(set(v.shape)) == len(v.shape):
            v.dims = [lengths[n][0] if len(lengths.get(n, ())) == 1 else None for n in v.shape]
        v.notes = {k: x for k, x in v.notes.items() if k not in ("CLASS", "NAME", "REFERENCE_LIST") and not isinstance(x, list)}
        out[name] = v
    return out


# writing --------------------------------------------------------------------------------------------
UNDEFINED = b"\xff" * 8
LEAF, INNER = 4, 16  # half of the entries of a group's nodes and of the trees' nodes


def le(n: int, size: int = 8) -> bytes:
    return n.to_bytes(size, "little")


def padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def type_of(dtype: np.dtype) -> bytes:
    """Type message of little-endian floating point numbers or signed integers."""
    size = dtype.itemsize
    if dtype.kind == "f":
        mantissa, exponent, bias = (52, 11, 1023) if size == 8 else (23, 8, 127)
        return bytes([0x11, 0x20, 8 * size - 1, 0]) + le(size, 4) + le(0, 2) + le(8 * size, 2) + bytes([mantissa, exponent, 0, mantissa]) + le(bias, 4)
    return bytes([0x10, 0x08, 0, 0]) + le(size, 4) + le(0, 2) + le(8 * size, 2)


def space_of(shape: tuple[int, ...]) -> bytes:
    return bytes([1, len(shape), 0, 0]) + bytes(4) + b"".join(le(n) for n in shape)


REFERENCE = bytes([0x17, 0, 0, 0]) + le(8, 4)
REFERENCES = bytes([0x19, 0, 0, 0]) + le(16, 4) + REFERENCE


def attribute_of(name: str, value) -> bytes:
    """Attribute message of a text, a number or (type, shape, bytes)."""
    if isinstance(value, str):
        raw = value.encode() + b"\0"
        kind, space, data = bytes([0x13, 0, 0, 0]) + le(len(raw), 4), space_of(()), raw
    elif isinstance(value, tuple):
        kind, space, data = value[0], space_of(value[1]), value[2]
    else:
        value = np.asarray(value)
        kind, space, data = type_of(value.dtype), space_of((1,)), value.tobytes()
    title = name.encode() + b"\0"
    return bytes([1, 0]) + le(len(title), 2) + le(len(kind), 2) + le(len(space), 2) + padded(title) + padded(kind) + padded(space) + data


def header_of(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(le(kind, 2) + le(len(padded(b)), 2) + bytes(4) + padded(b) for kind, b in messages)
    return bytes([1, 0]) + le(len(messages), 2) + le(1, 4) + le(len(body), 4) + bytes(4) + body


class _Out:
    """A file that grows at its end."""

    def __init__(self, at: int):
        self.parts, self.at = [], at

    def add(self, data: bytes) -> int:
        place = self.at
        data = padded(data)
        self.parts.append(data)
        self.at += len(data)
        return place


def _tree(out: _Out, kind: int, entries: list[tuple[bytes, int]], last: bytes) -> int:
    """A B-tree of version 1 over (key, child) in order: nodes of at most 2 * INNER children, level upon level."""
    level = 0
    while True:
        step = 2 * INNER
        groups = [entries[i : i + step] for i in range(0, len(entries), step)]
        size = 24 + step * (len(last) + 8) + len(last)
        places = [out.at + i * -(-size // 8) * 8 for i in range(len(groups))]
        above = []
        for i, group in enumerate(groups):
            end = groups[i + 1][0][0] if i + 1 < len(groups) else last
            node = b"TREE" + bytes([kind, level]) + le(len(group), 2) + (le(places[i - 1]) if i else UNDEFINED) + (le(places[i + 1]) if i + 1 < len(groups) else UNDEFINED)
            node += b"".join(key + le(child) for key, child in group) + end
            above.append((group[0][0], out.add(node + bytes(size - len(node)))))
        if len(above) == 1:
            return above[0][1]
        entries, level = above, level + 1


def _chunked(out: _Out, values: np.ndarray, chunk: tuple[int, ...], level: int) -> tuple[int, list[tuple[int, bytes]]]:
    """Stores shuffled and deflated chunks; their index, and the layout and filter messages."""
    entries = []
    for corner in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunk, strict=True))):
        offsets = [i * c for i, c in zip(corner, chunk, strict=True)]
        part = values[tuple(slice(o, o + c) for o, c in zip(offsets, chunk, strict=True))]
        whole = np.zeros(chunk, values.dtype)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        raw = np.frombuffer(whole.tobytes(), np.uint8).reshape(-1, values.itemsize).T.tobytes()
        data = zlib.compress(raw, level)
        place = out.add(data)
        entries.append((le(len(data), 4) + le(0, 4) + b"".join(le(o) for o in offsets) + le(0), place))
    end = le(0, 4) + le(0, 4) + b"".join(le(-(-n // c) * c) for n, c in zip(values.shape, chunk, strict=True)) + le(values.itemsize)
    tree = _tree(out, 1, entries, end)
    layout = bytes([3, 2, values.ndim + 1]) + le(tree) + b"".join(le(c, 4) for c in chunk) + le(values.itemsize, 4)
    one = lambda kind, value: le(kind, 2) + le(0, 2) + le(1, 2) + le(1, 2) + le(value, 4) + bytes(4)
    return tree, [(FILTERS, bytes([1, 2]) + bytes(6) + one(SHUFFLE, values.itemsize) + one(DEFLATE, level)), (LAYOUT, layout)]


def encode(dims: dict[str, int], fields: list[tuple[str, list[str], np.ndarray, str, dict]], chunk: int | None = None, level: int = 4) -> bytes:
    """A file of ``fields`` (name, dimensions, values, 'float' or 'double', attributes: texts or numbers).

    With ``chunk`` fields of two and more dimensions are compressed in chunks of that many a side.
    """
    out = _Out(96)
    types = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}
    named = {f[0] for f in fields}
    # dimensions without a variable of their own are datasets too, marked as such
    every = [(d, [d], np.zeros(n), "float", {}) for d, n in dims.items() if d not in named] + sorted(fields, key=lambda f: f[0] not in dims)
    place: dict[str, int] = {}
    for name, ids, values, kind, notes in every:
        values = np.ascontiguousarray(values, dtype=types[kind])
        messages = [(DATASPACE, space_of(values.shape)), (DATATYPE, type_of(values.dtype))]
        missing = np.asarray(notes.get("_FillValue", np.nan), values.dtype).tobytes()
        messages.append((FILL, bytes([2, 2, 2, 1]) + le(len(missing), 4) + missing))
        if chunk and values.ndim > 1 and values.size:
            messages += _chunked(out, values, tuple(min(chunk, n) for n in values.shape), level)[1]
        else:
            data = values.tobytes()
            messages.append((LAYOUT, bytes([3, 1]) + (le(out.add(data)) if data else UNDEFINED) + le(len(data))))
        # a variable's type is that of its fill value, other numbers are doubles
        notes = {k: x if isinstance(x, str) else values.dtype.type(x) if k in ("_FillValue", "missing_value") else np.float64(x) for k, x in notes.items()}
        if name in dims:
            notes |= {"CLASS": SCALE, "NAME": name if name in named else f"{NO_VARIABLE} {dims[name]:9d}", "_Netcdf4Dimid": np.int32(list(dims).index(name))}
        else:
            heap = b"".join(le(i + 1, 2) + le(1, 2) + bytes(4) + le(8) + le(place[d]) for i, d in enumerate(ids))
            size = max(4096, 16 + len(heap) + 16)
            heap += bytes(8) + le(size - 16 - len(heap))  # object 0: what is free
            at = out.add(b"GCOL" + bytes([1, 0, 0, 0]) + le(size) + heap + bytes(size - 16 - len(heap)))
            notes["DIMENSION_LIST"] = (REFERENCES, (len(ids),), b"".join(le(1, 4) + le(at) + le(i + 1, 4) for i in range(len(ids))))
        place[name] = out.add(header_of(messages + [(ATTRIBUTE, attribute_of(k, x)) for k, x in notes.items()]))
    # the root group: names in a heap, nodes of entries in the order of their names, a tree over them
    names, offsets = bytes(8), {}
    order = sorted(place, key=str.encode)
    for name in order:
        offsets[name] = len(names)
        names += padded(name.encode() + b"\0")
    free = len(names)
    names += le(1) + le(24) + bytes(8)  # a free block, the last of its list
    heap = out.add(b"HEAP" + bytes(4) + le(len(names)) + le(free) + le(out.at + 32) + names)
    nodes = []
    for i in range(0, len(order), 2 * LEAF):
        some = order[i : i + 2 * LEAF]
        entries = b"".join(le(offsets[n]) + le(place[n]) + bytes(24) for n in some)
        nodes.append((some[-1], out.add(b"SNOD" + bytes([1, 0]) + le(len(some), 2) + entries + bytes(40 * (2 * LEAF - len(some))))))
    keys = [0] + [offsets[last] for last, _ in nodes]
    tree = _tree(out, 0, [(le(keys[i]), at) for i, (_, at) in enumerate(nodes)], le(keys[-1])) if nodes else out.add(b"TREE" + bytes([0, 0, 0, 0]) + UNDEFINED * 2 + bytes(8 + 2 * INNER * 16))
    root = out.add(header_of([(SYMBOL_TABLE, le(tree) + le(heap))]))
    entry = le(0) + le(root) + le(1, 4) + bytes(4) + le(tree) + le(heap)
    block = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + le(LEAF, 2) + le(INNER, 2) + bytes(4) + le(0) + UNDEFINED + le(out.at) + UNDEFINED + entry
    return block + b"".join(out.parts)
