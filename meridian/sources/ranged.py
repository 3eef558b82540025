"""Bytes of a file by range: of one that is in memory, or of one that is read block by block as asked."""

from __future__ import annotations


class Source:
    """``size``, and ``read(at, n)``, which raises ValueError beyond the file's end."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("damaged file: it ends before what it says it holds")
        return self.data[at : at + n]


class Ranged(Source):
    """A seekable file, of which small reads take whole blocks that are kept and large ones their own bytes only; ``fetched`` counts bytes."""

    BLOCK, MOST = 1 << 14, 64

    def __init__(self, file, size: int):
        self.file, self.size, self.blocks, self.fetched = file, size, {}, 0

    def _fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("damaged file: it ends before what it says it holds")
        self.fetched += n
        return data

    def _block(self, i: int) -> bytes:
        if i not in self.blocks:
            while len(self.blocks) >= self.MOST:
                self.blocks.pop(next(iter(self.blocks)))
            at = i * self.BLOCK
            self.blocks[i] = self._fetch(at, min(self.BLOCK, self.size - at))
        return self.blocks[i]

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("damaged file: it ends before what it says it holds")
        if n > self.BLOCK:
            return self._fetch(at, n)
        first, last = at // self.BLOCK, (at + max(n, 1) - 1) // self.BLOCK
        data = b"".join(self._block(i) for i in range(first, last + 1)) if n else b""
        return data[at - first * self.BLOCK : at - first * self.BLOCK + n]
