"""SentencePiece encodings sampled without replacement, and their decoding.

A text's segmentations form a lattice; a segmentation's weight is the product of its pieces'
probabilities to the power ``alpha``. The k segmentations are the k largest of Gumbel-perturbed
log-probabilities over *all* segmentations, found by a perturbed A* search: a node is a set of
segmentations with a known log-mass; its priority is the perturbed value of its best member. Taking a
node off the queue draws that member and splits what is left of the set by the first word where the
others differ from it; their values are Gumbel variables truncated at the node's own. The search ends
after k members; the next priority in the queue is the threshold kappa, and a member of log-probability
phi has been included with probability 1 - exp(-exp(phi - kappa)).

Pieces never reach across the start of a word (a run of spaces and what follows) or a line end, so the
lattice falls apart into words: lattices are built once per distinct word of a group of texts, in
numpy, with nodes that words of the same end share, and the words of all texts of a group are sampled together. A segmentation of a text is an array
of numbers of its words' segmentations. Characters without a piece are their UTF-8 bytes.

Probabilities: a unigram model's scores; a BPE model has only ranks, which count as Zipf's law. All
random numbers are hashes of the row's key, so a row's samples don't depend on its neighbours.
Decoding gives back the text exactly.

Defined results: null or empty text has the one empty segmentation; texts with fewer than k
segmentations (the lattices' paths are counted) have fewer rows, with kappa -inf and probability 1;
rows with the same key and text get the same samples; a null key counts as -1; an empty table gives
an empty result; other columns aren't read.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import BASE, U64, as_bytes, mix, run_hashes, tidy

SPACE, LITERAL = "▁", "\ud800"  # the model's space; what stands for that very character in a text
LEAST = 1e-17  # mass of a set whose mass is lost to rounding
GROUP = 2 << 20  # bytes of text that share lattices
REACH = 64  # words in which a split first looks for the sets that can come up
SAMPLED = "doc_id long, rank int, n_pieces int, log_prob double, perturbed double, inclusion double, ids binary"


class Vocabulary:
    """Pieces, log-probabilities and hashes of a SentencePiece model."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, self.bytes, self.raw = [], {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                if not re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", piece):
                    plain.append((i, piece, sp.get_score(i)))
        self.byte_ids = np.array([self.bytes.get(b, -1) for b in range(128)], dtype=np.int32)
        ranks = all(s == int(s) for _, _, s in plain)
        logs = np.array([-math.log(2.7 - s) if ranks else s for _, _, s in plain])  # Zipf-Mandelbrot over merge ranks
        logs -= np.log(np.exp(logs).sum())
        self.longest = max((len(p) for _, p, _ in plain), default=1)
        prefixes = [self._prefixes(p) for _, p, _ in plain]
        hashes = np.array([x[-1] for x in prefixes], dtype=U64)
        self.begins = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.begins[slot_of(np.array(sorted({h for x in prefixes for h in x}), dtype=U64))] = True
        order = np.argsort(slot_of(hashes), kind="stable")
        self.hashes, self.ids, self.logs = hashes[order], np.array([i for i, _, _ in plain], dtype=np.int32)[order], alpha * logs[order]
        # the first piece of each slot; those of a slot follow one another
        slots = slot_of(self.hashes)
        self.slot = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(slots).max(initial=1))
        self.fallback = alpha * (float(logs.min()) - 1)
        lengths = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.flat, self.length, self.offset = np.frombuffer(b"".join(self.raw), np.uint8), lengths, np.cumsum(lengths) - lengths

    @staticmethod
    def _prefixes(piece: str) -> list[int]:
        """Hashes of the piece's beginnings, the piece itself last."""
        h, out = 0, []
        for code in char_codes(np.array([ord(c) for c in piece], dtype=U64)).tolist():
            h = (h * BASE + code) % 2**64
            out.append(h)
        return out

    def find(self, h: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, or -1."""
        i = self.slot[slots]
        todo = np.flatnonzero(i >= 0)
        at, wanted = i[todo], h[todo]
        i[:] = -1
        for _ in range(self.crowd):
            has = self.hashes[at] == wanted
            i[todo[has]] = at[has]
            more = ~has & (at + 1 < len(self.hashes))
            todo, at, wanted = todo[more], at[more] + 1, wanted[more]
            if not len(todo):
                break
        return i

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts that runs of ids were made from, one after the other, and where each ends."""
        length, offset = self.length[ids], self.offset[ids]
        first = np.concatenate(([0], ends[:-1]))
        first = first[first < ends]
        length[first] -= 1  # the space that encoding puts in front
        offset[first] += 1
        upto = np.cumsum(length)
        index = np.repeat((offset - (upto - length)).astype(np.int32), length)
        index += np.arange(len(index), dtype=np.int32)
        return self.flat[index], np.concatenate(([0], upto))[ends]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that the ids were made from."""
        return self.decode_all(ids, np.array([len(ids)]))[0].tobytes()


SLOT_BITS = 21


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes * U64(0x9E3779B97F4A7C15) >> U64(64 - SLOT_BITS)).astype(np.int64)


def char_codes(chars: np.ndarray) -> np.ndarray:
    return mix(chars + U64(1))


class Lattices:
    """The lattices of distinct words: nodes are what is left of a word, edges are pieces.

    Words with the same end share its nodes.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        v = vocabulary
        after, cuts = self._nodes(words)
        n = len(after)
        codes = char_codes(self.chars.astype(U64))
        at, h, found = np.arange(n, dtype=np.int32), np.zeros(n, dtype=U64), []
        upto, counts = at, np.zeros(n, dtype=np.int32)
        for m in range(1, v.longest + 1):
            h = h * U64(BASE) + codes[upto]
            slots = slot_of(h)
            if m == 1:
                piece = v.find(h, slots)
                piece[piece < 0] = len(v.hashes)  # a character without a piece
            else:
                going = v.begins[slots]  # a piece may begin so
                at, h, upto = at[going], h[going], upto[going]
                piece = v.find(h, slots[going])
            upto = after[upto]
            has = piece >= 0
            found.append((at[has], piece[has], upto[has]))
            counts[found[-1][0]] += 1
            going = upto >= 0
            at, h, upto = at[going], h[going], upto[going]
        self.begin = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        piece, self.next = (np.empty(self.begin[-1], dtype=np.int32) for _ in range(2))
        free = self.begin[:-1].copy()
        for own, i, to in reversed(found):  # the longest piece of a node comes first
            e = free[own]
            free[own] = e + 1
            piece[e], self.next[e] = i, to
        del found
        self.ids, total = np.append(v.ids, np.int32(-1))[piece], np.append(v.logs, v.fallback)[piece]
        plain = np.flatnonzero(self.ids < 0)  # characters without a piece: those of one byte are that byte's piece, the others wait for _ids
        plain = plain[self.char(plain) < 128]
        self.ids[plain] = v.byte_ids[self.char(plain)]
        # log-mass and number of paths from each node to its word's end, from the last characters backwards
        beta, self.paths = np.zeros(n + 1), np.ones(n + 1)  # the last one stands for the end
        with np.errstate(over="ignore"):
            for a, b in itertools.pairwise(cuts):
                part = slice(self.begin[a], self.begin[b])
                offsets, to = self.begin[a:b] - self.begin[a], self.next[part]
                total[part] += beta[to]
                beta[a:b] = np.logaddexp.reduceat(total[part], offsets)
                self.paths[a:b] = np.add.reduceat(self.paths[to], offsets)
        total -= np.repeat(beta[:-1], counts)
        self.log_p = total  # of each edge, given its node
        self.cumulative = np.exp(self.log_p)
        np.cumsum(self.cumulative, out=self.cumulative)
        self.cumulative -= np.repeat(np.concatenate(([0.0], self.cumulative[self.begin[1:-1] - 1])), counts)
        self.cumulative[self.begin[1:] - 1] = 2.0  # a node's last edge takes what is left
        # the words' segmentations drawn so far: their edges, by number
        self.edges, self.starts, self.counts, self.weights, self.size = [], [], [], [], 0
        self.edge_total, self.blocks = 0, []

    def _nodes(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Makes the nodes; the node after each one's first character (-1: the word's end), and where those of each length begin.

        They are numbered by what is left of their words, so that each step of the sums is a slice.
        """
        lengths = np.array([len(w) for w in words])
        joined = "".join(words).replace(SPACE, LITERAL).replace(" ", SPACE)
        chars, ends = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths)
        self.first = np.empty(len(words), dtype=np.int32)
        of, rest, left, cuts, firsts, afters = np.arange(len(words)), np.full(len(words), -1), 0, [0], [], []
        while len(of) > 1:
            left += 1
            distinct, rest = np.unique((rest + 1) << 21 | chars[ends[of] - left], return_inverse=True)
            rest += cuts[-1]
            cuts.append(cuts[-1] + len(distinct))
            firsts.append(distinct & (1 << 21) - 1)
            afters.append((distinct >> 21) - 1)
            more = lengths[of] > left
            self.first[of[~more]] = rest[~more]
            of, rest = of[more], rest[more]
        if len(of):  # the longest word's beginning has nodes of its own
            i, start = int(of[0]), cuts[-1]
            alone = int(lengths[i]) - left
            cuts += range(start + 1, start + alone + 1)
            firsts.append(chars[ends[i] - lengths[i] : ends[i] - left][::-1])
            afters.append(np.concatenate((rest, np.arange(start, start + alone - 1))))
            self.first[i] = start + alone - 1
        self.chars = np.concatenate(firsts).astype(np.uint32)
        return np.concatenate(afters).astype(np.int32), cuts

    def char(self, edges: np.ndarray) -> np.ndarray:
        """The first characters of edges."""
        return self.chars[np.searchsorted(self.begin, edges.astype(np.int32), side="right") - 1]

    def keep(self, edges: np.ndarray, counts: np.ndarray) -> int:
        """Adds segmentations (edges one after the other); the first one's number."""
        offsets = np.cumsum(counts) - counts
        self.blocks.append((self.size, self.edge_total))
        self.edges.append(edges.astype(np.int32, copy=False))
        self.starts.append(offsets + self.edge_total)
        self.counts.append(counts)
        self.weights.append(np.add.reduceat(self.log_p[edges], offsets) if len(counts) else np.zeros(0))
        self.edge_total += len(edges)
        self.size += len(counts)
        return self.size - len(counts)

    def path(self, number: int) -> tuple[int, ...]:
        """The edges of a segmentation."""
        block = bisect.bisect(self.blocks, (number, self.edge_total)) - 1
        size, edge_total = self.blocks[block]
        start = int(self.starts[block][number - size]) - edge_total
        return tuple(self.edges[block][start : start + int(self.counts[block][number - size])].tolist())

    def sample(self, words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each word: edges in order and their number; ``key``: random words."""
        active, at, picked, owner = np.arange(len(words)), self.first[words], [], []
        counts = np.zeros(len(words), dtype=np.int64)
        for step in itertools.count():
            if not len(active):
                break
            u = (_mixed(key + U64(step * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64)
            u /= 2**53
            e = self.begin[at]
            miss = np.flatnonzero(u >= self.cumulative[e])
            while len(miss):
                e[miss] += 1
                miss = miss[u[miss] >= self.cumulative[e[miss]]]
            picked.append(e)
            owner.append(active)
            counts[active] += 1
            at = self.next[e]
            more = np.flatnonzero(at >= 0)
            at, active, key = at[more], active[more], key[more]
        offsets = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), dtype=np.int32)
        for step, (e, o) in enumerate(zip(picked, owner, strict=True)):
            edges[offsets[o] + step] = e
        return edges, counts

    def sample_other(self, word: int, taken: list[tuple[int, ...]], seed: int) -> tuple[int, ...]:
        """A segmentation of one word, given that it is none of ``taken``."""
        node, path, mass = int(self.first[word]), [], 0.0
        alike = [(t, math.exp(sum(self.log_p[list(t)].tolist()))) for t in taken]  # those that begin with the path
        while True:
            a, b = int(self.begin[node]), int(self.begin[node + 1])
            nexts, weights = self.next[a:b].tolist(), [math.exp(mass + x) for x in self.log_p[a:b].tolist()]
            there = [0] * len(weights)
            for t, w in alike:
                weights[t[len(path)] - a] -= w
                there[t[len(path)] - a] += 1
            # by paths, as rounding may hide what is left of an edge
            weights = [max(w, LEAST * math.exp(mass)) if self.paths[to] > gone else 0.0 for w, to, gone in zip(weights, nexts, there, strict=True)]
            seed = (seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64
            u, e = ((seed ^ seed >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 11) / 2**53 * sum(weights), -1
            for i, w in enumerate(weights):
                if w > 0:
                    e = i
                    u -= w
                    if u < 0:
                        break
            alike = [(t, w) for t, w in alike if t[len(path)] == a + e]
            path.append(a + e)
            mass, node = mass + float(self.log_p[a + e]), nexts[e]
            if node < 0:
                return tuple(path)


def _uniform(seeds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each seed as many uniform numbers as its length says."""
    starts = np.cumsum(lengths) - lengths
    x = _hashes(mix(seeds), lengths, 0xD1B54A32D192ED03)
    x >>= U64(11)
    u = x.astype(np.float64)
    u += 0.5
    u /= 2**53
    return np.minimum(u, 1 - 2**-53, out=u)  # the sum may have been rounded up


def _hashes(seeds: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """``mix`` of seed, seed + step, seed + 2 * step, ... for each seed, as many as its length says."""
    starts = (np.cumsum(lengths) - lengths).astype(U64)
    x = np.arange(int(lengths.sum()), dtype=U64)
    x *= U64(step)
    x += np.repeat(seeds - starts * U64(step), lengths)
    return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    y = x >> U64(33)
    x ^= y
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= np.right_shift(x, U64(33), out=y)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= np.right_shift(x, U64(33), out=y)
    return x


def words_of(texts: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of a group of texts, and each text's words by number.

    A word is a run of spaces and what follows up to the next space or line end; a line end is a word,
    and so are spaces before one. Every text begins with a space more.
    """
    data = b"".join(b" " + t for t in texts if t)
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return [], [np.zeros(0, np.int64)] * len(texts)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    ends = np.cumsum(sizes)
    line, space = buf == 10, buf == 32
    begins = line | space
    begins[1:] &= line[1:] | ~space[:-1]
    begins[1:] |= line[:-1]
    begins[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(begins).astype(np.int32)
    lengths = np.diff(starts, append=np.int32(len(buf)))
    hashes, blocks = run_hashes(buf, starts, lengths)
    _, example, number = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(example)  # as they come up, frequent words first: their lattices are near one another
    number, example = np.argsort(order)[number], example[order]
    first = example[number]
    same = (lengths[first] == lengths).all()  # the same bytes, not only the same hash
    for at, values in blocks:
        if same:
            place = np.zeros(len(starts), dtype=np.int32)
            place[at] = np.arange(len(at), dtype=np.int32)
            same = (values[place[first[at]]] == values).all()
    if same:
        byte_by_byte = data.decode("latin-1")
        words = [byte_by_byte[a : a + n] for a, n in zip(starts[example].tolist(), lengths[example].tolist(), strict=True)]
        odd = np.searchsorted(starts, np.flatnonzero(buf > 127), side="right") - 1
        for i in np.unique(number[odd]).tolist():
            words[i] = words[i].encode("latin-1").decode("utf-8", "surrogateescape")
    else:
        by_bytes: dict[bytes, int] = {}
        number = np.array([by_bytes.setdefault(data[a : a + n], len(by_bytes)) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        words = [w.decode("utf-8", "surrogateescape") for w in by_bytes]
    return words, np.split(number, np.searchsorted(starts, ends[:-1]))


class _Search:
    """The perturbed A* search of all texts of a group, one member of each at a time."""

    def __init__(self, words: list[np.ndarray], seeds: list[int], k: int, lattices: Lattices):
        self.words, self.k, self.lattices = words, k, lattices
        self.seeds = np.array(seeds, dtype=U64)
        self.heaps: list[list] = [[] for _ in words]
        self.found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in words]
        self.many = lattices.paths[lattices.first]

    def draw(self, docs: list[int], starts: list[int], turn: int) -> list[np.ndarray]:
        """Numbers of new segmentations of the words of each text from ``start`` on."""
        lengths = np.array([len(self.words[d]) - a for d, a in zip(docs, starts, strict=True)])
        parts = np.concatenate([self.words[d][a:] for d, a in zip(docs, starts, strict=True)])
        key = _hashes(self.seeds[docs] + U64(turn * 0xE7037ED1A0B428DB % 2**64), lengths, 0xA0761D6478BD642F)
        first = self.lattices.keep(*self.lattices.sample(parts, key))
        return np.split(np.arange(first, first + len(parts)), np.cumsum(lengths)[:-1])

    def split(self, docs: list[int], starts: list[int], heads: list[float], taken: list[list[int]], turn: int) -> None:
        """Queues what is left of each text's last node: the segmentations that first differ from the found one in a word from ``start`` on.

        A set's mass is at most that of the words before it, and -log(u) at least 1 - u: where these bounds
        keep all further sets below the k + 1 best ones among the first words, the further ones aren't worked out.
        """
        weights = np.concatenate(self.lattices.weights)
        self.lattices.weights = [weights]
        todo, width = list(zip(docs, starts, heads, taken, strict=True)), REACH
        while todo:
            todo = self._queue(todo, width, weights, turn)
            width *= 8

    def _queue(self, todo: list[tuple], width: int, weights: np.ndarray, turn: int) -> list[tuple]:
        """Queues the sets of those texts whose best ones are within ``width`` words of the start; the other texts."""
        docs, starts, heads, taken = zip(*todo, strict=True)
        docs = list(docs)
        whole = np.array([len(self.words[d]) - a for d, a in zip(docs, starts, strict=True)])
        lengths = np.minimum(whole, width)
        first = np.cumsum(lengths) - lengths
        segments = np.concatenate([self.found[d][-1][0][a : a + width] for d, a in zip(docs, starts, strict=True)])
        parts = np.concatenate([self.words[d][a : a + width] for d, a in zip(docs, starts, strict=True)])
        log_p = weights[segments]
        upto = np.cumsum(log_p)
        upto += np.repeat(np.array(heads) - (upto - log_p)[first], lengths)
        before = upto - log_p
        rest, gone = -np.expm1(log_p), np.ones(len(log_p))
        gone[first] += [len(t) for t in taken]
        rest[first] -= [np.exp(weights[t]).sum() for t in taken]
        at = np.flatnonzero(self.many[parts] > gone)  # Gumbel variables at phi, given that they don't exceed the node's own
        owner = np.repeat(np.arange(len(docs)), lengths)[at]
        phi = before[at] + np.log(np.maximum(rest[at], LEAST))
        most = np.array([self.found[d][-1][2] for d in docs])
        uniform, begin = _uniform(self.seeds[docs] + U64(turn * 0x632BE59BD9B4E019 % 2**64), whole), np.cumsum(whole) - whole
        near = np.arange(len(parts)) + np.repeat(begin - first, lengths)
        u = uniform[near[at]]
        uniform[near] = 0.0
        beyond = upto[first + lengths - 1] - np.log1p(-np.maximum.reduceat(uniform, begin)) + 1e-6
        with np.errstate(over="ignore"):
            values = -np.log(np.exp(-most)[owner] - np.log(u) * np.exp(-phi))
        low = np.flatnonzero(~(values > -700))  # where the exponentials leave the range of a double
        values[low] = -np.logaddexp(-most[owner[low]], np.log(-np.log(u[low])) - phi[low])
        edges, further = np.searchsorted(owner, np.arange(len(docs) + 1)), []
        for i, d in enumerate(docs):
            a, b = edges[i], edges[i + 1]
            top = a + np.argpartition(-values[a:b], self.k)[: self.k + 1] if b - a > self.k + 1 else np.arange(a, b)  # no more of these can come up
            if width < whole[i] and (len(top) <= self.k or values[top].min() < beyond[i]):
                further.append(todo[i])
                continue
            for x in top.tolist():
                j = int(at[x] - first[i])
                own = int(segments[at[x]])
                heapq.heappush(self.heaps[d], (-float(values[x]), turn, starts[i] + j, self.found[d][-1][0], float(before[at[x]]), [*taken[i], own] if not j else [own]))
        return further

    def run(self) -> None:
        docs = [d for d in range(len(self.words)) if len(self.words[d])]
        if not docs:
            return
        roots = -np.log(-np.log(_uniform(self.seeds[docs] + U64(0x632BE59BD9B4E019), np.ones(len(docs), dtype=np.int64))))
        for d, segments, root in zip(docs, self.draw(docs, [0] * len(docs), 0), roots.tolist(), strict=True):
            self.found[d].append((segments, 0.0, root))
        self.split(docs, [0] * len(docs), [0.0] * len(docs), [[] for _ in docs], 2)
        for r in range(1, self.k):
            docs = [d for d in docs if self.heaps[d]]
            if not docs:
                return
            nodes = [heapq.heappop(self.heaps[d]) for d in docs]
            starts = [n[2] for n in nodes]
            tails = self.draw(docs, [a + 1 for a in starts], r) if any(a + 1 < len(self.words[d]) for d, a in zip(docs, starts, strict=True)) else [np.zeros(0, np.int64)] * len(docs)
            others = [self.lattices.sample_other(int(self.words[d][n[2]]), [self.lattices.path(i) for i in n[5]], int(self.seeds[d]) + r) for d, n in zip(docs, nodes, strict=True)]
            number = self.lattices.keep(np.array([e for o in others for e in o], dtype=np.int64), np.array([len(o) for o in others]))
            for i, (d, (value, _, j, base, *_), tail) in enumerate(zip(docs, nodes, tails, strict=True)):
                self.found[d].append((np.concatenate((base[:j], [number + i], tail)), 0.0, -value))
            self.split(docs, starts, [n[4] for n in nodes], [n[5] for n in nodes], 2 + r)


def sample_columns(texts: list[bytes], keys: list[int], k: int, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Columns of up to k samples of each text, the largest perturbed value first: text, rank, log_prob, perturbed, inclusion, end of its ids; and all ids."""
    distinct, words = words_of(texts)
    lattices = Lattices(distinct, v) if distinct else None
    search = _Search(words, [int(x) for x in mix(np.array([key % 2**64 for key in keys], dtype=U64) + U64(99))], k, lattices) if lattices else None
    if search:
        search.run()
    text, rank, log_prob, value, kappa, segments, n_words = [], [], [], [], [], [], []
    weights = np.concatenate(lattices.weights) if lattices else np.zeros(0)
    for d in range(len(texts)):
        if not len(words[d]):
            rows, least = [(np.zeros(0, np.int64), 0.0, 0.0)], -math.inf
        else:
            rows, least = search.found[d], -search.heaps[d][0][0] if search.heaps[d] else -math.inf
        for r, (found, _, perturbed) in enumerate(rows):
            text.append(d)
            rank.append(r + 1)
            log_prob.append(float(weights[found].sum()))
            value.append(perturbed)
            kappa.append(least)
            segments.append(found)
            n_words.append(len(found))
    phi = np.array(log_prob)
    inclusion = -np.expm1(-np.exp(np.minimum(700.0, phi - np.array(kappa))))
    ids, ends = _ids(lattices, v, np.concatenate(segments), np.array(n_words)) if lattices else (np.zeros(0, np.int32), np.zeros(len(text), np.int64))
    return np.array(text, dtype=np.int64), np.array(rank, dtype=np.int32), phi, np.array(value), inclusion, ends, ids


def _ids(lattices: Lattices, v: Vocabulary, segments: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segmentations, and where those of each sample end."""
    starts, counts, edges = (np.concatenate(x) for x in (lattices.starts, lattices.counts, lattices.edges))
    lattices.log_p = lattices.cumulative = lattices.starts = lattices.counts = lattices.edges = None  # done with
    count = counts[segments]
    upto = np.cumsum(count)
    index = np.repeat((starts[segments] - (upto - count)).astype(np.int32), count)
    index += np.arange(len(index), dtype=np.int32)
    edges = edges[index]
    ids, ends = lattices.ids[edges], np.concatenate(([0], upto))[np.cumsum(n_words)]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        each, which = np.unique(edges[odd], return_inverse=True)
        raws = []
        for char in map(chr, lattices.char(each).tolist()):
            raws.append([v.bytes[b] for b in (SPACE.encode() if char == LITERAL else char.encode("utf-8", "surrogateescape"))])
        width = np.ones(len(ids), dtype=np.int32)
        width[odd] = np.array([len(r) for r in raws])[which]
        upto = np.cumsum(width, dtype=np.int32)
        ends = np.concatenate(([0], upto))[ends]
        ids = np.repeat(ids, width)
        table = np.full((len(raws), max(map(len, raws))), -1, dtype=np.int32)
        for i, r in enumerate(raws):
            table[i, : len(r)] = r
        for b in range(table.shape[1]):
            has = table[which, b] >= 0
            ids[(upto - width)[odd[has]] + b] = table[which[has], b]
    return ids, ends


def sample_group(texts: list[bytes], keys: list[int], k: int, v: Vocabulary) -> list[list[tuple]]:
    """For each text up to k (log_prob, perturbed, inclusion, ids), the largest perturbed value first."""
    text, _, phi, value, inclusion, ends, ids = sample_columns(texts, keys, k, v)
    out: list[list[tuple]] = [[] for _ in texts]
    for row in zip(text.tolist(), phi.tolist(), value.tolist(), inclusion.tolist(), np.split(ids, ends[:-1]), strict=True):
        out[row[0]].append(row[1:])
    return out


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str, size: int, changed: int, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _open(file: str, alpha: float) -> Vocabulary:
    """The vocabulary of a shipped file, built once in a Python worker."""
    path = SparkFiles.get(file)
    now = os.stat(path)
    return _vocabulary(path, now.st_size, now.st_mtime_ns, alpha)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _encode(file: str, alpha: float, k: int):
    names = [f.split()[0] for f in SAMPLED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _open(file, alpha)
        for batch in batches:
            for part in _slices(batch, 1):
                own, texts = part.column(0).to_pylist(), as_bytes(part.column(1))
                text, rank, phi, value, inclusion, ends, ids = sample_columns(texts, [-1 if x is None else x for x in own], k, v)
                pieces = np.diff(ends, prepend=0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()).take(pa.array(text)), pa.array(rank), pa.array(pieces), pa.array(phi), pa.array(value), pa.array(inclusion), _binary(ids.astype("<i4"), 4 * ends)], names=names)

    return run


def _decode(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _open(file, 1.0)
        for batch in batches:
            for part in _slices(batch, batch.schema.get_field_index("ids")):
                held = [x or b"" for x in part.column("ids").to_pylist()]
                texts = v.decode_all(np.frombuffer(b"".join(held), "<i4"), np.cumsum([len(x) // 4 for x in held]))
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(*texts)], names=[*part.schema.names, "text"])

    return run


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that end where ``column`` passes ``GROUP`` bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        last = min(batch.num_rows, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + GROUP)) + 1)
        yield batch.slice(first, last - first)
        first = last


def _ship(df: DataFrame, model_path: str) -> str:
    """Gives the model file to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(model_path)
    return os.path.basename(model_path)


def sampled_encodings(docs: DataFrame, model_path: str, k: int = 4, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank (1: largest perturbed value), n_pieces, log_prob, perturbed, inclusion, ids (int32, little-endian)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_encode(_ship(docs, model_path), alpha, k)), SAMPLED)


def decoded(encodings: DataFrame, model_path: str) -> DataFrame:
    """The encodings with the text (UTF-8 bytes) of their ids."""
    return encodings.mapInArrow(_decode(_ship(encodings, model_path)), _with_text(encodings.schema))


def sampled_and_decoded(docs: DataFrame, model_path: str, k: int = 4, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decoded`` of ``sampled_encodings``, both in one Python worker, so that a task needs the memory of one."""
    file, rows = _ship(docs, model_path), docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encode, decode = _encode(file, alpha, k), _decode(file)
    return rows.mapInArrow(tidy(lambda batches: decode(encode(batches))), _with_text(StructType.fromDDL(SAMPLED)))


def _with_text(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("text", BinaryType())])
