"""The Merkle manifest, the token files and the vector codes against plain versions."""

import hashlib
import io
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridian.llm import merkle_manifest as mm
from meridian.llm import token_files as tf
from meridian.llm import vector_codes as vc
from meridian.llm.queries import TOKENIZER
from meridian.session import shared_folder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


# Merkle manifest ------------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_tree(leaves):
    """Root, and the siblings (left, right) of each leaf level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, n in enumerate(at):
            run = level[n // 3 * 3 : n // 3 * 3 + 3]
            paths[i].append(("".join(run[: n % 3]), "".join(run[n % 3 + 1 :])))
        level, at = [H(*level[i : i + 3]) for i in range(0, len(level), 3)], [n // 3 for n in at]
    return level[0], paths


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, over = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, over, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + up
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = plain_leaf((*r[:4], r[4].replace("\n", ""))) if hit else leaf
            for left, right in path:
                now = H(left, now, right)
            out.append((r[0], s, leaf, trees[s][0], root, H(*(x for p in path for x in p)), now, now == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(df):
    return sorted((tuple(r) for r in mm.merkle_manifest(df).select(*NAMES).collect()), key=repr)


def test_manifest_of_blocks_upon_blocks(spark):
    """One source of more leaves than a block, others of 1 to 4, names that sort by their bytes, repeated and null ids."""
    sizes = {"hot": mm.BLOCK * 2 + 5, None: 3, "": 1, "a": 4, "ab": 2, "é": 9, "z": mm.BLOCK, "Z": 28, "\U0001f600": 1, "￿": 2}
    rows = [(i * 7919 % 100_003, s, "en" if i % 3 else None, i if i % 5 else None, f"line {i}\nand\n{s}" if i % 4 else ("" if i % 8 else None)) for s, n in sizes.items() for i in range(n)]
    rows += [rows[3]] * 3 + [(None, "hot", None, None, None)] * 2 + [(5, "a", "en", 1, "x\n"), (5, "a", "en", 1, "y\n"), (None, None, "en", 2, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = manifest(df.withColumns({c: F.lit(1) for c in ("tree", "node", "pos", "width", "item", "path", "block", "leaf", "at", "nth", "range")}))
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row(spark):
    row = (7, "s", "en", 1, "x")
    ((doc_id, _, leaf, subroot, root, proof, folded, ok),) = manifest(spark.createDataFrame([row], SCHEMA))
    assert (leaf, subroot, root, folded, ok) == (plain_leaf(row),) * 4 + (True,) and proof == H()


def test_leaves_show_tampering_of_every_column(spark):
    row = (8, "s", "en", 3, "a-b")
    others = [(9, "s", "en", 3, "a-b"), (8, None, "en", 3, "a-b"), (8, "s", "-", 3, "a-b"), (8, "s", "en", None, "a-b"), (8, "s", "en", 3, "a-"), (8, "s", "en3:", None, "a-b")]
    leaves = [r.leaf for r in mm.merkle_manifest(spark.createDataFrame([row, *others], SCHEMA)).collect()]
    assert len(set(leaves)) == len(others) + 1


# token files ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    return tf.Encoder(TOKENIZER, 1)


ODD = ["", " ", "Hello  World", "it's 12:30", "ΑΣ ΟΔΟΣ", "İstanbul ſ ﬁ", "é ́x", "a b c\x85d", "x<|endoftext|>y <|startoftext|>", "日本語 テキスト", "a\x1cb\x0bc", "l'été d'll 've", "Å ̸", "\r\n\t", "x" * 300, "Él ÀÖ×÷ø ñandú,ÿß Straße's 'S 'RE''ll ,'s", "<|ENDOFTEXT|> don't <|x", "a\x00b \x7f é\u0301", "3¾ ½a ª_º µm"]


def same_as_library(encoder, texts):
    ids, lengths = encoder.encode([t.encode() for t in texts])
    at = np.append(0, np.cumsum(lengths))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 1], t


def test_words_encode_as_whole_texts_do(encoder):
    same_as_library(encoder, ODD)
    same_as_library(encoder, [" ".join(ODD), *ODD])
    assert encoder.known


def test_tokenizers_of_another_kind_encode_whole_texts():
    other = tf.Encoder(TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k"), 50256)
    assert not other.known
    ids, lengths = other.encode([t.encode() for t in ODD])
    at = np.append(0, np.cumsum(lengths))
    for t, a, b in zip(ODD, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*other.library.encode(t, add_special_tokens=False).ids, 50256]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sdlvret<|endoftext|>ÅΣ̸́ éÀß×÷Ÿ'SRE0!-")), max_size=40), max_size=5))
def test_any_text_encodes_as_a_whole(encoder, texts):
    same_as_library(encoder, texts)


def test_all_documents_encode_as_whole_texts_do(spark, sf_dir, encoder):
    same_as_library(encoder, [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])


def test_words_are_forgotten_and_found_again(encoder, monkeypatch):
    monkeypatch.setattr(tf, "MOST_RUNS", 3)
    for _ in range(3):
        same_as_library(encoder, ["one two three four five", "two six", ""])


@pytest.mark.parametrize("width", [2, 4])
def test_readers_decompress_the_frames_they_need(width, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 100)
    rng, out = np.random.default_rng(1), io.BytesIO()
    lengths = np.array([1, 99, 1, 250, 0, 30, 1000, 1])
    ids = rng.integers(0, 49_000, lengths.sum()).astype(np.uint32)
    w = tf.Writer(out, width)
    w.add([None, 1, 2, 3], ids[:351], lengths[:4])
    w.add([4, 5, 6, 7], ids[351:], lengths[4:])
    w.close()
    starts = np.cumsum(lengths) - lengths
    r = tf.Reader(io.BytesIO(out.getvalue()))
    assert r.doc_ids == [None, 1, 2, 3, 4, 5, 6, 7] and r.ends[-1] == len(ids)
    assert r.ids(5).tolist() == ids[351:381].tolist() and r.read == 1  # one of fourteen frames
    for i in range(8):
        assert r.ids(i).tolist() == ids[starts[i] : starts[i] + lengths[i]].tolist()
    # the public format: any decoder sees the ids in a row
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, f"<u{width}").tolist() == ids.tolist()


def test_damage_is_noticed(monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 10)
    out = io.BytesIO()
    w = tf.Writer(out, 2)
    w.add(list(range(4)), np.arange(40, dtype=np.uint32), np.full(4, 10))
    w.close()
    raw = bytearray(out.getvalue())
    first = len(zstandard.ZstdCompressor(level=3).compress(np.arange(10, dtype="<u2").tobytes()))
    raw[first + 8] ^= 1  # in the second frame
    r = tf.Reader(io.BytesIO(bytes(raw)))
    assert r.ids(0).tolist() == list(range(10)) and r.ids(2).tolist() == list(range(20, 30))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r.ids(1)
    with pytest.raises(ValueError, match="seek table"):
        tf.Reader(io.BytesIO(bytes(raw[:-1])))


def test_files_hold_all_documents_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "null id"), (5, "again"), (5, "again"), (5, None), (10**12, "w " * 70_000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    folder = shared_folder(spark, "tokens")
    tf.write_tokens(every, folder, TOKENIZER)
    got = sorted(tf.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(TOKENIZER), 0
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in every.collect())
    want = sorted((k, d, tuple(library.encode(t, add_special_tokens=False).ids + [1])) for k, d, t in texts)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    some = tf.read_tokens(spark, folder, [5, 10**12, -3]).collect()
    assert sorted(r.doc_id for r in some) == [5] * (3 + docs.where("doc_id = 5").count()) + [10**12]


def test_lost_attempts_leave_no_trace(spark, tmp_path):
    folder = str(tmp_path / "t")
    tf.write_tokens(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), folder, TOKENIZER)
    (tmp_path / "t" / "data" / "part-000000-999.ids.zst").write_bytes(b"half a file")
    assert sorted(r.doc_id for r in tf.read_tokens(spark, folder).collect()) == [1, 2]


# vector codes ---------------------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds):
    """rows (id, vector, label) to {id: (code, error, label_error)} and the codebooks' digest, in Python integers."""
    kept = sorted((i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    each = len(kept[0][1]) // parts
    cut = lambda v: [v[p * each : (p + 1) * each] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((apart(x, c), i) for i, c in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        held = {}
        for _, v, _ in kept:
            for p, (x, (_, i)) in enumerate(zip(cut(v), near(v), strict=True)):
                held.setdefault((p, i), []).append(x)
        for (p, i), xs in held.items():
            books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = [(i, "".join(f"{j:02x}" for _, j in near(v)), sum(d for d, _ in near(v)), y) for i, v, y in kept]
    total = {}
    for _, _, e, y in coded:
        total[y] = total.get(y, 0) + e
    return {i: (c, e, total[y]) for i, c, e, y in coded}, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 2, 12)], int(y) if y < 4 else None) for i, y in zip(rng.permutation(400), rng.integers(0, 6, 400), strict=True)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(300)]  # a hot label of equal vectors
    rows += [(2000, None, 1), (2001, [1.0] * 11 + [None], 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")] + [0.0] * 11, 2), (-5, [float("-inf")] * 12, 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(6).withColumns({c: F.lit(1) for c in ("of", "rows", "code", "error", "label_error", "slot", "n", "s0")})
    for parts, entries, rounds in ((4, 8, 2), (2, 16, 1), (12, 5, 3)):
        want, digest = plain_codes(rows, parts, entries, rounds)
        got = vc.vector_codes(df, parts=parts, entries=entries, rounds=rounds).collect()
        assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want) and {r.codebooks_sha256 for r in got} == {digest}


def test_ties_go_to_the_lower_entry():
    books = np.array([[[0, 0], [2, 0], [0, 2], [0, 0]]])
    index, distance = vc.nearest(np.array([[1, 0], [1, 1], [0, 0], [-3, 4]]), books)
    assert index.ravel().tolist() == [0, 0, 0, 2] and distance.ravel().tolist() == [1, 2, 0, 13]


def test_odd_vectors(spark):
    assert vc.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    rows = [(1, [0.5] * 4, 1), (1, [0.25] * 4, 1), (None, [0.5] * 4, None), (2, [1.0] * 6, 1), (3, [], None), (4, [-1e-9] * 4, None)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vc.vector_codes(spark.createDataFrame(rows, VECTORS), parts=2, entries=2, rounds=0).collect()), key=repr)
    # the first entries are those of the two rows with id 1, the smaller components first
    assert got == sorted([(1, "0101", 0, 0), (1, "0000", 0, 0), (None, "0101", 0, 4 * 65**2), (2, None, None, 0), (3, None, None, 4 * 65**2), (4, "0000", 4 * 65**2, 4 * 65**2)], key=repr)
    with pytest.raises(ValueError, match="equal parts"):
        vc.vector_codes(spark.createDataFrame([(1, [1.0] * 5, 1)], VECTORS), parts=2)
    with pytest.raises(OverflowError):
        vc.integers(np.array([1e30]), 64)
    with pytest.raises(ValueError, match="hex"):
        vc.vector_codes(spark.createDataFrame(rows, VECTORS), entries=257)


def test_largest_integers_are_exact():
    most = math.isqrt(2**61 // 64)
    x = vc.integers(np.full(64, -most / 256), 64)[None]
    index, distance = vc.nearest(x, np.full((16, 1, 4), most))
    assert index.sum() == 0 and int(distance.sum()) == 64 * (2 * most) ** 2


def test_decoded_vectors_lie_at_the_error_told(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)], 0) for i in range(60)], VECTORS)
    codebooks = vc.trained(vc.kept_vectors(df), 4, 16, 2)
    got = vc.decoded(vc.vector_codes(df, parts=4, entries=16), codebooks).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in got:
        x = [math.floor(256 * v) for v in r.embedding]
        assert sum((a - 256 * b) ** 2 for a, b in zip(x, r.vector, strict=True)) == r.error


def test_batches_of_arrow_lists():
    lists = pa.array([[1.0, 2.0], [], [0.5, -0.25], [3.0]], pa.list_(pa.float32()))
    fits, x = vc.vectors(lists.slice(1), 2)
    assert fits.tolist() == [1] and x.tolist() == [[128, -64]]
