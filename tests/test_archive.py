"""Containers of all layouts, damaged files, the archive source and the sink of whole files."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from meridian.sources import file_sink, grid_source, hdf5
from meridian.sources import grid_nc as g
from meridian.sources.ranged import Ranged, Source

from .test_grid_nc import hdf5_file, le

GRID = np.random.default_rng(1).normal(size=(37, 53))
FIELDS = [("lat", ["lat"], np.arange(37.0), "double", {"units": "degrees_north"}), ("lon", ["lon"], np.arange(53.0), "double", {}), ("data", ["lat", "lon"], GRID, "double", {"_FillValue": -9.0, "scale_factor": 0.5, "long_name": "ß"})]
DIMS = {"lat": 37, "lon": 53}


# containers -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [None, 1, 7, 16, 100])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_netcdf4_files_come_back(chunk, kind):
    raw = hdf5.encode(DIMS | {"time": 3}, [*((n, d, v, kind, a) for n, d, v, _, a in FIELDS), ("turned", ["lon", "lat"], GRID.T, kind, {}), ("cube", ["time", "lat", "lon"], np.stack([GRID] * 3), kind, {})], chunk)
    got = g.decode(raw)
    assert {n: v[0] for n, v in got.items()} == {"lat": ["lat"], "lon": ["lon"], "time": ["time"], "data": ["lat", "lon"], "turned": ["lon", "lat"], "cube": ["time", "lat", "lon"]}
    want = GRID.astype(np.float32 if kind == "float" else np.float64)
    assert np.array_equal(got["data"][1], want) and np.array_equal(got["turned"][1], want.T) and np.array_equal(got["cube"][1], np.stack([want] * 3))
    assert got["data"][2]["long_name"] == "ß" and got["data"][2]["_FillValue"].dtype == want.dtype and got["data"][2]["scale_factor"].tolist() == [0.5]


def test_square_grids_are_told_apart_by_their_scales():
    """Dimensions come from DIMENSION_LIST, not from their lengths."""
    a = np.arange(9.0).reshape(3, 3)
    fields = [("aaa", ["aaa"], np.zeros(3), "double", {}), ("lat", ["lat"], np.zeros(3), "double", {}), ("lon", ["lon"], np.zeros(3), "double", {}), ("data", ["lon", "lat"], a, "double", {})]
    found = g.variables(Source(hdf5.encode({"aaa": 3, "lat": 3, "lon": 3}, fields)))
    assert found["data"].dims == ["lon", "lat"] and np.array_equal(g.field(found, "data", "lat", "lon"), a.T)


def test_dimensions_without_scales_are_not_guessed():
    plain = {"lat": (np.zeros(2), {}), "lon": (np.zeros(3), {}), "data": (np.zeros((2, 3)), {})}
    assert g.decode(hdf5_file(plain, True))["data"][0] == ["lat", "lon"]
    for data in ({"lat": (np.zeros(3), {}), "lon": (np.zeros(3), {}), "data": (np.zeros((3, 3)), {})}, plain | {"aaa": (np.zeros(2), {})}):
        found = g.variables(Source(hdf5_file(data, True)))
        with pytest.raises(ValueError, match="not a field"):
            g.field(found, "data", "lat", "lon")


def header2(parts, wide=False):
    body = b"".join(bytes([k]) + le(len(b), 2) + b"\0" + b for k, b in parts)
    return b"OHDR" + bytes([2, 1 + wide]) + le(len(body), 4 if wide else 2) + body + bytes(4)


FLOAT = bytes([0x11, 0x20, 0x3F, 0]) + le(8, 4) + le(0, 2) + le(64, 2) + bytes([52, 11, 0, 52]) + le(1023, 4)


def space2(shape):
    return bytes([2, len(shape), 0, 1]) + b"".join(le(n) for n in shape)


def filters2(*kinds):
    return bytes([2, len(kinds)]) + b"".join(le(k, 2) + (le(0, 2) if k >= 256 else b"") + le(0, 2) + le(1, 2) + le(8, 4) for k in kinds)


def chunk_index(kind, values, chunk, filters, at, skip=(), page_bits=10):
    """Stored chunks and their index of version 4, from ``at`` on: (bytes, layout message)."""
    import zstandard

    blocks, entries = b"", []
    counts = [-(-n // c) for n, c in zip(values.shape, chunk, strict=True)]
    for k, corner in enumerate(np.ndindex(*counts)):
        whole = np.zeros(chunk)
        part = values[tuple(slice(i * c, i * c + c) for i, c in zip(corner, chunk, strict=True))]
        whole[tuple(slice(0, n) for n in part.shape)] = part
        data = whole.tobytes()
        for f in filters:
            if f == hdf5.SHUFFLE:
                data = np.frombuffer(data, np.uint8).reshape(-1, 8).T.tobytes()
            elif f == hdf5.DEFLATE:
                data = zlib.compress(data)
            elif f == hdf5.ZSTANDARD:
                data = zstandard.ZstdCompressor().compress(data)
            else:
                data += le(hdf5.fletcher32(data), 4)
        if k in skip:
            entries.append(None)
        else:
            entries.append((at + len(blocks), len(data)))
            blocks += data
    head = bytes([4, 2, 2 if kind == 1 and filters else 0, len(chunk) + 1, 4]) + b"".join(le(c, 4) for c in chunk) + le(8, 4) + bytes([kind])
    if kind == 1:
        return blocks, head + (le(entries[0][1]) + le(0, 4) if filters else b"") + le(entries[0][0])
    if kind == 2:
        return blocks, head + le(at)
    size = 20 if filters else 8
    one = lambda e: b"\xff" * 8 + bytes(size - 8) if e is None else le(e[0]) + (le(e[1]) + le(0, 4) if filters else b"")
    place, page = at + len(blocks), 1 << page_bits
    header = b"FAHD" + bytes([0, bool(filters), size, page_bits]) + le(len(entries)) + le(place + 28) + bytes(4)
    block = b"FADB" + bytes([0, bool(filters)]) + le(place)
    if len(entries) > page:
        pages = [entries[i : i + page] for i in range(0, len(entries), page)]
        bits = bytearray(-(-len(pages) // 8))
        for i in range(len(pages)):
            bits[i // 8] |= 0x80 >> i % 8
        block += bytes(bits) + bytes(4) + b"".join(b"".join(map(one, p)) + bytes(4) for p in pages)
    else:
        block += b"".join(map(one, entries)) + bytes(4)
    return blocks + header + block, head + bytes([page_bits]) + le(place)


def file2(make_root, blocks):
    """Superblock 2, blocks from offset 48 on, and the root group's header."""
    root = make_root(48 + len(blocks))
    return b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + le(0) + b"\xff" * 8 + le(48 + len(blocks) + len(root)) + le(48 + len(blocks)) + bytes(4) + blocks + root


@pytest.mark.parametrize("kind,chunk,filters,page_bits,skip", [
    (1, (37, 53), (), 10, ()), (1, (37, 53), (hdf5.SHUFFLE, hdf5.DEFLATE), 10, ()), (2, (10, 20), (), 10, ()), (3, (10, 20), (), 10, (3,)), (3, (10, 20), (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.FLETCHER32), 10, (0, 11)),
    (3, (4, 6), (hdf5.ZSTANDARD,), 3, (5,)), (3, (4, 6), (), 2, ()),
])
def test_chunk_indexes_and_filters(kind, chunk, filters, page_bits, skip):
    blocks, layout = chunk_index(kind, GRID, chunk, filters, 48, skip, page_bits)
    fill = bytes([3, 0x20 | 2]) + le(8, 4) + np.float64(-1.5).tobytes()
    parts = [(1, space2(GRID.shape)), (3, FLOAT), (5, fill), (8, layout)] + ([(0xB, filters2(*filters))] if filters else [])
    at = 48 + len(blocks)
    blocks += header2(parts)
    raw = file2(lambda _: header2([(0x2, bytes([0, 0]) + b"\xff" * 16), (0x6, bytes([1, 0, 4]) + b"data" + le(at))]), blocks)
    want = GRID.copy()
    across = -(-53 // chunk[1])
    for k in skip:
        i, j = divmod(k, across)
        want[i * chunk[0] : (i + 1) * chunk[0], j * chunk[1] : (j + 1) * chunk[1]] = -1.5
    found = g.variables(Source(raw))["data"]
    assert np.array_equal(found.read(), want) and np.array_equal(found.read(9, 23), want[9:23])


def fractal_heap(objects, at, width=4, start=512, largest=1024):
    """A heap with an indirect root of direct blocks: (bytes, heap ids, address of its header)."""
    sizes = [start] * (2 * width) + [2 * start] * width
    blocks, ids, offset, used = [bytearray()], [], 0, 17  # a direct block starts with 17 bytes of its own
    begins = np.concatenate(([0], np.cumsum(sizes)))
    for o in objects:
        if used + len(o) > sizes[len(blocks) - 1]:
            blocks.append(bytearray())
            offset, used = int(begins[len(blocks) - 1]), 17
        ids.append(bytes([0]) + le(offset + used, 4) + le(len(o), 2))
        blocks[-1] += o
        used += len(o)
    out, places = b"", []
    for i, b in enumerate(blocks):
        places.append(at + len(out))
        body = b"FHDB" + bytes([0]) + le(0) + le(int(begins[i]), 4) + bytes(b)
        out += body + bytes(sizes[i] - len(body))
    rows = 3
    root = at + len(out)
    out += b"FHIB" + bytes([0]) + le(0) + le(0, 4) + b"".join(le(places[i]) if i < len(places) else b"\xff" * 8 for i in range(rows * width)) + bytes(4)
    header = at + len(out)
    out += b"FRHP" + bytes([0]) + le(7, 2) + le(0, 2) + bytes([0]) + le(largest, 4) + le(0) + b"\xff" * 8 + le(0) + b"\xff" * 8 + le(0) * 8 + le(width, 2) + le(start) + le(largest) + le(32, 2) + le(rows, 2) + le(root) + le(rows, 2) + bytes(4)
    return out, ids, header


def btree2(kind, records, at, node=128):
    """A tree of depth 1: leaves of a few records, one root over them."""
    size = len(records[0])
    most = (node - 10) // size
    leaves, between, rest = [], [], list(records)
    while rest:
        take = min(most, max(1, len(rest) - 1)) if len(rest) > most else len(rest)
        leaves.append(rest[:take])
        rest = rest[take:]
        if rest:
            between.append(rest.pop(0))
    out, places = b"", []
    for leaf in leaves:
        places.append(at + len(out))
        body = b"BTLF" + bytes([0, kind]) + b"".join(leaf)
        out += body + bytes(node - len(body))
    root = at + len(out)
    body = b"BTIN" + bytes([0, kind]) + b"".join(between) + b"".join(le(p) + le(len(x), 1) for p, x in zip(places, leaves, strict=True))
    out += body + bytes(max(0, node - len(body)))
    header = at + len(out)
    return out + b"BTHD" + bytes([0, kind]) + le(node, 4) + le(size, 2) + le(1, 2) + bytes([98, 40]) + le(root) + le(len(between), 2) + le(len(records)) + bytes(4), header


def test_links_and_attributes_in_fractal_heaps():
    """A group with many members, and a dataset with many attributes, as newer files keep them."""
    note = lambda k, x: bytes([3, 0]) + le(len(k) + 1, 2) + le(len(FLOAT), 2) + le(4, 2) + b"\0" + k + b"\0" + FLOAT + space2([]) + np.float64(x).tobytes()
    notes = {f"note_{i}": i / 4 for i in range(30)} | {"scale_factor": 2.0, "_FillValue": -7.0}
    heap, ids, heap_at = fractal_heap([note(k.encode(), x) for k, x in notes.items()], 48)
    blocks = heap
    tree, tree_at = btree2(8, [i + bytes(1) + le(n, 4) + le(0, 4) if len(i) == 8 else i + bytes(1) + bytes([0]) + le(n, 4) + le(0, 4) for n, i in enumerate(ids)], 48 + len(blocks), 512)
    blocks += tree
    values = np.array([[1.0, -7, 3]])
    at = {}
    names = {"data": values, "lat": np.zeros(1), "lon": np.zeros(3)} | {f"x{i}": np.full(4 + i, float(i)) for i in range(60)}
    for name, v in names.items():
        place = 48 + len(blocks)
        blocks += v.tobytes()
        at[name] = 48 + len(blocks)
        more = [(0x15, bytes([0, 0]) + le(heap_at) + le(tree_at))] if name == "data" else []
        blocks += header2([(1, space2(v.shape)), (3, FLOAT), (8, bytes([3, 1]) + le(place) + le(v.nbytes)), *more])
    links = [bytes([1, 0, len(n)]) + n.encode() + le(p) for n, p in at.items()]
    heap, ids, heap_at = fractal_heap(links, 48 + len(blocks))
    blocks += heap
    tree, tree_at = btree2(5, [le(0, 4) + i for i in ids], 48 + len(blocks))
    blocks += tree
    raw = file2(lambda _: header2([(0x2, bytes([0, 0]) + le(heap_at) + le(tree_at))]), blocks)
    got = g.decode(raw)
    assert set(got) == set(names) and all(np.array_equal(got[n][1], v) for n, v in names.items())
    assert {k: x[0] for k, x in got["data"][2].items()} == notes
    assert np.array_equal(g.field(g.variables(Source(raw)), "data", "lat", "lon"), [[2, np.nan, 6]], equal_nan=True)


def test_rows_alone_are_fetched():
    big = np.random.default_rng(2).normal(size=(2000, 500))
    for raw in (hdf5.encode({"lat": 2000, "lon": 500}, [("data", ["lat", "lon"], big, "double", {})]), hdf5.encode({"lat": 2000, "lon": 500}, [("data", ["lat", "lon"], big, "double", {})], chunk=100), g.encode({"lat": 2000, "lon": 500}, [("data", ["lat", "lon"], big, "double", {})])):
        source = Ranged(io.BytesIO(raw), len(raw))
        assert np.array_equal(g.field(g.variables(source), "data", "lat", "lon", (150, 160)), big[150:160])
        assert source.fetched < len(raw) / 8


def record_file():
    """A classic file of two variables over the record dimension, one of them padded."""
    name = lambda s: le(len(s), 4)[::-1] + s.encode() + bytes(-len(s) % 4)
    big = lambda n: n.to_bytes(4, "big")
    head = lambda a, b: b"CDF\1" + big(3) + big(10) + big(2) + name("time") + big(0) + name("x") + big(3) + bytes(8) + big(11) + big(2) + name("s") + big(2) + big(0) + big(1) + bytes(8) + big(3) + big(8) + big(a) + name("t") + big(1) + big(0) + bytes(8) + big(6) + big(8) + big(b)
    at = len(head(0, 0))
    rows = b"".join(np.array([3 * i, 3 * i + 1, 3 * i + 2], ">i2").tobytes() + bytes(2) + np.array([i / 2], ">f8").tobytes() for i in range(3))
    return head(at, at + 8) + rows


def test_record_variables_lie_interleaved():
    got = g.decode(record_file())
    assert got["s"][1].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8]] and got["t"][1].tolist() == [0, 0.5, 1] and got["s"][0] == ["time", "x"]


# damage ---------------------------------------------------------------------------------------------
def samples():
    small = [(n, d, v[:5] if v.ndim == 1 else v[:5, :4], k, a) for n, d, v, k, a in FIELDS if n != "lon"] + [("lon", ["lon"], np.arange(4.0), "double", {})]
    return {"classic": g.encode({"lat": 5, "lon": 4}, small), "records": record_file(), "plain4": hdf5.encode({"lat": 5, "lon": 4}, small), "chunked4": hdf5.encode({"lat": 5, "lon": 4}, small, 3), "old": hdf5_file({"data": (np.zeros((2, 3)), {"units": "x"})}, False), "new": hdf5_file({"data": (np.zeros((2, 3)), {"_FillValue": 1.0})}, True)}


@pytest.mark.parametrize("name", ["classic", "records", "plain4", "chunked4", "old", "new"])
def test_damaged_files_only_raise_value_errors(name):
    raw, rng = samples()[name], random.Random(name)

    def tried(data):
        try:
            found = g.variables(Source(bytes(data)))
        except ValueError:
            return
        for v in list(found) + ["none"]:
            try:
                g.field(found, v, "lat", "lon", (0, 2))
                g.field(found, v, "lat", "lon")
            except ValueError:
                pass

    for n in (0, 1, 2, 3, 4, 7, 8, 9, 47, 96, *range(0, len(raw), max(1, len(raw) // 150))):
        tried(raw[:n])
    for _ in range(400):
        data = bytearray(raw)
        for _ in range(rng.choice([1, 1, 2, 8])):
            data[rng.randrange(len(data))] = rng.choice([0, 1, 2, 0x7F, 0x80, 0xFF, rng.randrange(256)])
        tried(data)


def test_any_bad_file_is_survived(spark, tmp_path):
    good = g.encode({"lat": 2, "lon": 2}, [("data", ["lat", "lon"], np.ones((2, 2)), "double", {})])
    bad = {"a": b"", "b": b"CDF", "c": b"CDF\1", "d": b"\x89HDF\r\n\x1a\n", "e": good[:-9], "f": hdf5.encode({"lat": 2}, [("data", ["lat"], np.ones(2), "double", {})]), "h": bytes(range(256))}
    for name, content in {**bad, "19950601": good}.items():
        (tmp_path / name).write_bytes(content)
    assert {r.file for r in g.read_fields(spark, str(tmp_path), ["data"]).collect()} == {"19950601"}
    assert {r.file for r in grid_source.read_archive(spark, str(tmp_path)).collect()} == {"19950601"}
    assert {r.file for r in g.probe(spark, str(tmp_path), "data").where("problem is not null").collect()} == set(bad) - {"a"}  # Spark's binaryFile skips empty files
    with pytest.raises(Exception, match="ends before|not a|damaged|no seek"):
        grid_source.read_archive(spark, str(tmp_path), on_error="fail").collect()


# the archive source ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three years of a few days; files of other days can't be read."""
    path = tmp_path_factory.mktemp("archive")
    for year in (1995, 1996, 1997):
        for day in ("0101", "0228", "0229", "0301", "0601", "0602", "0831"):
            if day != "0229" or year == 1996:
                field = np.arange(12.0).reshape(4, 3) + 100 * year + int(day)
                (path / f"{year}{day}").write_bytes(hdf5.encode({"lat": 4, "lon": 3}, [("data", ["lat", "lon"], field, "double", {})]))
    (path / "19980601").write_bytes(b"not a grid")
    (path / "_hidden").write_bytes(b"x")
    return str(path)


def test_days_of_names():
    assert [grid_source.day_of(n) for n in ("19960301", "0601.nc", "19960229", "19950229", "0229.nc", "readme", "19951301", "199506011")] == [(1996, 60), (None, 152), (1996, None), (None, None), (None, None), (None, None), (None, None), (None, None)]


def reader(folder, *filters):
    r = grid_source.GridReader({"path": f"file://{folder}", "on_error": "fail"})
    rest = list(r.pushFilters(list(filters)))
    return r, rest, [f.name for p in r.partitions() for f in p.files]


def test_conditions_choose_files_and_rows(folder):
    doy, lat = ("doy",), ("lat_idx",)
    assert len(reader(folder)[2]) == 20
    _, rest, files = reader(folder, ds.EqualTo(doy, 152), ds.LessThan(("year",), 1998), ds.GreaterThan(("data",), 3.0))
    assert files == ["19950601", "19960601", "19970601"] and [type(f) for f in rest] == [ds.GreaterThan]
    assert reader(folder, ds.In(doy, (60, 153)), ds.GreaterThanOrEqual(("year",), 1997))[2] == ["19970301", "19970602"]
    assert sorted(reader(folder, ds.StringStartsWith(("file",), "1996022"))[2]) == ["19960228", "19960229"]
    assert reader(folder, ds.IsNotNull(doy), ds.EqualTo(("year",), 1996))[2] == ["19960101", "19960228", "19960301", "19960601", "19960602", "19960831"]
    r = reader(folder, ds.GreaterThan(lat, 0), ds.LessThanOrEqual(lat, 2), ds.IsNotNull(lat))[0]
    assert r.rows == (1, 3)
    assert reader(folder, ds.GreaterThan(lat, 2), ds.LessThan(lat, 1))[2] == []


def test_files_of_other_days_are_not_opened(spark, folder):
    """With ``on_error='fail'`` the broken file of 1998 ends a query that opens it."""
    rows = grid_source.read_archive(spark, folder, on_error="fail")
    got = rows.where("doy = 152 and year < 1998 and lat_idx >= 2 and data > 0").collect()
    assert {(r.year, r.lat_idx, r.lon_idx): r.data for r in got} == {(y, i, j): 3.0 * i + j + 100 * y + 601 for y in (1995, 1996, 1997) for i in (2, 3) for j in range(3)}
    with pytest.raises(Exception, match="19980601"):
        rows.where("doy = 152").collect()
    assert rows.where("doy = 152 and year < 1998 and lat_idx > 7").count() == 0 and rows.where("year = 2020").count() == 0
    assert {r.file for r in rows.where("doy is null and year = 1996").select("file").distinct().collect()} == {"19960229"}


def test_files_are_dealt_by_size(folder):
    r = grid_source.GridReader({"path": f"file://{folder}", "partition_bytes": str(3 * grid_source.FILE_COST)})
    sizes = [len(p.files) for p in r.partitions()]
    assert sum(sizes) == 20 and max(sizes) == 2


# the sink -------------------------------------------------------------------------------------------
def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).repartition(8).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    (tmp_path / "f3").write_bytes(b"before")
    with pytest.raises(Exception, match="lost"):
        g.store_files(rows, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["f3"] and (tmp_path / "f3").read_bytes() == b"before"
    g.store_files(rows.where("id < 33"), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"_SUCCESS", *(f"f{i}" for i in range(33))} and (tmp_path / "f3").read_bytes() == b"3"


def test_attempts_that_do_not_count_leave_nothing(tmp_path, monkeypatch):
    from pyspark.sql import Row

    class Task:
        attempt = 0

        @classmethod
        def get(cls):
            return cls

        @classmethod
        def taskAttemptId(cls):
            cls.attempt += 1
            return cls.attempt

    monkeypatch.setattr(file_sink, "TaskContext", Task)
    w = file_sink._Writer(f"file://{tmp_path}")
    lost, kept = (w.write(iter([Row(name="a", content=c)])) for c in (b"first", b"second"))
    assert [p.name for p in tmp_path.iterdir()] == [w.staging] and lost.files != kept.files
    w.commit([kept, None])
    assert {p.name for p in tmp_path.iterdir()} == {"a", "_SUCCESS"} and (tmp_path / "a").read_bytes() == b"second"
    again = file_sink._Writer(f"file://{tmp_path}")
    again.write(iter([Row(name="b", content=b"x")]))
    again.abort([None])
    assert {p.name for p in tmp_path.iterdir()} == {"a", "_SUCCESS"}
    for name in ("../x", "_x", "", "/x"):
        with pytest.raises(ValueError, match="name"):
            w.write(iter([Row(name=name, content=b"")]))
    two = file_sink._Writer(f"file://{tmp_path}")
    with pytest.raises(ValueError, match="two files"):
        two.commit([two.write(iter([Row(name="c", content=b"1")])), two.write(iter([Row(name="c", content=b"2")]))])
    assert {p.name for p in tmp_path.iterdir()} == {"a", "_SUCCESS"}
