import os

import numpy as np
import pytest

from meridian.sources import grid_nc as g


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("kind,dtype", [("float", np.float32), ("double", np.float64)])
def test_encode_and_decode(version, kind, dtype):
    field = np.arange(12, dtype=dtype).reshape(3, 4)
    data = g.encode({"Lat": 3, "Lon": 4, "Day": 1}, [("x", ["Lat", "Lon"], field, kind, {"units": "degC", "long_name": "a field"}), ("dayofyear", ["Day"], np.array([152.0]), "double", {})], version)
    got = g.decode(data)
    assert got["x"][0] == ["Lat", "Lon"] and np.array_equal(got["x"][1], field) and got["x"][2] == {"units": "degC", "long_name": "a field"}
    assert got["dayofyear"][1].tolist() == [152.0]


def test_foreign_files_are_reported():
    with pytest.raises(ValueError, match="HDF5"):
        g.decode(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(ValueError, match="classic"):
        g.decode(b"PK\x03\x04....")


# HDF5 files, put together by the format's specification ---------------------------------------------
def le(n, size=8):
    return n.to_bytes(size, "little")


def message_parts(values, notes, at):
    """(type, body) of a contiguous dataset's messages."""
    float_type = lambda size: bytes([0x11, 0x20, 0x3F if size == 8 else 0x1F, 0]) + le(size, 4) + (le(0, 2) + le(8 * size, 2) + (bytes([52, 11, 0, 52]) + le(1023, 4) if size == 8 else bytes([23, 8, 0, 23]) + le(127, 4)))
    space = lambda shape: bytes([1, len(shape), 0, 0]) + bytes(4) + b"".join(le(n) for n in shape)
    parts = [(0x1, space(values.shape)), (0x3, float_type(values.itemsize)), (0x8, bytes([3, 1]) + le(at) + le(values.nbytes))]
    for k, x in notes.items():
        name, body = k.encode() + b"\0", np.array([x], "<f8").tobytes() if isinstance(x, float) else x.encode()
        kind = float_type(8) if isinstance(x, float) else bytes([0x13, 0, 0, 0]) + le(len(body), 4)
        pad = lambda b: b + bytes(-len(b) % 8)
        dims = space([1])
        parts.append((0xC, bytes([1, 0]) + le(len(name), 2) + le(len(kind), 2) + le(len(dims), 2) + pad(name) + pad(kind) + pad(dims) + body))
    return parts


def header_v1(parts):
    body = b"".join(le(k, 2) + le(len(b) + -len(b) % 8, 2) + bytes(4) + b + bytes(-len(b) % 8) for k, b in parts)
    return bytes([1, 0]) + le(len(parts), 2) + le(1, 4) + le(len(body), 4) + bytes(4) + body


def header_v2(parts):
    body = b"".join(bytes([k]) + le(len(b), 2) + b"\0" + b for k, b in parts)
    return b"OHDR" + bytes([2, 1]) + le(len(body), 2) + body + bytes(4)


def hdf5_file(data, new):
    """data: {name: (values, attributes)}; old: superblock 0 with a symbol table; new: superblock 2 with links."""
    head, blocks, at = (96 if not new else 48), [], {}
    position = head
    for name, (values, notes) in data.items():
        make = header_v2 if new else header_v1
        size = len(make(message_parts(values, notes, 0)))
        at[name] = position
        blocks.append(make(message_parts(values, notes, position + size)) + values.tobytes())
        position += len(blocks[-1])
    if new:
        links = [(0x2, bytes([0, 0]) + b"\xff" * 16)] + [(0x6, bytes([1, 0, len(n)]) + n.encode() + le(at[n])) for n in data]
        root = header_v2(links)
        return b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + le(0) + b"\xff" * 8 + le(position + len(root)) + le(position) + bytes(4) + b"".join(blocks) + root
    names, offsets = bytes(8), {}
    for n in sorted(data):
        offsets[n] = len(names)
        names += n.encode() + b"\0" + bytes(-(len(n) + 1) % 8)
    heap, tree = position, position + 32 + len(names)
    node = tree + 24 + 8 + 16
    root_at = node + 8 + 40 * len(data)
    entries = b"".join(le(offsets[n]) + le(at[n]) + bytes(24) for n in sorted(data))
    group = b"HEAP" + bytes(4) + le(len(names)) + b"\xff" * 8 + le(heap + 32) + names + b"TREE" + bytes([0, 0]) + le(1, 2) + b"\xff" * 16 + le(0) + le(node) + le(offsets[max(data)]) + b"SNOD" + bytes([1, 0]) + le(len(data), 2) + entries
    root = header_v1([(0x11, le(tree) + le(heap))])
    sb = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + le(4, 2) + le(16, 2) + bytes(4) + le(0) + b"\xff" * 8 + le(root_at + len(root)) + b"\xff" * 8 + le(0) + le(root_at) + bytes(24)
    return sb + b"".join(blocks) + group + root


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("kind", ["<f8", "<f4"])
def test_plain_hdf5_fields(spark, tmp_path, new, kind):
    field = np.array([[1, 2, -99], [4, 5, 6]], kind)
    data = {"data": (field, {"_FillValue": -99.0, "scale_factor": 0.5, "add_offset": 1.0, "units": "degC"}), "lat": (np.array([0, 1], kind), {}), "lon": (np.array([0, 1, 2], kind), {})}
    raw = hdf5_file(data, new)
    dims, values, notes = g.decode(raw)["data"]
    assert dims == ["lat", "lon"] and np.array_equal(values, field) and notes["units"] == "degC" and notes["_FillValue"].tolist() == [-99.0]
    (tmp_path / "19910101").write_bytes(raw)
    got = {(r.lat_idx, r.lon_idx): r.data for r in g.read_fields(spark, str(tmp_path), ["data"], on_error="fail").collect()}
    assert got == {(0, 0): 1.5, (0, 1): 2.0, (0, 2): None, (1, 0): 3.0, (1, 1): 3.5, (1, 2): 4.0}
    with pytest.raises(ValueError, match="HDF5"):
        g.decode(raw[:60])


def test_probe_names_what_is_wrong(spark, tmp_path):
    grid = lambda dims, shape: g.encode(dict(zip(dims, shape, strict=True)), [("data", dims, np.zeros(shape), "double", {"scale_factor": 0.1})])
    files = {"a": grid(["lat", "lon"], (2, 3)), "b": grid(["lon", "lat"], (3, 2)), "c": grid(["lat", "lon"], (3, 2)), "d": grid(["x", "lat", "lon"], (2, 2, 3)), "e": b"junk", "f": g.encode({"lat": 1}, [("other", ["lat"], np.zeros(1), "double", {})])}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file: r for r in g.probe(spark, str(tmp_path), "data", (2, 3)).collect()}
    assert {n for n, r in got.items() if r.problem is None} == {"a", "b"}
    assert got["b"].dims == ["lon", "lat"] and got["b"].shape == [3, 2] and got["a"].attributes == {"scale_factor": "0.1"} and got["a"].type == "float64"
    assert "3 x 2" in got["c"].problem and "missing" in got["f"].problem


def test_marks_scale_and_offset_of_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(g.encode({"lat": 1, "lon": 3}, [("data", ["lat", "lon"], np.array([[-9.0, 4, 7]]), "double", {"_FillValue": -9.0, "missing_value": 7.0, "scale_factor": 2.0, "add_offset": 1.0})]))
    assert [r.data for r in g.read_fields(spark, str(tmp_path), ["data"]).orderBy("lon_idx").collect()] == [None, 9.0, None]


def test_transposed_fields_missing_marks_and_bad_files(spark, tmp_path):
    field = np.array([[1.0, 2, 3], [4, np.nan, 6]])
    plain = g.encode({"lat": 2, "lon": 3}, [("data", ["lat", "lon"], field, "double", {})])
    turned = g.encode({"lat": 2, "lon": 3}, [("data", ["lon", "lat"], field.T, "double", {})])
    for name, content in (("a", plain), ("b", turned), ("c", b"junk")):
        (tmp_path / name).write_bytes(content)
    rows = g.read_fields(spark, str(tmp_path), ["data"]).collect()
    for name in "ab":
        assert {(r.lat_idx, r.lon_idx): r.data for r in rows if r.file == name} == {(i, j): None if np.isnan(field[i, j]) else field[i, j] for i in range(2) for j in range(3)}
    assert not [r for r in rows if r.file == "c"]
    with pytest.raises(Exception, match="not a NetCDF"):
        g.read_fields(spark, str(tmp_path), ["data"], on_error="fail").collect()


def test_write_and_read_back(spark, tmp_path):
    rows = [(152, i, j, 1.0 * i, None if i == j else 2.0 * j) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "doy int, lat_idx int, lon_idx int, clim_mean double, p90 double")
    g.write_fields(df, str(tmp_path / "out"), 3, 4, value_type="float", version=1)
    assert sorted(os.listdir(tmp_path / "out")) == ["0601.nc", "_SUCCESS"]
    got = g.read_fields(spark, f"{tmp_path}/out/*.nc", ["Climmean", "P90_sst"], "Lat", "Lon").collect()
    assert {(r.lat_idx, r.lon_idx, r.Climmean, r.P90_sst) for r in got} == {(i, j, m, p) for _, i, j, m, p in rows}


def test_light_files_have_no_coordinates(spark, tmp_path):
    df = spark.createDataFrame([(152, 0, 0, 1.0, 2.0)], "doy int, lat_idx int, lon_idx int, clim_mean double, p90 double")
    g.write_fields(df, str(tmp_path / "out"), 1, 1, coords=False)
    assert set(g.decode((tmp_path / "out" / "0601.nc").read_bytes())) == {"dayofyear", "Climmean", "P90_sst"}
