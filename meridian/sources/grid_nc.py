"""Daily fields in NetCDF files: classic ones (CDF-1, CDF-2 and CDF-5) and NetCDF-4 (HDF5), in and out.

``read_fields`` goes through Spark's binaryFile source, so any file system that Spark reads will do, and
parses whole files in Arrow batches; ``grid_source`` plans partitions of files by their names and reads
the bytes that are asked for. Writing packs each day's field into one file's bytes on the executors and
stores them through ``file_sink``, which publishes a job's files when all are there.

A file that can't be read, whatever is wrong with it, has no rows (``on_error='null'``) or ends the job
with its name (``'fail'``); it never ends the job otherwise.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.calendar import mmdd, noleap_date, yyyymmdd
from meridian.session import qualified

from . import hdf5
from .file_sink import FileSink
from .hdf5 import MOST_RANK, Unreadable, Variable, rows_axis
from .ranged import Source

# fixed values of the file format
DIMENSION, VARIABLE, ATTRIBUTE = 0x0A, 0x0B, 0x0C
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"text": 2, "float": 5, "double": 6}


class _Classic:
    """The header of a classic file."""

    def __init__(self, source: Source):
        self.source, self.version, self.at = source, source.read(3, 1)[0], 4
        if source.read(0, 3) != b"CDF" or self.version not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.records = self.count(open_end=True)
        self.dims = self.listed(DIMENSION, lambda: (self.name(), self.count()))
        self.listed(ATTRIBUTE, self.attribute)
        self.variables = self.listed(VARIABLE, self.variable)

    def take(self, form: str) -> int:
        (value,) = struct.unpack(form, self.source.read(self.at, struct.calcsize(form)))
        self.at += struct.calcsize(form)
        return value

    def count(self, open_end: bool = False) -> int:
        n = self.take(">q" if self.version == 5 else ">i")
        if n < 0 and not open_end:
            raise ValueError("damaged NetCDF header")
        return n

    def padded(self, n: int) -> bytes:
        raw = self.source.read(self.at, n)
        self.at += -(-n // 4) * 4
        return raw

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def listed(self, tag: int, item) -> list:
        found, n = self.take(">i"), self.count()
        if found not in (0, tag) or (not found and n) or n > self.source.size:
            raise ValueError("damaged NetCDF header")
        return [item() for _ in range(n)]

    def attribute(self):
        name, kind, n = self.name(), self.take(">i"), self.count()
        raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
        return name, raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind])

    def variable(self):
        name, n = self.name(), self.count()
        if n > MOST_RANK:
            raise ValueError("damaged NetCDF header")
        dims = [self.count() for _ in range(n)]
        attributes, kind = dict(self.listed(ATTRIBUTE, self.attribute)), self.take(">i")
        self.count(open_end=True)  # the size may not fit
        return name, dims, attributes, np.dtype(TYPES[kind]), self.take(">i" if self.version == 1 else ">q")

    def found(self) -> dict[str, Variable]:
        """Variables; those over the record dimension (of length 0 in the header) lie interleaved."""
        recorded = [v for v in self.variables if v[1] and self.dims[v[1][0]][1] == 0]
        sizes = [math.prod(self.dims[d][1] for d in v[1][1:]) * v[3].itemsize for v in recorded]
        step = sizes[0] if len(sizes) == 1 else sum(-(-n // 4) * 4 for n in sizes)
        records = max(0, self.records if self.records >= 0 or not recorded else (self.source.size - min(v[4] for v in recorded)) // max(1, step))
        out = {}
        for v in self.variables:
            name, ids, notes, dtype, begin = v
            shape = [self.dims[d][1] for d in ids]
            if v in recorded:
                shape[0] = records
            read = self._recorded(shape, dtype, begin, step) if v in recorded and records != 1 else self._fixed(shape, dtype, begin)
            out[name] = Variable([self.dims[d][0] for d in ids], shape, dtype, notes, read)
        return out

    def _fixed(self, shape: list[int], dtype: np.dtype, begin: int):
        def read(first: int | None = None, last: int | None = None) -> np.ndarray:
            axis = rows_axis(shape)
            a, b = (0, shape[axis] if shape else 1) if first is None else (min(first, shape[axis]), min(last, shape[axis]))
            part = shape[:axis] + [b - a] + shape[axis + 1 :] if shape else []
            row = math.prod(shape[axis + 1 :]) * dtype.itemsize
            return np.frombuffer(self.source.read(begin + a * row, (b - a) * row), dtype, math.prod(part)).reshape(part)

        return read

    def _recorded(self, shape: list[int], dtype: np.dtype, begin: int, step: int):
        def read(first: int | None = None, last: int | None = None) -> np.ndarray:
            n = math.prod(shape[1:])
            rows = [np.frombuffer(self.source.read(begin + i * step, n * dtype.itemsize), dtype, n) for i in range(shape[0])]
            whole = np.concatenate([np.zeros(0, dtype), *rows]).reshape(shape)
            return whole if first is None else whole.take(np.arange(first, min(last, shape[rows_axis(shape)])), axis=rows_axis(shape))

        return read


def variables(source: Source) -> dict[str, Variable | Unreadable]:
    """Variables of a file; whatever is wrong with its header comes up as ValueError."""
    if source.size >= 8 and source.read(0, 8) == hdf5.SIGNATURE:
        return hdf5.variables(source)
    try:
        return dict(_Classic(source).found())
    except Exception as e:
        raise e if type(e) is ValueError else ValueError(f"damaged NetCDF file: {e or type(e).__name__}") from e


def decode(data: bytes) -> dict[str, tuple[list[str | None], np.ndarray, dict] | Unreadable]:
    """Variables of a file with all their values: names of dimensions, values, attributes."""
    found = variables(Source(data))
    try:
        return {name: v if isinstance(v, Unreadable) else (v.dims, v.read(), v.notes) for name, v in found.items()}
    except Exception as e:
        raise e if type(e) is ValueError else ValueError(f"damaged file: {e or type(e).__name__}") from e


def encode(dims: dict[str, int], variables: list[tuple[str, list[str], np.ndarray, str, dict[str, str | float]]], version: int = 2) -> bytes:
    """A classic file of fixed-size variables (name, dimensions, values, 'float' or 'double', attributes: texts or numbers)."""
    if version not in (1, 2, 5):
        raise ValueError("version is 1, 2 or 5")
    count = (lambda n: struct.pack(">q", n)) if version == 5 else (lambda n: struct.pack(">i", n))
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: count(len(s.encode())) + pad(s.encode())
    listed = lambda tag, items: struct.pack(">i", tag if items else 0) + count(len(items)) + b"".join(items)
    order = list(dims)

    def attribute(k: str, t: str | float) -> bytes:
        kind, n, raw = (CODES["text"], len(t.encode()), t.encode()) if isinstance(t, str) else (CODES["double"], 1, struct.pack(">d", t))
        return name(k) + struct.pack(">i", kind) + count(n) + pad(raw)

    def header(begins: list[int]) -> bytes:
        entries = []
        for (v, ids, values, kind, notes), begin in zip(variables, begins, strict=True):
            attributes = [attribute(k, t) for k, t in notes.items()]
            size = -(-values.size * np.dtype(TYPES[CODES[kind]]).itemsize // 4) * 4
            place = struct.pack(">i" if version == 1 else ">q", begin)
            entries.append(name(v) + count(len(ids)) + b"".join(count(order.index(d)) for d in ids) + listed(ATTRIBUTE, attributes) + struct.pack(">i", CODES[kind]) + count(size) + place)
        return b"CDF" + bytes([version]) + count(0) + listed(DIMENSION, [name(d) + count(n) for d, n in dims.items()]) + listed(ATTRIBUTE, []) + listed(VARIABLE, entries)

    payload = [pad(np.ascontiguousarray(values, dtype=TYPES[CODES[kind]]).tobytes()) for _, _, values, kind, _ in variables]
    begins, at = [], len(header([0] * len(variables)))
    for p in payload:
        begins.append(at)
        at += len(p)
    return header(begins) + b"".join(payload)


def _field(found: dict, variable: str, lat: str, lon: str, rows: tuple[int, int] | None) -> np.ndarray:
    if variable not in found:
        raise ValueError(f"{variable} is missing")
    v = found[variable]
    if isinstance(v, Unreadable):
        raise ValueError(f"{variable}: {v.reason}")
    kept = [d for d in v.dims if d in (lat, lon)]
    if kept not in ([lat, lon], [lon, lat]) or any(n != 1 for n, d in zip(v.shape, v.dims, strict=True) if d not in (lat, lon)):
        raise ValueError(f"{variable} is not a field over {lat} and {lon}")
    first, last = rows or (0, None)
    by_rows = rows is not None and v.dims[rows_axis(v.shape)] == lat  # else all is read and cut afterwards
    values = (v.read(first, last) if by_rows else v.read()).astype(np.float64)
    gone = np.isnan(values)
    for mark in ("_FillValue", "missing_value"):
        if mark in v.notes:
            gone |= values == v.notes[mark][0]
    values = values * v.notes.get("scale_factor", [1.0])[0] + v.notes.get("add_offset", [0.0])[0]
    values = np.where(gone, np.nan, values).reshape([n for n, d in zip(values.shape, v.dims, strict=True) if d in (lat, lon)])
    values = values if kept == [lat, lon] else values.T
    return values if by_rows or rows is None else values[first:last]


def field(found: dict, variable: str, lat: str, lon: str, rows: tuple[int, int] | None = None) -> np.ndarray:
    """A variable as doubles over (lat, lon), or its latitudes ``rows`` (first, end): marks for missing values (compared before scaling) are NaN, scale and offset applied."""
    try:
        return _field(found, variable, lat, lon, rows)
    except Exception as e:
        raise e if type(e) is ValueError else ValueError(f"{variable}: {e or type(e).__name__}") from e


def _rows(names: list[str], lat: str, lon: str, on_error: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = variables(Source(content))
                    fields = [field(found, v, lat, lon) for v in names]
                    if len({f.shape for f in fields}) > 1:
                        raise ValueError("fields of different grids")
                except ValueError as e:
                    if on_error == "fail":
                        raise ValueError(f"{path}: {e}") from e
                    continue
                n_lat, n_lon = fields[0].shape
                i, j = np.indices((n_lat, n_lon), dtype=np.int32)
                cols = [pa.array([os.path.basename(path)] * (n_lat * n_lon)), pa.array(i.ravel()), pa.array(j.ravel()), *(pa.array(f.ravel(), from_pandas=True) for f in fields)]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "lat_idx", "lon_idx", *names])

    return run


PROBED = "file string, dims array<string>, shape array<int>, type string, attributes map<string, string>, problem string"


def probe(spark: SparkSession, path: str, variable: str, shape: tuple[int, int] | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """What each file holds of a variable: dimensions, shape, type and attributes, and the problem it has, if any; ``shape`` is the grid expected (lat, lon)."""

    def look(path: str, content: bytes) -> dict:
        row = {"file": os.path.basename(path), "dims": None, "shape": None, "type": None, "attributes": None, "problem": None}
        try:
            found = variables(Source(content))
            size = field(found, variable, lat, lon).shape
            v = found[variable]
            row |= {"dims": v.dims, "shape": list(v.shape), "type": v.dtype.name, "attributes": [(k, x if isinstance(x, str) else " ".join(map(str, x))) for k, x in v.notes.items()]}
            if shape is not None and tuple(size) != tuple(shape):
                row["problem"] = f"grid of {size[0]} x {size[1]}, not {shape[0]} x {shape[1]}"
        except ValueError as e:
            row["problem"] = str(e)
        return row

    kinds = [("file", pa.string()), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int32())), ("type", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("problem", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [look(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PROBED)


def read_fields(spark: SparkSession, path: str, variables: list[str], lat: str = "lat", lon: str = "lon", on_error: str = "null") -> DataFrame:
    """file, lat_idx, lon_idx and the variables as doubles, null where missing; either order of dimensions.

    With ``on_error='null'`` unreadable files have no rows (see ``obs.missing_days``), with 'fail' the job stops.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows(variables, lat, lon, on_error), ", ".join(["file string", "lat_idx int", "lon_idx int", *(f"{v} double" for v in variables)]))


#: Kinds of files by name: classic ones, and NetCDF-4 with plain or with compressed fields.
ENCODERS = {"classic": encode, "netcdf4": hdf5.encode, "netcdf4-compressed": lambda dims, fields: hdf5.encode(dims, fields, chunk=256)}


def _pack_day(n_lat: int, n_lon: int, value_type: str, write, coords: bool):
    def run(table: pa.Table) -> pa.Table:
        doy, name = table.column("doy")[0].as_py(), table.column("name")[0].as_py()
        lat, lon = table.column("lat_idx").to_numpy(), table.column("lon_idx").to_numpy()
        fields = [("dayofyear", ["Day"], np.array([doy]), "double", {})]
        if coords:
            fields += _coordinates(n_lat, n_lon, "Lat", "Lon")
        for v, column, note in (("Climmean", "clim_mean", "day-of-year mean"), ("P90_sst", "p90", "day-of-year 90th percentile")):
            values = np.full((n_lat, n_lon), np.nan)
            values[lat, lon] = table.column(column).to_numpy()
            fields.append((v, ["Lat", "Lon"], values, value_type, {"long_name": note}))
        return pa.table({"name": pa.array([f"{name}.nc"]), "content": pa.array([write({"Lat": n_lat, "Lon": n_lon, "Day": 1}, fields)], pa.binary())})

    return run


def _coordinates(n_lat: int, n_lon: int, lat: str, lon: str) -> list[tuple]:
    return [(lat, [lat], -90 + 180 / max(1, n_lat - 1) * np.arange(n_lat), "double", {"units": "degrees_north"}), (lon, [lon], 360 / n_lon * np.arange(n_lon), "double", {"units": "degrees_east"})]


def _pack_grid(n_lat: int, n_lon: int, variable: str, kind: str, lat_first: bool):
    def run(table: pa.Table) -> pa.Table:
        name = table.column("name")[0].as_py()
        values = np.full((n_lat, n_lon), np.nan)
        values[table.column("lat_idx").to_numpy(), table.column("lon_idx").to_numpy()] = table.column("v").to_numpy()
        data = (variable, ["lat", "lon"], values, "double", {}) if lat_first else (variable, ["lon", "lat"], values.T, "double", {})
        return pa.table({"name": pa.array([name]), "content": pa.array([ENCODERS[kind]({"lat": n_lat, "lon": n_lon}, [*_coordinates(n_lat, n_lon, "lat", "lon"), data])], pa.binary())})

    return run


def store_files(packed: DataFrame, path: str) -> None:
    """(name, content) rows as files of a folder: all of them, or none."""
    packed.sparkSession.dataSource.register(FileSink)
    packed.write.format(FileSink.name()).mode("append").save(qualified(packed.sparkSession, path))


def write_fields(result: DataFrame, path: str, n_lat: int, n_lon: int, value_type: str = "float", version: int = 2, coords: bool = True, kind: str = "classic") -> None:
    """One file MMDD.nc per day of (doy, lat_idx, lon_idx, clim_mean, p90); missing cells are NaN.

    ``kind`` is one of ``ENCODERS``; ``version`` (1, 2 or 5) is that of classic files.
    """
    write = partial(encode, version=version) if kind == "classic" else ENCODERS[kind]
    rows = result.select("doy", mmdd(F.col("doy")).alias("name"), "lat_idx", "lon_idx", F.col("clim_mean").cast("double"), F.col("p90").cast("double"))
    store_files(rows.groupBy("doy").applyInArrow(_pack_day(n_lat, n_lon, value_type, write, coords), "name string, content binary"), path)


def write_archive(obs: DataFrame, path: str, n_lat: int, n_lon: int, variable: str = "data", kind: str = "classic", lat_first: bool = True) -> None:
    """Observations (year, doy, lat_idx, lon_idx, v) as an archive of one file YYYYMMDD a day, each a whole grid; missing cells are NaN."""
    name = yyyymmdd(noleap_date(F.col("year"), F.col("doy"))).alias("name")
    rows = obs.select(name, "lat_idx", "lon_idx", F.col("v").cast("double").alias("v"))
    store_files(rows.groupBy("name").applyInArrow(_pack_grid(n_lat, n_lon, variable, kind, lat_first), "name string, content binary"), path)
