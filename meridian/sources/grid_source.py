"""An archive of daily grid files as a data source that reads what is asked for.

Files are named YYYYMMDD or MMDD, with or without an ending. Conditions on year, doy and file choose the
files when the query is planned, so others aren't opened; conditions on lat_idx choose the rows, of which
only the bytes (or the chunks) are read where the field lies by latitude. Files are dealt to partitions
by their sizes. As a stream, the archive's offsets are source days: a batch holds all files of the days
that have come since, of all years, so a day is complete in its batch.

Defined results: files with other names have null year and doy; February 29 has a year and no doy;
hidden files and those that start with _ aren't read; a file that can't be read has no rows, or ends the
query where ``on_error`` is 'fail'.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from meridian.session import qualified, store

from .grid_nc import field, variables
from .ranged import Ranged

NAMED = re.compile(r"(\d{4})?(\d\d)(\d\d)(\.\w+)?")
FILE_COST = 1 << 20  # what opening a file counts for, in bytes
RANGES = {ds.EqualTo: lambda v: (v, v), ds.GreaterThan: lambda v: (v + 1, None), ds.GreaterThanOrEqual: lambda v: (v, None), ds.LessThan: lambda v: (None, v - 1), ds.LessThanOrEqual: lambda v: (None, v)}


def day_of(name: str) -> tuple[int | None, int | None]:
    """Year and day of the year without leap day that a file's name tells."""
    m = NAMED.fullmatch(name)
    if not m:
        return None, None
    year, month, day = (int(x) if x else None for x in m.groups()[:3])
    try:
        if (month, day) == (2, 29):
            datetime.date(year or 2000, month, day)
            return year, None
        return year, datetime.date(2001, month, day).timetuple().tm_yday
    except ValueError:
        return None, None


@dataclass(frozen=True)
class GridFile:
    path: str
    name: str
    size: int
    year: int | None
    doy: int | None


@dataclass
class Files(ds.InputPartition):
    files: list[GridFile]
    rows: tuple[int, int | None]


def archive(folder: str) -> list[GridFile]:
    """The files below a folder, in the order of their days."""
    from pyarrow.fs import FileSelector, FileType

    fs, place = store(folder)
    listed = [f for f in fs.get_file_info(FileSelector(place, recursive=True)) if f.type == FileType.File]
    plain = [f for f in listed if not any(part.startswith(("_", ".")) for part in f.path[len(place) :].split("/") if part)]
    found = [GridFile(f.path, f.base_name, f.size, *day_of(f.base_name)) for f in plain]
    return sorted(found, key=lambda f: (f.doy or 0, f.year or 0, f.name))


def dealt(files: list[GridFile], rows: tuple[int, int | None], target: int) -> list[Files]:
    """Consecutive files, up to ``target`` bytes a partition."""
    out: list[Files] = []
    left = 0
    for f in files:
        cost = f.size + FILE_COST
        if not out or left < cost:
            out.append(Files([], rows))
            left = target
        out[-1].files.append(f)
        left -= cost
    return out


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.variables = options.get("variables", "data").split(",")
        self.lat, self.lon = options.get("lat", "lat"), options.get("lon", "lon")
        self.on_error, self.target = options.get("on_error", "null"), int(options.get("partition_bytes", 32 << 20))

    def _batch(self, opened: Ranged, file: GridFile, rows: tuple[int, int | None]) -> pa.RecordBatch:
        first, last = rows
        wanted = None if rows == (0, None) else (first, last if last is not None else 1 << 31)
        found = variables(opened)
        fields = [field(found, v, self.lat, self.lon, wanted) for v in self.variables]
        if len({f.shape for f in fields}) > 1:
            raise ValueError("fields of different grids")
        n = fields[0].size
        i, j = np.indices(fields[0].shape, dtype=np.int32)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        cols = [same(file.name, pa.string()), same(file.year, pa.int32()), same(file.doy, pa.int32()), pa.array(i.ravel() + np.int32(first)), pa.array(j.ravel()), *(pa.array(f.ravel(), from_pandas=True) for f in fields)]
        return pa.RecordBatch.from_arrays(cols, names=["file", "year", "doy", "lat_idx", "lon_idx", *self.variables])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.folder)
        for file in partition.files:
            try:
                with fs.open_input_file(file.path) as opened:
                    batch = self._batch(Ranged(opened, file.size), file, partition.rows)
            except (ValueError, OSError) as e:
                if self.on_error == "fail":
                    raise ValueError(f"{file.path}: {e}") from e
                continue
            yield batch


class GridReader(_Reading, ds.DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.wanted: dict[str, list] = {}
        self.rows: tuple[int, int | None] = (0, None)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes over comparisons of year, doy, file and lat_idx with constants."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("year", "doy", "lat_idx") and type(f) in RANGES:
                self._narrow(column, *RANGES[type(f)](f.value))
            elif column in ("year", "doy", "file") and isinstance(f, (ds.In, ds.EqualTo)):
                values = set(f.value) if isinstance(f, ds.In) else {f.value}
                self.wanted.setdefault(column, []).append(lambda x, values=values: x in values)
            elif column in ("year", "doy", "file") and isinstance(f, ds.IsNotNull):
                self.wanted.setdefault(column, []).append(lambda x: x is not None)
            elif column in ("file",) and isinstance(f, ds.StringStartsWith):
                self.wanted.setdefault(column, []).append(lambda x, start=f.value: x.startswith(start))
            elif not (column == "lat_idx" and isinstance(f, ds.IsNotNull)):
                yield f

    def _narrow(self, column: str, low: int | None, high: int | None) -> None:
        if column == "lat_idx":
            first, last = self.rows
            first = max(first, low or 0)
            last = last if high is None else max(0, high + 1) if last is None else max(0, min(last, high + 1))
            self.rows = (first, last if last is None else max(first, last))
        else:
            self.wanted.setdefault(column, []).append(lambda x: x is not None and (low is None or x >= low) and (high is None or x <= high))

    def partitions(self) -> list[Files]:
        files = [f for f in archive(self.folder) if all(ok(getattr(f, {"file": "name"}.get(c, c))) for c, tests in self.wanted.items() for ok in tests)]
        if self.rows[0] == self.rows[1]:
            files = []
        return dealt(files, self.rows, self.target) or [Files([], (0, None))]


class GridStream(_Reading, ds.DataSourceStreamReader):
    """Offsets are source days, in the order of the year; files of days before the last offset that come late aren't seen."""

    def __init__(self, options):
        super().__init__(options)
        self.first_day, self.last_day = int(options.get("first_day", 1)), int(options.get("last_day", 365))

    def initialOffset(self) -> dict:
        return {"day": self.first_day - 1}

    def latestOffset(self) -> dict:
        return {"day": max((f.doy for f in archive(self.folder) if f.doy is not None and self.first_day <= f.doy <= self.last_day), default=self.first_day - 1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in archive(self.folder) if f.doy is not None and start["day"] < f.doy <= end["day"]], (0, None), self.target)


class GridSource(ds.DataSource):
    """Options: path (with its scheme), variables, lat, lon, on_error, partition_bytes, and for a stream first_day and last_day."""

    @classmethod
    def name(cls) -> str:
        return "grid_archive"

    def schema(self) -> str:
        return ", ".join(["file string", "year int", "doy int", "lat_idx int", "lon_idx int", *(f"`{v}` double" for v in self.options.get("variables", "data").split(","))])

    def reader(self, schema) -> ds.DataSourceReader:
        return GridReader(self.options)

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return GridStream(self.options)


def _options(spark: SparkSession, path: str, names: list[str], lat: str, lon: str, on_error: str, more: dict) -> dict:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when the query is planned
    spark.dataSource.register(GridSource)
    return {"path": qualified(spark, path), "variables": ",".join(names), "lat": lat, "lon": lon, "on_error": on_error} | {k: str(v) for k, v in more.items()}


def read_archive(spark: SparkSession, path: str, names: list[str] | None = None, lat: str = "lat", lon: str = "lon", on_error: str = "null", **more) -> DataFrame:
    """file, year, doy, lat_idx, lon_idx and the variables as doubles, null where missing."""
    return spark.read.format(GridSource.name()).options(**_options(spark, path, names or ["data"], lat, lon, on_error, more)).load()


def stream_archive(spark: SparkSession, path: str, names: list[str] | None = None, lat: str = "lat", lon: str = "lon", on_error: str = "null", **more) -> DataFrame:
    """The same as a stream; a batch holds whole source days."""
    return spark.readStream.format(GridSource.name()).options(**_options(spark, path, names or ["data"], lat, lon, on_error, more)).load()
