"""Classic NetCDF (versions 1, 2 and 5) as a Spark data source, in numpy alone.

``spark.dataSource.register(NetcdfDataSource)``, then
``spark.read.format("netcdf3").option("variable", "t2m").load(path)`` gives the long table
(cell_id, lon, lat, ts, value).  A partition is a block of time steps; only its bytes are
read.  Paths may be several, separated by commas (files of successive years: a union along
time).  Other formats (NetCDF-4) raise an error that says so.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: external types and their numpy names.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
BLOCK_VALUES = 4 << 20


def open_input(path: str):
    """A seekable binary file: a mounted path or any file system that pyarrow knows."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return where.open_input_file(name)
    return open(re.sub("^file:(//)?", "", path), "rb")


@dataclass
class Variable:
    dims: list[int]
    attrs: dict
    kind: str
    begin: int
    is_record: bool


@dataclass
class Header:
    dims: list[tuple[str, int]] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0

    def shape(self, name: str) -> list[int]:
        v = self.variables[name]
        return [self.records if v.is_record and i == 0 else self.dims[d][1] for i, d in enumerate(v.dims)]


def read_header(f) -> Header:
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        kind = "NetCDF-4 / HDF5 (convert it to the classic format)" if magic[1:] == b"HDF" else "not NetCDF"
        raise ValueError(f"only classic NetCDF files are read; this one is {kind}")
    wide = magic[3] == 5

    def number(long: bool = wide) -> int:
        return struct.unpack(">q" if long else ">i", f.read(8 if long else 4))[0]

    def name() -> str:
        n = number()
        out = f.read(n).decode("utf-8")
        f.read(-n % 4)
        return out

    def attributes() -> dict:
        f.read(4)
        out = {}
        for _ in range(number()):
            key, code = name(), number(False)
            n = number()
            kind = np.dtype(TYPES[code])
            raw = f.read(n * kind.itemsize)
            f.read(-(n * kind.itemsize) % 4)
            if code == 2:
                out[key] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                got = np.frombuffer(raw, kind)
                out[key] = got[0].item() if n == 1 else got.tolist()
        return out

    h = Header()
    h.records = number()
    f.read(4)
    h.dims = [(name(), number()) for _ in range(number())]
    h.attrs = attributes()
    f.read(4)
    for _ in range(number()):
        own = name()
        dims = [number() for _ in range(number())]
        attrs, code = attributes(), number(False)
        number()  # the size is that of the dimensions
        begin = number(magic[3] != 1)
        record = bool(dims) and h.dims[dims[0]][1] == 0
        h.variables[own] = Variable(dims, attrs, TYPES[code], begin, record)
    sizes = {n: math.prod(h.shape(n)[1:]) * np.dtype(v.kind).itemsize for n, v in h.variables.items() if v.is_record}
    h.record_size = next(iter(sizes.values())) if len(sizes) == 1 else sum(s + -s % 4 for s in sizes.values())
    return h


def read_values(f, h: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Decoded values of steps ``start`` to ``stop`` of the first dimension; missing ones are NaN."""
    v, shape = h.variables[name], h.shape(name)
    stop = (shape[0] if shape else 1) if stop is None else stop
    each = math.prod(shape[1:])
    kind = np.dtype(v.kind)
    if v.is_record:
        parts = []
        for t in range(start, stop):
            f.seek(v.begin + t * h.record_size)
            parts.append(np.frombuffer(f.read(each * kind.itemsize), kind))
        raw = np.concatenate(parts) if parts else np.empty(0, kind)
    else:
        f.seek(v.begin + start * each * kind.itemsize)
        raw = np.frombuffer(f.read((stop - start) * each * kind.itemsize), kind)
    out = raw.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in v.attrs:
            out[raw == np.asarray(v.attrs[key], kind)] = np.nan
    out = out * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0)
    return out.reshape([stop - start, *shape[1:]]) if shape else out


_UNITS = re.compile(r"^\s*(hour|day)s?\s+since\s+(\d{4}-\d{1,2}-\d{1,2})(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", re.IGNORECASE)


def decode_times(values: np.ndarray, units: str) -> list[datetime]:
    m = _UNITS.match(units)
    if not m:
        raise ValueError(f"unsupported time unit: {units!r} (hours or days since a date)")
    origin = datetime(*map(int, m[2].split("-")), int(m[3] or 0), int(m[4] or 0), int(m[5] or 0))
    step = 3600 if m[1].lower() == "hour" else 86400
    return [origin + timedelta(seconds=round(float(x) * step)) for x in values]


def _name(h: Header, *names: str) -> str | None:
    return next((n for n in names if n in h.variables), None)


@dataclass
class Steps(InputPartition):
    path: str
    start: int
    stop: int


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.variable = options.get("variable")
        self.paths = [p for p in (options.get("path") or "").split(",") if p]
        if not self.variable or not self.paths:
            raise ValueError("give the option 'variable' and a path")
        self.block = int(options.get("blockValues", BLOCK_VALUES))

    def partitions(self):
        out = []
        for path in self.paths:
            with open_input(path) as f:
                h = read_header(f)
            if self.variable not in h.variables:
                raise ValueError(f"no variable {self.variable!r} in {path}; it has {', '.join(h.variables)}")
            shape = h.shape(self.variable)
            steps = shape[0] if len(shape) == 3 else 1
            each = max(1, self.block // max(1, math.prod(shape[-2:])))
            out += [Steps(path, a, min(steps, a + each)) for a in range(0, steps, each)]
        return out

    def read(self, part: Steps) -> Iterator[pa.RecordBatch]:
        with open_input(part.path) as f:
            h = read_header(f)
            lon_name, lat_name = _name(h, "longitude", "lon"), _name(h, "latitude", "lat")
            lon, lat = read_values(f, h, lon_name), read_values(f, h, lat_name)
            v = h.variables[self.variable]
            names = [h.dims[d][0] for d in v.dims]
            timed = len(names) == 3
            values = read_values(f, h, self.variable, part.start, part.stop) if timed else read_values(f, h, self.variable)[None]
            times: list = [None] * len(values)
            if timed:
                t = _name(h, "time", "valid_time")
                times = decode_times(read_values(f, h, t, part.start, part.stop), h.variables[t].attrs.get("units", ""))
            if names[-2:] == [lon_name, lat_name]:
                values = values.swapaxes(-1, -2)
        # Cells count latitudes upwards, whatever the file's order.
        rank = np.argsort(np.argsort(lat))
        cells = (np.arange(len(lon))[None, :] * len(lat) + rank[:, None]).reshape(-1).astype(np.int32)
        x, y = np.broadcast_to(lon[None, :], values.shape[1:]).reshape(-1), np.broadcast_to(lat[:, None], values.shape[1:]).reshape(-1)
        for when, grid in zip(times, values):
            flat = grid.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(x), pa.array(y), pa.array([when] * flat.size, pa.timestamp("us")), pa.array(flat, mask=np.isnan(flat))],
                ["cell_id", "lon", "lat", "ts", "value"],
            )


class NetcdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return "cell_id int, lon double, lat double, ts timestamp_ntz, value double"

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options)


def load_cube(spark: SparkSession, path: str | list[str], variable: str) -> DataFrame:
    """(cell_id, lon, lat, ts, <variable>) of one file, or of several along time."""
    spark.dataSource.register(NetcdfDataSource)
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise ValueError("no file to read")
    return spark.read.format("netcdf3").option("variable", variable).option("path", ",".join(paths)).load().withColumnRenamed("value", variable)


def load_mask(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """grid_cells: (cell_id, lon, lat, land_frac), from a variable without time or its first step."""
    with open_input(path) as f:
        h = read_header(f)
    names = [variable] if variable else ["country", "lsm"]
    own = _name(h, *names)
    if own is None:
        raise ValueError(f"no variable {' or '.join(names)} in {path}")
    first = load_cube(spark, path, own).groupBy("cell_id", "lon", "lat").agg(F.min_by(own, "ts").alias("timed"), F.max(own).alias("plain"))
    return first.select("cell_id", "lon", "lat", F.coalesce("timed", "plain").alias("land_frac"))


def load_component(spark: SparkSession, path: str | list[str], variable: str, *, mask_path: str | None = None, threshold: float = 0.8) -> DataFrame:
    """A cube, masked where a mask is given."""
    from ..operators.mask import apply_mask

    cube = load_cube(spark, path, variable)
    return apply_mask(cube, load_mask(spark, mask_path), values=[variable], threshold=threshold) if mask_path else cube


def describe_times(cube: DataFrame) -> DataFrame:
    """(n_steps, start, end, step_hours): number of time steps, their ends, the step between the first two.

    The step is NULL for a single time.
    """
    steps = cube.select("ts").distinct()
    # Minimum, and minimum of the rest: aggregates only, whatever the step.
    ends = steps.agg(F.count(F.lit(1)).alias("n_steps"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    second = steps.join(steps.agg(F.min("ts").alias("first")), F.col("ts") > F.col("first")).agg(F.min("ts").alias("second"))

    def seconds(c: str):
        return F.unix_timestamp(F.col(c).cast("timestamp"))

    return ends.join(second).withColumn("step_hours", (seconds("second") - seconds("start")) / 3600.0).drop("second")


def write_netcdf3(path: str, lon, lat, values, *, variable: str, hours=None, origin: str = "1900-01-01 00:00:00") -> None:
    """A small classic file, (time, latitude, longitude) or (latitude, longitude): for exports and tests."""
    values = np.asarray(values, float)
    dims = ([("time", len(hours))] if hours is not None else []) + [("latitude", len(lat)), ("longitude", len(lon))]

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attrs(d: dict) -> bytes:
        if not d:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(d))
        for k, v in d.items():
            b = v.encode() if isinstance(v, str) else struct.pack(">d", v)
            out += text(k) + struct.pack(">ii", 2 if isinstance(v, str) else 6, len(b) if isinstance(v, str) else 1) + b + b"\0" * (-len(b) % 4)
        return out

    index = {n: i for i, (n, _) in enumerate(dims)}
    data = {"latitude": (["latitude"], {}, np.asarray(lat, float)), "longitude": (["longitude"], {}, np.asarray(lon, float))}
    if hours is not None:
        data["time"] = (["time"], {"units": f"hours since {origin}"}, np.asarray(hours, float))
    data[variable] = ([n for n, _ in dims], {"_FillValue": -1e30}, np.where(np.isnan(values), -1e30, values))
    head = b"CDF\x02" + struct.pack(">iii", 0, 10, len(dims)) + b"".join(text(n) + struct.pack(">i", k) for n, k in dims) + attrs({})

    def variables(begin: int) -> bytes:
        out = struct.pack(">ii", 11, len(data))
        for n, (own, a, x) in data.items():
            out += text(n) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", index[d]) for d in own) + attrs(a) + struct.pack(">iiq", 6, x.size * 8, begin)
            begin += x.size * 8
        return out

    begin = len(head) + len(variables(0))
    with open(path, "wb") as f:
        f.write(head + variables(begin))
        for _, _, x in data.values():
            f.write(x.astype(">f8").tobytes())
