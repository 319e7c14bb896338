"""A data source for .npy matrices: rows by number, in as many partitions as wanted, reading only the bytes of its rows."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, and of what is read at once.
PARTITION_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Types of numbers and the Spark type of a row's elements.
KINDS = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "bigint"}
MAGIC = b"\x93NUMPY"


@dataclass(frozen=True)
class Header:
    kind: str
    rows: int
    width: int
    offset: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


def header(path: str) -> Header:
    """What a file's head says: type, rows, numbers a row, and where the rows begin. A vector counts as rows of one number."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        head = f.read(12)
        if head[:6] != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        size, start = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
        said = ast.literal_eval(f.read_at(size, start).decode("latin1"))
    if said["fortran_order"] or said["descr"] not in KINDS or not 1 <= len(said["shape"]) <= 2:
        raise ValueError(f"{path} has {said}; rows of {', '.join(KINDS)} are read")
    shape = said["shape"]
    return Header(said["descr"], shape[0], shape[1] if len(shape) == 2 else 1, start + size)


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.head = header(self.path)
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.first, self.end = int(options.get("firstrow", 0)), min(self.head.rows, int(options.get("endrow", self.head.rows)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on row narrow what is read; every filter still runs, as a bound may cover more than it asks."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                self._narrow(f)
            yield f

    def _narrow(self, f: Filter) -> None:
        value = getattr(f, "value", None)
        if isinstance(f, EqualTo):
            self.first, self.end = max(self.first, value), min(self.end, value + 1)
        elif isinstance(f, In) and value:
            self.first, self.end = max(self.first, min(value)), min(self.end, max(value) + 1)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.first = max(self.first, value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.end = min(self.end, value + isinstance(f, LessThanOrEqual))

    def partitions(self) -> list[Rows]:
        step = max(1, self.bytes // max(1, self.head.width * np.dtype(self.head.kind).itemsize))
        return [Rows(a, min(self.end, a + step)) for a in range(max(0, self.first), self.end, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(self.head.kind)
        wide = self.head.width * kind.itemsize
        step = max(1, READ_BYTES // max(1, wide))
        system, where = _open(self.path)
        with system.open_input_file(where) as f:
            for a in range(partition.first, partition.end, step):
                n = min(step, partition.end - a)
                x = np.frombuffer(f.read_at(n * wide, self.head.offset + a * wide), dtype=kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.head.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), lists], names=["row", "vector"])


class NpyDataSource(DataSource):
    """Format `npy`: (row, vector). Options: path, partitionBytes, firstRow, endRow."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row bigint, vector array<{KINDS[header(self.options['path']).kind]}>"

    def reader(self, schema) -> NpyReader:  # noqa: ANN001
        return NpyReader(dict(self.options))


def read_npy(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(row, vector) of a .npy matrix; options as in NpyDataSource."""
    spark.dataSource.register(NpyDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_npy(df: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """Each partition's vectors as one .npy file under path; (key, file, row) tells where a key's vector lies.

    Vectors have equal lengths (else a ValueError), null elements become NaN; rows without a vector have no place. A file gets
    its name when it is whole, so an attempt that was lost leaves none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts = [], []
        for b in batches:
            for k, v in zip(b["k"], b["v"], strict=True):
                if v is not None:
                    keys.append(k)
                    parts.append(np.asarray(v, dtype=np.float32))
        if not parts:
            return
        if len({len(p) for p in parts}) > 1:
            raise ValueError("vectors of several lengths")
        context = TaskContext.get()
        system, where = _open(path)
        system.create_dir(where, recursive=True)
        name = f"part-{context.partitionId():05}.npy"
        body = {"descr": "<f4", "fortran_order": False, "shape": (len(parts), len(parts[0]))}
        text = str(body)
        text += " " * (-(10 + len(text) + 1) % 64) + "\n"
        with system.open_output_stream(f"{where}/.{name}.{context.taskAttemptId()}") as f:
            f.write(MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin1"))
            for p in parts:
                f.write(p.tobytes())
        system.move(f"{where}/.{name}.{context.taskAttemptId()}", f"{where}/{name}")
        yield pd.DataFrame({"k": keys, "file": f"{path}/{name}", "row": np.arange(len(keys))})

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS k", f"`{vector}` AS v").mapInPandas(run, f"k {kind}, file string, row long").withColumnRenamed("k", key)
