"""NPZ shards as a Spark data source: ``spark.read.format("npz")`` and ``df.write.format("npz")``.

A shard is one archive of arrays with the same number of rows; a column of
numbers is an array of one dimension, one of lists of one length an array of
two. ``metadata_json`` tells schema_version and row_count. A manifest beside
the shards lists every file with its rows and, if there is a column ``split``,
the rows of each split. Paths are of a file system that driver and executors
share.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

VERSION = 1
MANIFEST = "_manifest.json"
_META = "metadata_json"
_TYPES = {"i": {8: T.LongType(), 4: T.IntegerType(), 2: T.ShortType(), 1: T.ByteType()}, "f": {8: T.DoubleType(), 4: T.FloatType()}, "b": {1: T.BooleanType()}, "u": {8: T.LongType(), 4: T.LongType(), 2: T.IntegerType(), 1: T.ShortType()}}


def local_path(path: str) -> str:
    """The path of a plain or a file: address; another scheme is an error."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: shards are read from a shared file system, not from {parts.scheme}")
    return parts.path if parts.scheme else path


def shard_files(path: str) -> list[str]:
    path = local_path(path)
    found = sorted(glob.glob(f"{glob.escape(path)}/*.npz")) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise ValueError(f"{path}: no shards")
    return found


def _spark_type(dtype: np.dtype, dimensions: int) -> T.DataType:
    one = _TYPES.get(dtype.kind, {}).get(dtype.itemsize)
    if one is None and dtype.kind == "U":
        one = T.StringType()
    if one is None or dimensions > 2:
        raise ValueError(f"arrays of {dtype} and {dimensions} dimensions are not columns")
    return one if dimensions < 2 else T.ArrayType(one)


def _shapes(file: str) -> dict[str, tuple[np.dtype, tuple[int, ...]]]:
    """Names, types and shapes of a shard's arrays, from their headers."""
    out = {}
    with zipfile.ZipFile(file) as archive:
        for name in archive.namelist():
            with archive.open(name) as part:
                version = np.lib.format.read_magic(part)
                shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(part)
                out[name.removesuffix(".npy")] = dtype, shape
    return out


def _column(values: np.ndarray, kind: T.DataType) -> pa.Array:
    if values.dtype.kind == "u":
        if values.size and int(values.max()) >= 1 << 63:
            raise ValueError("an unsigned number is too large for a long")
        values = values.astype(np.int64)
    if values.dtype.kind == "U":
        return pa.array(values.tolist(), pa.string())
    if values.ndim == 1:
        return pa.array(values)
    flat = pa.array(np.ascontiguousarray(values).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


class NpzReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(file) for file in shard_files(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, names = partition.value, self.schema.names
        with np.load(file, allow_pickle=False) as archive:
            meta = json.loads(str(archive[_META].item())) if _META in archive.files else {}
            if meta.get("schema_version") != VERSION:
                raise ValueError(f"{file}: schema_version {meta.get('schema_version')} is not {VERSION}")
            missing = set(names) - set(archive.files)
            if missing:
                raise ValueError(f"{file}: no arrays {sorted(missing)}")
            columns = [archive[c] for c in names]
        if any(len(c) != meta.get("row_count") for c in columns):
            raise ValueError(f"{file}: row_count {meta.get('row_count')} is not that of its arrays")
        for at in range(0, meta["row_count"], 10_000):
            yield pa.RecordBatch.from_arrays([_column(c[at : at + 10_000], f.dataType) for c, f in zip(columns, self.schema)], names)


@dataclass
class NpzMessage(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class NpzWriter(DataSourceArrowWriter):
    """Shards in a folder of its own, renamed to their place when all tasks are through.

    A task that is run again writes files of other names; those of the lost
    run stay in the folder that the commit removes.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, local_path(options["path"]), overwrite
        self.rows = int(options.get("rowspershard", options.get("rowsPerShard", 65_536)))
        self.unsigned = {c for c in options.get("unsigned", "").split(",") if c}
        self.folder = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        if not overwrite and os.path.isdir(self.path) and glob.glob(f"{glob.escape(self.path)}/*.npz"):
            raise ValueError(f"{self.path}: there are shards already")

    def _arrays(self, table: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for name in table.column_names:
            column = table.column(name).combine_chunks()
            if column.null_count:
                raise ValueError(f"column {name} holds nulls, which shards cannot")
            if pa.types.is_list(column.type):
                sizes = np.unique(np.diff(column.offsets.to_numpy()))
                if len(sizes) > 1 or column.flatten().null_count:
                    raise ValueError(f"lists of column {name} differ in length or hold nulls")
                values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            elif pa.types.is_string(column.type):
                values = np.array(column.to_pylist(), dtype=np.str_)
            else:
                values = column.to_numpy(zero_copy_only=False)
            out[name] = values.astype(np.uint64) if name in self.unsigned else values
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> NpzMessage:
        message, held, n = NpzMessage(), [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            os.makedirs(self.folder, exist_ok=True)
            name = f"part-{uuid.uuid4().hex}.npz"
            meta = {"schema_version": VERSION, "row_count": table.num_rows}
            with open(f"{self.folder}/{name}", "wb") as out:
                np.savez_compressed(out, **self._arrays(table), **{_META: np.asarray(json.dumps(meta, sort_keys=True))})
            entry = {"file": name, "rows": table.num_rows}
            if "split" in table.column_names:
                counts = table.column("split").value_counts().to_pylist()
                entry["splits"] = {str(c["values"]): c["counts"] for c in sorted(counts, key=lambda c: str(c["values"]))}
            message.files.append(entry)

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == self.rows:
                    flush()
                    held, n = [], 0
        if n:
            flush()
        return message

    def commit(self, messages: list) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["file"])
        old = glob.glob(f"{glob.escape(self.path)}/*.npz") if self.overwrite else []
        os.makedirs(self.path, exist_ok=True)
        for f in files:
            os.rename(f"{self.folder}/{f['file']}", f"{self.path}/{f['file']}")
        with open(f"{self.path}/{MANIFEST}.new", "w") as out:
            json.dump({"schema_version": VERSION, "rows": sum(f["rows"] for f in files), "files": files}, out, indent=1)
        os.replace(f"{self.path}/{MANIFEST}.new", f"{self.path}/{MANIFEST}")
        for file in old:
            os.remove(file)
        self._tidy()

    def abort(self, messages: list) -> None:
        self._tidy()

    def _tidy(self) -> None:
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                os.remove(f"{self.folder}/{name}")
            os.rmdir(self.folder)


class NpzSource(DataSource):
    """Options: ``rowsPerShard`` (65,536), ``unsigned``, names of columns written as unsigned longs."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        shapes = _shapes(shard_files(self.options["path"])[0])
        return T.StructType([T.StructField(c, _spark_type(dtype, len(shape))) for c, (dtype, shape) in shapes.items() if c != _META])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def manifest_faults(path: str) -> list[str]:
    """What the shards in ``path`` and their manifest disagree on: missing, unlisted and wrongly counted files."""
    path = local_path(path)
    with open(f"{path}/{MANIFEST}") as part:
        manifest = json.load(part)
    listed = {f["file"]: f["rows"] for f in manifest["files"]}
    there = {os.path.basename(f) for f in glob.glob(f"{glob.escape(path)}/*.npz")}
    faults = [f"{f}: missing" for f in sorted(set(listed) - there)] + [f"{f}: not listed" for f in sorted(there - set(listed))]
    for f in sorted(there & set(listed)):
        rows = {shape[0] for name, (_, shape) in _shapes(f"{path}/{f}").items() if name != _META}
        if rows != {listed[f]}:
            faults.append(f"{f}: {sorted(rows)} rows, {listed[f]} listed")
    return faults + ([] if sum(listed.values()) == manifest["rows"] else ["the rows listed do not add up"])
