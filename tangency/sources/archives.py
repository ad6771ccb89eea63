"""Zip archives of meshes, read in place: the directory first, then each member by its byte range.

An archive's directory gives one row per member; members are dealt to tasks
of their own, which seek to a member and inflate it as they read, so that
nothing is unpacked and no archive is one task.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.sources.npz import local_path

_LOCAL = struct.Struct("<4s5H3L2H")
_ENTRY = "archive string, member string, offset long, packed long, size long, crc long, method int, fault string"
_STATS = "archive string, member string, size long, vertices long, faces long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, diagonal double, fault string"


def _directory(path: str) -> list[tuple]:
    try:
        with zipfile.ZipFile(local_path(path)) as archive:
            return [(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, None) for i in archive.infolist() if not i.is_dir()]
    except (OSError, zipfile.BadZipFile) as fault:
        return [(path, None, None, None, None, None, None, f"directory: {type(fault).__name__}")]


def members(archives: DataFrame, pattern: str = "*") -> DataFrame:
    """(archive, member, offset, packed, size, crc, method, fault) per member whose name fits ``pattern``, from rows (archive).

    An archive whose directory cannot be read is one row with its fault; an
    empty archive has no rows. Only directories are read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for path in part["archive"] for row in _directory(path) if row[1] is None or fnmatch(row[1], pattern)]
            for at in range(0, max(1, len(rows)), 10_000):
                frame = pd.DataFrame(rows[at : at + 10_000], columns=[c.split()[0] for c in _ENTRY.split(", ")])
                yield frame.astype({c: "Int64" for c in ("offset", "packed", "size", "crc")} | {"method": "Int32"})

    return archives.select("archive").mapInPandas(run, _ENTRY)


def blocks(path: str, offset: int, packed: int, crc: int, method: int, size: int = 1 << 16) -> Iterator[bytes]:
    """The unpacked bytes of a member, a block at a time; ValueError if it is damaged."""
    with open(local_path(path), "rb") as file:
        file.seek(offset)
        head = file.read(_LOCAL.size)
        if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
            raise ValueError("no member header")
        name, extra = _LOCAL.unpack(head)[-2:]
        file.seek(name + extra, 1)
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"method {method}")
        inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        sum_, left = 0, packed
        while left > 0:
            data = file.read(min(size, left))
            if not data:
                raise ValueError("cut off")
            left -= len(data)
            try:
                data = inflate.decompress(data) if inflate else data
            except zlib.error as fault:
                raise ValueError("not inflated") from fault
            sum_ = zlib.crc32(data, sum_)
            yield data
        if inflate:
            data = inflate.flush()
            sum_ = zlib.crc32(data, sum_)
            yield data
        if sum_ != crc:
            raise ValueError("checksum")


def _lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def obj_stats(parts: Iterator[bytes]) -> tuple:
    """(vertices, faces, six ends of the box, its diagonal) of OBJ text; without a vertex the box is the unit cube.

    Lines that begin with ``v`` but hold no three numbers are passed over.
    """
    vertices, faces = 0, 0
    low, high = np.full(3, np.inf), np.full(3, -np.inf)
    for line in _lines(parts):
        if line.startswith(b"v "):
            try:
                at = np.array([float(x) for x in line.split()[1:4]])
            except ValueError:
                continue
            if len(at) == 3:
                vertices, low, high = vertices + 1, np.minimum(low, at), np.maximum(high, at)
        elif line.startswith(b"f "):
            faces += 1
    if not vertices:
        low, high = np.zeros(3), np.ones(3)
    return vertices, faces, *low.tolist(), *high.tolist(), float(np.sqrt(((high - low) ** 2).sum()))


def archive_stats(spark: SparkSession, paths: list[str], pattern: str = "*.obj", tasks: int | None = None) -> DataFrame:
    """OBJ statistics of every member that fits ``pattern``, with its fault if it is damaged (then no numbers).

    ``paths`` names the archives; their members are dealt over ``tasks`` tasks
    (the session's parallelism by itself) whichever archive they come from.
    """
    archives = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, len(paths)))
    rows = members(archives, pattern).repartition(tasks or max(spark.sparkContext.defaultParallelism, len(paths)), F.xxhash64("archive", "member"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATS.split(", ")]
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                found, fault = (None,) * 9, row.fault
                if fault is None or pd.isna(fault):
                    fault = None
                    try:
                        found = obj_stats(blocks(row.archive, int(row.offset), int(row.packed), int(row.crc), int(row.method)))
                    except (OSError, ValueError) as problem:
                        fault = str(problem)
                out.append((row.archive, row.member, None if pd.isna(row.size) else int(row.size), *found, fault))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({c: "Int64" for c in ("size", "vertices", "faces")} | {c: "Float64" for c in names[5:12]})

    return rows.mapInPandas(run, _STATS)
