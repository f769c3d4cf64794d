"""PMTiles as a Spark data source: format("pmtiles").

Writing takes directory entries (tile_id, run_length, offset, length, data) in range partitions of ascending tile_id; data
is null where the contents stand earlier. Tasks write part files beside the target; the commit puts them together in
partition order. The target must be a path that driver and executors share. Reading gives (tile_id, z, x, y, data).
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.pmtiles import Archive, ArchiveInfo, Entry, assemble, zxy

_ENTRY = struct.Struct("<QQII")


@dataclass
class _Part(WriterCommitMessage):
    first: int
    data: str
    entries: str


class PMTilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.info = options["path"], options.get("info", "{}")
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"
        os.makedirs(self.parts, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        own = f"{self.parts}/{uuid.uuid4().hex}"  # each attempt has its own files
        first = -1
        with open(own, "wb") as data, open(own + ".entries", "wb") as entries:
            for b in batches:
                cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                for tile, run, offset, length, raw in zip(cols["tile_id"], cols["run_length"], cols["offset"], cols["length"], cols["data"]):
                    first = tile if first < 0 else first
                    entries.write(_ENTRY.pack(tile, offset, length, run))
                    if raw is not None:
                        data.write(raw)
        return _Part(first, own, own + ".entries")

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.first >= 0), key=lambda m: m.first)

        def entries() -> Iterator[Entry]:
            for p in parts:
                with open(p.entries, "rb") as f:
                    while raw := f.read(_ENTRY.size * 4096):
                        yield from (Entry(*e) for e in _ENTRY.iter_unpack(raw))

        assemble(self.path, entries(), [p.data for p in parts], ArchiveInfo.from_json(self.info))
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[_Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


@dataclass
class _Leaf(InputPartition):
    entries: list
    leaf: tuple[int, int] | None


class PMTilesReader(DataSourceReader):
    def __init__(self, path: str, raw: bool):
        self.path, self.raw = path, raw

    def partitions(self) -> list[_Leaf]:
        """One for each leaf directory, or for each thousand entries of a root without leaves."""
        a = Archive(self.path)
        root = a.root()
        tiles = [e for e in root if e.run]
        return [_Leaf([], (e.offset, e.length)) for e in root if not e.run] + [_Leaf(tiles[i : i + 1000], None) for i in range(0, len(tiles), 1000)] or [_Leaf([], None)]

    def read(self, part: _Leaf) -> Iterator[tuple]:
        a = Archive(self.path)
        found = a.entries(a.directory(a.header.leaves_offset + part.leaf[0], part.leaf[1])) if part.leaf else iter(part.entries)
        for e in found:
            data = a.data(e, self.raw)
            for tile in range(e.tile_id, e.tile_id + e.run):
                yield (tile, *zxy(tile), data)


class PMTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "tile_id bigint, z int, x bigint, y bigint, data binary"

    def reader(self, schema) -> PMTilesReader:
        return PMTilesReader(self.options["path"], self.options.get("raw", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> PMTilesWriter:
        return PMTilesWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PMTilesSource)
