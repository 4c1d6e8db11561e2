"""Sequence and structure files as Spark data sources: ``spark.read.format("fasta")`` and ``format("pdb")``.

FASTA files are read in byte ranges: a record belongs to the range in which its header begins, and is
read on across the range's end. Only the columns of the schema asked for are put together, and
filters on names are applied before a sequence is. Paths are opened by Arrow's file systems, so local
and object stores work; ``register`` makes both sources known to a session.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from seqloom.plans.shipping import ship_package

#: Bytes of a range, bytes read at once, and rows of a batch.
SPLIT_BYTES, CHUNK, BATCH = 64 << 20, 1 << 20, 4096
#: Suffixes of files that can only be read from their start.
PACKED = (".gz", ".zst", ".bz2")


def open_file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), os.path.abspath(local))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files under a folder; hidden ones and markers are left out."""
    from pyarrow import fs

    system, inside = open_file_system(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    plain = lambda p: not any(part.startswith(("_", ".")) for part in p[len(inside) :].split("/"))
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == inside or plain(f.path)))


def lines_from(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of a stream that stands at offset ``at``."""
    parts: list[bytes] = []
    while chunk := stream.read(CHUNK):
        first, *rest = chunk.split(b"\n")
        parts.append(first)
        for more in rest:
            line = b"".join(parts)
            yield at, line
            at += len(line) + 1
            parts = [more]
    if any(parts):
        yield at, b"".join(parts)


class ByteRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FileGroup(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class _Names:
    """Filters on one text column that a reader applies itself."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.taken = columns, []

    def take(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute[0] in self.columns and len(f.attribute) == 1:
                self.taken.append(f)
            else:
                yield f

    def __call__(self, row: dict) -> bool:
        for f in self.taken:
            value = row[f.attribute[0]]
            if isinstance(f, StringStartsWith):
                good = value is not None and value.startswith(f.value)
            else:
                good = value in f.value if isinstance(f, In) else value == f.value
            if not good:
                return False
        return True


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += len(row.get("sequence") or "")
        if len(waiting) == BATCH or size >= 8 * CHUNK:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


class FastaReader(DataSourceReader):
    """Records of FASTA files; see ``FastaSource``."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        kinds = {"file": pa.string(), "start": pa.int64(), "name": pa.string(), "sequence": pa.string()}
        if not set(self.columns) <= set(kinds):
            raise ValueError(f"FASTA files have the columns {sorted(kinds)}")
        self.arrow = pa.schema([(c, kinds[c]) for c in self.columns])
        self.path = options["path"]
        self.upper = options.get("upper", "true").lower() == "true"
        self.comment = options.get("comment", "#").encode()
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.names = _Names(("name",))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.names.take(filters))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in list_files(self.path):
            step = max(size, 1) if path.endswith(PACKED) else self.split
            out += [ByteRange(path, start, start + step) for start in range(0, max(size, 1), step)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(self._records(partition), self.arrow)

    def _records(self, part: ByteRange) -> Iterator[dict]:
        if not part.path:
            return
        system, inside = open_file_system(part.path)
        packed = part.path.endswith(PACKED)
        with system.open_input_stream(inside) if packed else system.open_input_file(inside) as stream:
            lines = iter(lines_from(stream, 0))
            if part.start:
                stream.seek(part.start - 1)
                lines = iter(lines_from(stream, part.start - 1))
                next(lines, None)  # what is left of a line that began before
            name, start, parts = None, 0, []
            for at, line in lines:
                header = not line.startswith(self.comment) and line.lstrip().startswith(b">")
                if header:
                    yield from self._record(part.path, start, name, parts)
                    name = None
                    if at >= part.end and not packed:
                        return
                    name, start, parts = line.strip()[1:].decode(), at, []
                elif at >= part.end and name is None and not packed:
                    return
                elif name is not None and "sequence" in self.columns and not line.startswith(self.comment):
                    parts.append(line.strip())
            yield from self._record(part.path, start, name, parts)

    def _record(self, path: str, start: int, name: str | None, parts: list[bytes]) -> Iterator[dict]:
        if name is not None and self.names({"name": name}):
            sequence = b"".join(parts).decode()
            yield {"file": path, "start": start, "name": name, "sequence": sequence.upper() if self.upper else sequence}


class FastaSource(DataSource):
    """Records (file, start, name, sequence) of FASTA files; ``start`` is the offset of a record's header.

    Options: ``upper`` (true), ``comment`` (#), ``splitBytes``. The rules of lines are those of ``read_fasta``.
    A schema given with ``.schema`` picks columns: without ``sequence`` no sequence is put together.
    Compressed files are one range each.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, start long, name string, sequence string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastaReader(schema, self.options)


_ATOM = "file string, model int, chain string, res_num int, icode string, res_name string, atom string, x double, y double, z double, b_iso double, hetero boolean, ord long"


class PdbReader(DataSourceReader):
    """Atoms of fixed-width structure files; see ``PdbSource``."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow, self.path = to_arrow_schema(schema), options["path"]
        self.first_only = options.get("firstonly", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.names = _Names(("atom", "res_name", "icode"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.names.take(filters))

    def partitions(self) -> Sequence[InputPartition]:
        groups: list[list[str]] = [[]]
        held = 0
        for path, size in list_files(self.path):
            if groups[-1] and held + size > self.split:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [FileGroup(g) for g in groups]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return _batches((row for path in partition.paths for row in self._atoms(path)), self.arrow)

    def _atoms(self, path: str) -> Iterator[dict]:
        system, inside = open_file_system(path)
        models, chain = 0, None
        with system.open_input_stream(inside) as stream:
            for number, (_, raw) in enumerate(lines_from(stream, 0)):
                kind = raw[:6].strip()
                if kind == b"MODEL":
                    models += 1
                    if models > 1 and chain is not None and self.first_only:
                        return
                elif kind in (b"ATOM", b"HETATM"):
                    line = raw.decode()
                    if chain is None:
                        chain = line[21:22]
                    row = {"atom": line[12:16].strip(), "res_name": line[17:20].strip(), "icode": line[26:27].strip()}
                    if (line[21:22] == chain or not self.first_only) and self.names(row):
                        place = {c: float(line[a : a + 8]) for c, a in (("x", 30), ("y", 38), ("z", 46))}
                        factor = line[60:66].strip()
                        yield {
                            "file": path, "model": max(models, 1), "chain": line[21:22], "res_num": int(line[22:26]), **row, **place,
                            "b_iso": float(factor) if factor else None, "hetero": kind == b"HETATM", "ord": number,
                        }


class PdbSource(DataSource):
    """Atoms of PDB files, by default (``firstOnly``) of each file's first model and its first chain.

    A file is one value of ``file`` and is read from its start, since models are counted; small files share a
    task, up to ``splitBytes``. The file is left at its second model where only the first is asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "pdb"

    def schema(self) -> str:
        return _ATOM

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdbReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, with filters handed to them."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(PdbSource)
