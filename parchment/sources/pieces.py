"""Files as a table of pieces, or of digests, read in ranges: a Python data source."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a piece, and pieces that one partition reads, one at a time.
PIECE, RUN = 1 << 20, 64


@dataclass
class Range(InputPartition):
    """Pieces `first` to `last` of a file, without the last; all of it for a digest."""

    path: str
    name: str
    size: int
    first: int
    last: int

    def __post_init__(self):
        super().__init__(self.name)


def _open(path: str):
    """(file system, path in it) of a local path or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole, self.names = path, whole, None

    def pushFilters(self, filters):
        """Files are chosen by name before any is opened; other conditions are left to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("name",) else set(f.value) if isinstance(f, In) and f.attribute == ("name",) else None
            if wanted is None:
                yield f
            else:
                self.names = wanted if self.names is None else self.names & wanted

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            name = i.base_name if info.is_file else i.path[len(root.rstrip("/")) + 1 :]
            if self.names is not None and name not in self.names:
                continue
            pieces = max(1, -(-i.size // PIECE))
            where = self.path if info.is_file else f"{self.path.rstrip('/')}/{name}"
            out += [Range(where, name, i.size, a, min(a + RUN, pieces)) for a in range(0, pieces, RUN)] if not self.whole else [Range(where, name, i.size, 0, pieces)]
        return out or [Range("", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        with system.open_input_file(path) as file:
            md5, sha = hashlib.md5(), hashlib.sha256()
            file.seek(partition.first * PIECE)
            for k in range(partition.first, partition.last):
                data = file.read(PIECE)
                if self.whole:
                    md5.update(data), sha.update(data)
                else:
                    yield partition.name, k, k * PIECE, len(data), hashlib.md5(data).hexdigest()
            if self.whole:
                yield partition.name, partition.size, partition.last, md5.hexdigest(), sha.hexdigest()


class FilePieces(DataSource):
    """`file_pieces`: with the option `digest` of `pieces` (default) a row for each MiB of each file below the path, with its own MD5, dealt out in
    runs; of `files` a row for each file, with MD5 and SHA-256 of all of it, a MiB in memory at a time."""

    @classmethod
    def name(cls) -> str:
        return "file_pieces"

    def _whole(self) -> bool:
        return self.options.get("digest", "pieces") == "files"

    def schema(self) -> str:
        return "name string, size long, pieces long, md5 string, sha256 string" if self._whole() else "name string, piece long, start long, size long, md5 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._whole())


def file_pieces(spark, path: str, digest: str = "pieces"):
    """The pieces or digests of the files below a path; conditions on `name` choose files before they are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilePieces)
    return spark.read.format("file_pieces").option("digest", digest).load(path)
