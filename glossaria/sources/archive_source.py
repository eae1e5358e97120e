"""Archives as a data source: each bank of each archive is a partition, read through the zip file's directory.

Neither an archive nor its media passes through one task or the driver: planning reads directories and indexes, a task
seeks to its own member. Folders and files may lie on any file system that pyarrow opens (local or shared disks, hdfs, s3).
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossaria.sources.archive import BANKS, MEDIA_TYPES, ROW, index_of

MEDIA = "dictionary string, path string, media_type string, width int, height int, content binary"
#: Rows in an Arrow batch, and bytes of media in a partition.
ROWS_AT_ONCE, MEDIA_AT_ONCE = 2000, 64 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives_at(path: str) -> list[str]:
    """Archives in a folder, or the one that is named."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type != fs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".zip"))
    scheme = path[: len(path) - len(place)] if path.endswith(place) else ""
    return [scheme + f for f in found]


def opened(path: str) -> zipfile.ZipFile:
    store, place = located(path)
    return zipfile.ZipFile(store.open_input_file(place))


@dataclass
class Member(InputPartition):
    """A bank, or so many files of media."""

    archive: str
    title: str
    version: int
    names: tuple[str, ...]
    bank: str = ""
    number: int = 0


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height by the head of a PNG, GIF, BMP or JPEG file; nothing for others and for files that are cut off."""
    try:
        if data.startswith(b"\x89PNG"):
            return struct.unpack(">II", data[16:24])
        if data.startswith(b"GIF8"):
            return struct.unpack("<HH", data[6:10])
        if data.startswith(b"BM"):
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data.startswith(b"\xff\xd8"):
            k = 2
            while data[k] == 0xFF:
                marker, size = data[k + 1], struct.unpack(">H", data[k + 2 : k + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame's header
                    height, width = struct.unpack(">HH", data[k + 5 : k + 9])
                    return width, height
                k += 2 + size
    except (struct.error, IndexError):
        pass
    return None, None


class BankReader(DataSourceReader):
    def __init__(self, path: str, banks: list[str]):
        self.path, self.wanted = path, banks

    def partitions(self) -> list[Member]:
        found = []
        for path in archives_at(self.path):
            with opened(path) as z:
                index = index_of(z)
                for name in z.namelist():
                    bank, met = next(((b, m) for b, p in BANKS.items() if (m := re.match(p, name))), (None, None))
                    if bank in self.wanted:
                        found.append(Member(path, index["title"], index["version"], (name,), bank, int(met[1])))
        return found or [Member("", "", 0, ())]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ROW.split(", ")]
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for name in partition.names:
            with opened(partition.archive) as z:
                rows = json.loads(z.read(name))
            for a in range(0, len(rows), ROWS_AT_ONCE):
                own = rows[a : a + ROWS_AT_ONCE]
                n = len(own)
                columns = ([partition.title] * n, [partition.version] * n, [partition.bank] * n, [partition.number] * n, list(range(a, a + n)), [json.dumps(r, ensure_ascii=False) for r in own])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class MediaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        found = []
        for path in archives_at(self.path):
            with opened(path) as z:
                title, held, size = index_of(z)["title"], [], 0
                for info in z.infolist():
                    if info.filename.rpartition(".")[2].lower() in MEDIA_TYPES:
                        held.append(info.filename)
                        size += info.file_size
                        if size >= MEDIA_AT_ONCE:
                            found.append(Member(path, title, 0, tuple(held)))
                            held, size = [], 0
                if held:
                    found.append(Member(path, title, 0, tuple(held)))
        return found or [Member("", "", 0, ())]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in MEDIA.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        if not partition.names:
            return
        with opened(partition.archive) as z:
            for name in partition.names:
                data = z.read(name)
                row = (partition.title, name, MEDIA_TYPES[name.rpartition(".")[2].lower()], *image_size(data), data)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


class Banks(DataSource):
    """Rows of banks; `banks` names the kinds that are read, parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "dictionary_banks"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> BankReader:
        return BankReader(self.options["path"], self.options.get("banks", ",".join(BANKS)).split(","))


class Media(DataSource):
    """Media files of archives, with the sizes of images."""

    @classmethod
    def name(cls) -> str:
        return "dictionary_media"

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"])


def banks(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """dictionary, version, bank, file_no, row_no, row (JSON) of the archives at a path: a task a bank."""
    spark.dataSource.register(Banks)
    return spark.read.format("dictionary_banks").option("banks", ",".join(kinds or BANKS)).load(path)


def index(path: str) -> dict:
    """The index of the archive at a path, with its style sheet (`styles`); nothing else of it is read."""
    with opened(path) as z:
        styles = z.read("styles.css").decode() if "styles.css" in z.namelist() else ""
        return index_of(z) | {"styles": styles}


def media(spark: SparkSession, path: str) -> DataFrame:
    """`MEDIA` of the archives at a path."""
    spark.dataSource.register(Media)
    return spark.read.format("dictionary_media").load(path)
