"""Files read by place: what is needed of a large file is read, payloads stay behind as ranges until something asks for them.

A range is (path, offset, length).  Paths are those of any file system that pyarrow opens (local ones, file:, s3:, hdfs:, gs:).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.kernels import containers, files, tiff
from tessera.sources import media

BLOCK = 1 << 20
RANGE = "path string, offset long, length long"
LAZY_PART = "seq int, kind string, type string, offset long, size long, deferred boolean"


def open_file(path: str):
    """A random-access file; bare paths are local ones."""
    if "://" in path or path.startswith("file:"):
        system, own = fs.FileSystem.from_uri(path)
    else:
        system, own = fs.LocalFileSystem(), path
    return system.open_input_file(own)


class Source:
    """Bytes of a file by place, read in blocks of which the last one is kept."""

    def __init__(self, path: str) -> None:
        self.file = open_file(path)
        self.size = self.file.size()
        self.at, self.held, self.read_bytes = 0, b"", 0

    def __call__(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        if not (self.at <= offset and offset + length <= self.at + len(self.held)):
            self.held = self.file.read_at(max(length, min(4096, self.size - offset)), offset)
            self.at = offset
            self.read_bytes += len(self.held)
        return self.held[offset - self.at : offset - self.at + length]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def lazy_parts(source: Source) -> Iterator[tuple[int, str, str, int, int, bool]]:
    """(seq, kind, type, offset of the payload, size, deferred): heads are read, pixels and media are only placed."""
    head = source(0, 32)
    kind = containers.detect(head)
    if kind == "jpeg":
        at, seq = 2, 0
        while at + 4 <= source.size:
            mark = source(at, 4)
            if mark[0] != 0xFF:
                raise containers.Malformed(f"no marker at {at}")
            if mark[1] in (0xDA, 0xD9):
                break
            if mark[1] == 0xFF:
                at += 1
                continue
            size = struct.unpack(">H", mark[2:])[0]
            start = source(at + 4, min(size - 2, 40))
            own = next((k for m, x, k in containers.JPEG_KINDS if m == mark[1] and start.startswith(x)), "segment")
            yield seq, own, f"{mark[1]:02X}", at + 4, size - 2, False
            at, seq = at + 2 + size, seq + 1
        yield seq, "scan", "DA", at, source.size - at, True
    elif kind == "png":
        at, seq = 8, 0
        while at + 12 <= source.size:
            size, name = struct.unpack(">I4s", source(at, 8))
            yield seq, "chunk", name.decode("latin-1"), at + 8, size, name in (b"IDAT", b"fdAT")
            at, seq = at + 12 + size, seq + 1
            if name == b"IEND":
                break
    elif kind in ("webp", "avi"):
        at, seq = 12, 0
        while at + 8 <= source.size:
            name, size = struct.unpack("<4sI", source(at, 8))
            form = source(at + 8, 4) if name == b"LIST" else b""
            yield seq, "list" if form else "chunk", (form or name).decode("latin-1"), at + 8, size, name[:3] == b"VP8" and name != b"VP8X" or form == b"movi"
            at, seq = at + 8 + size + size % 2, seq + 1
    elif kind in ("bmff", "jxl") and head[:2] != b"\xff\x0a":
        at, seq = 0, 0
        while at + 8 <= source.size:
            size, name = struct.unpack(">I4s", source(at, 8))
            skip = 16 if size == 1 else 8
            size = struct.unpack(">Q", source(at + 8, 8))[0] if size == 1 else size or source.size - at
            if size < skip or at + size > source.size:
                break
            yield seq, "box", name.decode("latin-1"), at + skip, size - skip, name in (b"mdat", b"jxlc", b"jxlp")
            at, seq = at + size, seq + 1
    elif kind == "gif":
        at, seq = 13 + (3 << (head[10] & 7) + 1 if head[10] & 128 else 0), 0
        while at < source.size and (mark := source(at, 10))[:1] != b"\x3b":
            frame = mark[:1] == b"\x2c"
            if mark[:1] not in (b"\x21", b"\x2c"):
                raise containers.Malformed(f"unknown block {mark[0]:02X} at {at}")
            body = at + (11 + (3 << (mark[9] & 7) + 1 if mark[9] & 128 else 0) if frame else 2)
            end = body
            while end < source.size and (n := source(end, 1)[0]):
                end += 1 + n
            yield seq, "frame" if frame else "extension", f"{mark[0] if frame else mark[1]:02X}", body, end - body + 1, frame
            at, seq = end + 1, seq + 1
    else:
        raise containers.Malformed("format not recognised")


def lazy_tags(source: Source, max_tag: int = 16 << 20):
    """Entries and warnings of a TIFF file's directories, tables and values alone being read."""
    return tiff.scan(source, source.size, max_tag)


def scan_parts(paths: DataFrame) -> DataFrame:
    """(path, seq, kind, type, offset, size, deferred, error) of rows(path); a file's payloads are not read."""

    def rows(path: str):
        with Source(path) as source:
            return ([dict(zip(("seq", "kind", "type", "offset", "size", "deferred"), p, strict=True)) for p in lazy_parts(source)],)

    made = media.mapped(paths, ["path"], rows, f"parts array<struct<{', '.join(x.replace(' ', ':') for x in LAZY_PART.split(', '))}>>")
    return made.select("path", F.explode_outer("parts").alias("p"), "error").select("path", "p.*", "error")


TAGS = "tags array<struct<ifd:string,tag:int,type:int,count:long,offset:long,text:string>>, read_bytes long"


def _tags_at(path: str, max_tag: int):
    with Source(path) as source:
        entries, _ = lazy_tags(source, max_tag)
        return [{"ifd": e.ifd, "tag": e.tag, "type": e.type, "count": len(e.values), "offset": e.offset, "text": e.values.rstrip(b"\0").decode("utf-8", "replace") if isinstance(e.values, bytes) else None} for e in entries], source.read_bytes


def _tag_rows(made: DataFrame) -> DataFrame:
    return made.select("path", "read_bytes", F.explode_outer("tags").alias("t"), "error").select("path", "t.*", "read_bytes", "error")


def scan_tags(paths: DataFrame, max_tag: int = 16 << 20) -> DataFrame:
    """(path, ifd, tag, type, count, offset, text, read_bytes, error) of TIFF files of any size; read_bytes says how much was read."""
    return _tag_rows(media.mapped(paths, ["path"], lambda path: _tags_at(path, max_tag), TAGS))


def scan_saved(rows: DataFrame, folder: str, pieces: Callable[[bytes], Iterator] = lambda content: iter([content]), max_tag: int = 16 << 20) -> DataFrame:
    """scan_tags() of files that are not saved yet: of rows(path, content), pieces(content) is saved in the folder whole, read by
    place and removed, a file after another, so that the folder never holds more than a file a task."""

    def run(_: str, content: bytes):
        path = f"{folder}/{uuid.uuid4().hex}"  # of this attempt only
        try:
            save_bytes(path, pieces(content))
            return _tags_at(path, max_tag)
        finally:
            system, own = target_of(path)
            if system.get_file_info(own).type != fs.FileType.NotFound:
                system.delete_file(own)

    return _tag_rows(media.mapped(rows, ["path", "content"], run, TAGS))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges(path, offset, length) with data: the bytes, for what has been chosen."""

    def rows(path: str, offset: int, length: int):
        with open_file(path) as file:
            return (file.read_at(length, offset),)

    return media.mapped(ranges, ["path", "offset", "length"], rows, "data binary", ["path", "offset", "length"])


def copy_range(source: str, offset: int, length: int, target, block: int = BLOCK) -> int:
    """Copies a range into an open file a block at a time, and gives the number of bytes."""
    done = 0
    with open_file(source) as file:
        while done < length:
            data = file.read_at(min(block, length - done), offset + done)
            if not data:
                break
            target.write(data)
            done += len(data)
    return done


def target_of(path: str):
    system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, own


def save_bytes(path: str, pieces: Iterator[bytes | tuple[str, int, int]]) -> int:
    """Writes pieces (bytes, or ranges that are copied in blocks) beside the path and moves them over it when all is written, so
    that a reader sees the old file or the new one.  A task that is run twice writes the same file twice."""
    system, own = target_of(path)
    beside, size = f"{own}.{uuid.uuid4().hex[:8]}.part", 0
    try:
        with system.open_output_stream(beside) as out:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    size += len(piece)
                else:
                    size += copy_range(*piece, out)
        system.move(beside, own)
    except BaseException:
        if system.get_file_info(beside).type != fs.FileType.NotFound:
            system.delete_file(beside)
        raise
    return size


def save(rows: DataFrame) -> DataFrame:
    """rows(path, content): each file saved at its path; (path, size, error)."""
    return media.mapped(rows, ["path", "content"], lambda path, content: (save_bytes(path, iter([content])),), "size long")


def streamed(source: str, target: str, changes: dict[str, bytes | None]) -> int:
    """A large JPEG with carriers set or removed: the changed head is composed, the scan is copied from the old file in blocks."""
    with Source(source) as own:
        scan = next(p for p in lazy_parts(own) if p[5])
        head = own.file.read_at(scan[3], 0)
    if containers.detect(head) != "jpeg":
        raise files.NoHome("only the head of a JPEG lies before its pixels")
    for carrier, value in changes.items():
        head = files.put(head, carrier, value)
    return save_bytes(target, iter([head, (source, scan[3], scan[4])]))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        system, own = target_of(self.path)
        found = system.get_file_info(fs.FileSelector(own, recursive=True)) if system.get_file_info(own).type == fs.FileType.Directory else [system.get_file_info(own)]
        prefix = self.path[: len(self.path) - len(own)] if self.path.endswith(own) else ""
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition):
        try:
            with Source(partition.path) as source:
                for row in lazy_parts(source):
                    yield (partition.path, *row, None)
        except media.ERRORS as e:
            yield (partition.path, *[None] * 6, str(e))


class MediaRanges(DataSource):
    """spark.read.format("media_ranges").load(folder): the parts of files by place, a partition a file, payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "media_ranges"

    def schema(self) -> str:
        return f"path string, {LAZY_PART}, error string"

    def reader(self, schema):
        return _Reader(self.options["path"])
