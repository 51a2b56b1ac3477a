"""A data source of gzip uploads: small files are packed into partitions by bytes and unpacked under two limits.

    spark.dataSource.register(GzipUploads)
    spark.read.format("gzip_uploads").option("maxUncompressed", 1 << 30).load(folder)

A file is unpacked piece by piece and first only counted, so a refused one never takes more memory than a piece, whatever
it unpacks to; a file of more than ``maxBytes`` isn't even opened. Accepted ones are unpacked again as rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import list_files, open_store, packed

PIECE = 1 << 20
SCHEMA = "path string, key string, size bigint, refused string, uncompressed bigint, content string"
_FIELDS = pa.schema([("path", pa.string()), ("key", pa.string()), ("size", pa.int64()), ("refused", pa.string()), ("uncompressed", pa.int64()), ("content", pa.string())])
#: Bytes of content that one batch of rows holds on average at most.
_BATCH = 16 << 20


class Refused(ValueError):
    """Why an upload isn't taken: not_gzip, too_large or too_large_uncompressed."""


def pieces(source: BinaryIO, most: int, plain: bool = False) -> Iterator[bytes]:
    """The unpacked pieces of a file; with ``plain`` one that doesn't start like gzip data is taken as it is. May raise Refused."""
    head = source.read(PIECE)
    if not plain or head.startswith(b"\x1f\x8b"):
        yield from unpacked(source, most, head)
        return
    total = 0
    while head:
        total += len(head)
        if total > most:
            raise Refused("too_large_uncompressed")
        yield head
        head = source.read(PIECE)


def unpacked(source: BinaryIO, most: int, rest: bytes = b"") -> Iterator[bytes]:
    """The pieces of gzip data, member after member; raises Refused when it isn't whole and sound or has over ``most`` bytes.

    ``rest``: what was read of it already.
    """
    total, ended = 0, False
    while True:
        rest = rest or source.read(PIECE)
        if ended:
            # zeros may stand behind a member, and another member
            rest = rest.lstrip(b"\0")
            if not rest:
                if not (rest := source.read(PIECE)):
                    return
                continue
        elif not rest:
            raise Refused("not_gzip")
        unpack, ended = zlib.decompressobj(wbits=31), False
        try:
            while not unpack.eof:
                if not rest and not (rest := source.read(PIECE)):
                    raise Refused("not_gzip")
                piece = unpack.decompress(rest, PIECE)
                total += len(piece)
                if total > most:
                    raise Refused("too_large_uncompressed")
                rest = unpack.unconsumed_tail or unpack.unused_data
                if piece:
                    yield piece
        except zlib.error:
            raise Refused("not_gzip") from None
        ended = True


def verdict(source: BinaryIO, most: int, plain: bool = False) -> tuple[str | None, int]:
    """(why refused or None, unpacked bytes counted so far) without keeping any of them."""
    total = 0
    try:
        for piece in pieces(source, most, plain):
            total += len(piece)
    except Refused as why:
        return str(why), total
    return None, total


class PackedFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class GzipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}
        self.path = get["path"]
        self.max_bytes = int(get.get("maxbytes", 256 << 20))
        self.max_uncompressed = int(get.get("maxuncompressed", 1 << 30))
        self.target = int(get.get("partitionbytes", 64 << 20))
        self.open_cost = int(get.get("opencost", 64 << 10))
        self.with_content = get.get("content", "true").lower() == "true"
        self.plain = get.get("plain", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [PackedFiles(group) for group in packed(list_files(self.path), self.target, self.open_cost)]

    def read(self, partition: PackedFiles | None) -> Iterator[pa.RecordBatch]:
        # without any file Spark asks for one partition that is None
        store, _ = open_store(self.path)
        rows, held = [], 0
        for path, size in partition.files if partition is not None else ():
            content = None
            if size > self.max_bytes:
                refused, counted = "too_large", None
            else:
                with store.open_input_stream(path, compression=None) as source:
                    refused, counted = verdict(source, self.max_uncompressed, self.plain)
                if refused is None and self.with_content:
                    with store.open_input_stream(path, compression=None) as source:
                        content = b"".join(pieces(source, self.max_uncompressed, self.plain)).decode("utf-8", "replace")
                        held += counted
            rows.append((path, path.rsplit("/", 1)[-1].split(".", 1)[0], size, refused, counted, content))
            if held > _BATCH or len(rows) >= 10_000:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


class GzipUploads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GzipReader(self.options)


def read_gzip(spark: SparkSession, path: str, **options: int | bool) -> DataFrame:
    """path, key (name up to the first dot), size, refused, uncompressed and content of every file below ``path``.

    refused: null, ``not_gzip`` (no whole and sound gzip data), ``too_large`` (packed) or ``too_large_uncompressed``; such
    rows have no content. Options: maxBytes, maxUncompressed, partitionBytes, openCost, content (false: verdicts only), plain
    (true: files that don't start like gzip data are taken as they are).
    Bytes that aren't UTF-8 become replacement characters. A folder without files gives no rows.
    """
    spark.dataSource.register(GzipUploads)
    return spark.read.format("gzip_uploads").options(**{k: str(v).lower() for k, v in options.items()}).load(path)
