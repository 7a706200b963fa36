"""Members of ZIP archives as a Spark data source: tasks read the ranges of their own members, and only of those a query asks for.

    zip_members.register(spark)
    tiles = spark.read.format("zip_members").option("path", uri).option("index", folder).options(
        names=r"(?P<scan>\\d+)\\.tif_M(?P<month>\\d{2})\\.png$", columns="scan string, month int").load()
    tiles.where("scan = '700412' AND month IN (2, 3)")

Filters on a member's name, its size and the columns taken from its name are answered from the archive's directory: what
they leave out is never read. Filters on the content go back to Spark.
"""

from __future__ import annotations

import hashlib
import operator
import re
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

_ENTRY = ("name", "at", "packed", "size", "method", "crc")
_COMPARED = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
}
_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType()}


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(ZipMembers)


@dataclass
class Members(ds.InputPartition):
    """(values of the columns but content, where the local header begins, packed and whole size, method, checksum) of each member."""

    entries: list[tuple[tuple, int, int, int, int, int]]


class ZipMembers(ds.DataSource):
    """name, size, content, and a column for each named group of `names`, of an archive's members.

    Options: path (a URI); suffix and pattern, which names must end with and match; names, a regular expression that names
    must match, and columns, the declared types (string, int, bigint) of its named groups; partition_bytes (64 MB) of
    packed members in a partition, one member at least, or members, so many; index, a folder for the directories of
    archives, by path, size and time of change: an archive's directory is read once, then its index; retries (4) of a
    range that cannot be read, with doubled pauses from `pause` seconds (0.5) on. Sizes and checksums are verified.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        own = StructType().add("name", StringType()).add("size", LongType())
        for column in filter(None, map(str.strip, self.options.get("columns", "").split(","))):
            name, _, kind = column.rpartition(" ")
            if kind not in _TYPES:
                raise ValueError(f"{column}: a column of a name is a string, an int or a bigint")
            own = own.add(name.strip(), _TYPES[kind])
        return own.add("content", BinaryType())

    def reader(self, schema) -> ds.DataSourceReader:
        return ZipReader(self.options, self.schema())


def _test(f: ds.Filter, known: set[str]) -> Callable[[dict], bool | None] | None:
    """A filter as a function of a row, with SQL's three values; None if the directory cannot answer it."""
    if isinstance(f, ds.Not):
        inner = _test(f.child, known)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    if len(f.attribute) != 1 or f.attribute[0] not in known:
        return None
    name = f.attribute[0]
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return lambda row: (row[name] is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return lambda row: row[name] == f.value
    if isinstance(f, ds.In):
        return lambda row: None if row[name] is None or (None in f.value and row[name] not in f.value) else row[name] in f.value
    compare = _COMPARED.get(type(f))
    return compare and (lambda row: None if row[name] is None or f.value is None else compare(row[name], f.value))


class ZipReader(ds.DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.uri, self.index = options["path"], options.get("index")
        self.suffix, self.pattern, self.names = options.get("suffix", ""), options.get("pattern", ""), options.get("names", "")
        self.columns = {f.name: str if f.dataType == StringType() else int for f in schema if f.name not in ("name", "size", "content")}
        unknown = set(self.columns) - set(re.compile(self.names).groupindex)
        if unknown:
            raise ValueError(f"names has no group {sorted(unknown)[0]!r}")
        self.order = [f.name for f in schema if f.name != "content"]
        self.members, self.bytes = options.get("members"), int(options.get("partition_bytes", 64 << 20))
        self.retries, self.pause = int(options.get("retries", 4)), float(options.get("pause", 0.5))
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _test(f, {*self.order}) is None:
                yield f
            else:
                self.tests.append(f)

    def _tried(self, read: Callable[[], bytes]) -> bytes:
        for k in range(self.retries + 1):
            try:
                return read()
            except OSError:
                if k == self.retries:
                    raise
                time.sleep(self.pause * 2**k)

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        return store.open_input_file(path)  # seeks become ranged reads

    def _listed(self) -> list[tuple]:
        with self._open() as f, zipfile.ZipFile(f) as z:
            return [
                (i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()
            ]

    def directory(self) -> list[tuple]:
        """(name, where its local header begins, packed and whole size, method, checksum) of each member, from the index if it has been written."""
        if not self.index:
            return self._tried(self._listed)
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(path)
        key = hashlib.sha256(f"{self.uri} {info.size} {info.mtime_ns}".encode()).hexdigest()
        kept, folder = fs.FileSystem.from_uri(self.index)
        at = f"{folder}/{key}.parquet"
        if kept.get_file_info(at).type == fs.FileType.File:
            return list(zip(*pq.read_table(at, filesystem=kept).to_pydict().values(), strict=True))
        found = self._tried(self._listed)
        kept.create_dir(folder, recursive=True)
        own = f"{folder}/.{key}-{uuid.uuid4().hex}"
        pq.write_table(
            pa.Table.from_pylist(
                [dict(zip(_ENTRY, e, strict=True)) for e in found],
                schema=pa.schema([("name", pa.string()), *((c, pa.int64()) for c in _ENTRY[1:])])
            ),
            own,
            filesystem=kept
        )
        kept.move(own, at)  # whole or not at all; of several writers any one's stands
        return found

    def _asked_for(self) -> Iterator[tuple[tuple, tuple]]:
        tests = [_test(f, {*self.order}) for f in self.tests]
        for entry in self.directory():
            name = entry[0]
            match = re.search(self.names, name)
            if not name.endswith(self.suffix) or not re.search(self.pattern, name) or match is None:
                continue
            row = {"name": name, "size": entry[3]} | {c: None if match[c] is None else cast(match[c]) for c, cast in self.columns.items()}
            if all(t(row) for t in tests):
                yield tuple(row[c] for c in self.order), entry[1:]

    def partitions(self) -> list[Members]:
        """The archive's directory is read here, once; tasks only get the ranges of their members, which lie in the order of the archive."""
        out, size = [Members([])], 0
        for values, rest in sorted(self._asked_for(), key=lambda e: e[1][0]):
            own = out[-1].entries
            if own and (len(own) >= int(self.members) if self.members else size + rest[1] > self.bytes):
                out.append(Members([]))
                own, size = out[-1].entries, 0
            own.append((values, *rest))
            size += rest[1]
        return out

    def _range(self, at: int, n: int) -> bytes:
        with self._open() as f:
            f.seek(at)
            return f.read(n)

    def read(self, partition: Members) -> Iterator[tuple]:
        for values, at, packed, size, method, crc in partition.entries:
            name = values[self.order.index("name")]
            head = self._tried(  # a local header: its name and extra field may differ in length from the directory's
                partial(self._range, at, 30)
            )
            data = self._tried(
                partial(self._range, at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), packed)
            )
            if method == zipfile.ZIP_DEFLATED:
                data = zlib.decompress(data, -15)
            elif method != zipfile.ZIP_STORED:
                raise ValueError(f"{name}: compression method {method} is not supported")
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError(f"{name}: size or checksum do not match the directory")
            yield (*values, data)
