"""Filters that reach the archive's directory: what they leave out is not read."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.sources import zip_members
from tracewright.sources.zip_members import ZipMembers

NAMES = r"sheet_(?P<scan>\d+)\.tif_M(?P<month>\d{2})(?P<part>[a-z])?\.png$"
COLUMNS = "scan string, month int, part string"


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """500 members, and the place of each one's bytes."""
    path = tmp_path_factory.mktemp("zip") / "tiles.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(500):
            z.writestr(
                f"tiles/sheet_{9000 + k // 12}.tif_M{k % 12 + 1:02}{'a' if k % 5 == 0 else ''}.png", f"member {k} ".encode() * (k % 7 + 1)
            )
        z.writestr("readme.txt", b"no tile")
    return path


def spoiled(archive, tmp_path, keep):
    """A copy in which every member's bytes are wrong but those of `keep`: whoever reads another one fails."""
    raw = bytearray(archive.read_bytes())
    with zipfile.ZipFile(archive) as z:
        for i in z.infolist():
            if i.filename not in keep:
                raw[i.header_offset + 30 + len(i.filename)] ^= 0xFF
    out = tmp_path / "spoiled.zip"
    out.write_bytes(raw)
    return out


def load(spark, path, **options):
    zip_members.register(spark)
    return spark.read.format("zip_members").option("path", f"file://{path}").options(
        **{"names": NAMES, "columns": COLUMNS} | options
    ).load()


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("name IN ('tiles/sheet_9000.tif_M03.png', 'tiles/sheet_9041.tif_M02.png')", 2),
        ("scan = '9003' AND month IN (2, 5)", 2),
        ("scan = '9003' AND month > 11", 1),
        ("scan = '9003' AND month >= 11 AND NOT (month = 12)", 1),
        ("startswith(name, 'tiles/sheet_9002') AND name LIKE '%M04.png'", 1),
        ("scan = '9000' AND part IS NULL AND month <= 3", 2),
        ("scan = '9000' AND part <=> 'a' AND month < 7", 2),
        ("scan = '9000' AND part = 'a'", 3),
        ("scan = '9000' AND NOT (part = 'b')", 3),
        ("size = 63 AND scan = '9005' AND name LIKE '%M0%'", None),
        ("scan = 'none'", 0),
    ],
)
def test_only_what_filters_ask_for_is_read(spark, archive, tmp_path, where, n):
    rows = load(spark, archive).withColumn("content", F.col("content").cast("string")).collect()
    whole = spark.createDataFrame(rows, "name string, size long, scan string, month int, part string, content string")
    want = sorted((r.name, r.content) for r in whole.where(where).collect())
    assert n is None or len(want) == n
    found = load(spark, spoiled(archive, tmp_path, {name for name, _ in want}), members=3).where(where)
    assert sorted((r.name, bytes(r.content).decode()) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() == max(1, -(-len(want) // 3))


def test_other_filters_go_back_to_spark(spark, archive):
    found = load(spark, archive).where(
        "content = CAST('member 17 member 17 member 17 member 17 ' AS binary) AND (month = 6 OR scan = '1') AND upper(part) IS NULL"
    )
    assert [(r.scan, r.month, r.part) for r in found.collect()] == [("9001", 6, None)]
    assert load(spark, archive).where("month = 6 AND length(content) > 40").count() == sum(
        1 for k in range(5, 500, 12) if len(f"member {k} " * (k % 7 + 1)) > 40
    )
    assert load(spark, archive).count() == 500 and load(spark, archive, names="", columns="").count() == 501


def reader(path, **options):
    source = ZipMembers({"path": f"file://{path}", "names": NAMES, "columns": COLUMNS} | options)
    return source.reader(source.schema())


def test_partitions_follow_bytes(archive):
    parts = reader(archive, partition_bytes="1000").partitions()
    packed = [sum(e[2] for e in p.entries) for p in parts]
    assert max(packed) <= 1000 and min(packed[:-1]) > 900 and sum(len(p.entries) for p in parts) == 500
    assert [len(p.entries) for p in reader(archive, partition_bytes="1").partitions()] == [1] * 500
    assert [len(p.entries) for p in reader(archive).partitions()] == [500]


def test_the_directory_is_read_once(archive, tmp_path, monkeypatch):
    index = f"file://{tmp_path}/index"
    listed = []
    own = zip_members.ZipReader._listed
    monkeypatch.setattr(zip_members.ZipReader, "_listed", lambda self: listed.append(self.uri) or own(self))
    first, second = (reader(archive, index=index).directory() for _ in range(2))
    assert first == second and len(listed) == 1 and [p.name.startswith(".") for p in (tmp_path / "index").iterdir()] == [False]
    changed = tmp_path / "changed.zip"
    changed.write_bytes(archive.read_bytes())
    assert reader(changed, index=index).directory() == first and len(listed) == 2
    with zipfile.ZipFile(changed, "a") as z:
        z.writestr("sheet_1.tif_M01.png", b"new")
    assert len(reader(changed, index=index).directory()) == len(first) + 1 and len(listed) == 3


def test_ranges_are_tried_again(archive, monkeypatch):
    r, failed = reader(archive, retries="2", pause="0"), []
    own = zip_members.ZipReader._range

    def shaky(self, at, n):
        if len(failed) < 2:
            failed.append(at)
            raise OSError("try later")
        return own(self, at, n)

    monkeypatch.setattr(zip_members.ZipReader, "_range", shaky)
    part = reader(archive, members="1").partitions()[0]
    assert next(r.read(part))[-1] == b"member 0 " and len(failed) == 2
    failed.clear()
    with pytest.raises(OSError):
        next(reader(archive, retries="1", pause="0").read(part))


def test_what_cannot_be_declared_is_refused(archive):
    with pytest.raises(ValueError, match="no group 'year'"):
        reader(archive, columns="year int")
    with pytest.raises(ValueError, match="an int or a bigint"):
        reader(archive, columns="month double")
