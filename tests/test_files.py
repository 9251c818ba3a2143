"""The data source of file pieces against hashlib."""

import hashlib
import os

import pytest

from parchment.plans import catalog
from parchment.sources import pieces

SF = "/root/testdata/sf0.001"


def digests(path):
    with open(path, "rb") as f:
        data = f.read()
    return len(data), hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest()


def test_digests_of_the_tables(spark):
    got = {r.name: (r.size, r.md5, r.sha256) for r in catalog.QUERIES["s9_file_digests"](spark, SF).collect()}
    assert got == {n: digests(f"{SF}/{n}") for n in os.listdir(SF)}
    assert all(r.complete for r in catalog.QUERIES["s9_file_digests"](spark, SF).collect())


def test_pieces_of_a_file_of_several(spark, tmp_path):
    data = os.urandom(2 * pieces.PIECE + 5)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    got = sorted(map(tuple, catalog.QUERIES["s8_file_pieces"](spark, str(tmp_path)).collect()))
    want = [("a/big", k, k * pieces.PIECE, len(p), hashlib.md5(p).hexdigest()) for k, p in enumerate((data[: pieces.PIECE], data[pieces.PIECE : 2 * pieces.PIECE], data[2 * pieces.PIECE :]))]
    assert got == [*want, ("empty", 0, 0, 0, hashlib.md5(b"").hexdigest())]
    one = pieces.file_pieces(spark, f"file://{tmp_path}/a/big", "files").collect()
    assert [(r.size, r.pieces, r.md5) for r in one] == [(len(data), 3, hashlib.md5(data).hexdigest())]


def test_names_choose_files_before_they_are_read(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_bytes(n.encode())
    reader = pieces._Reader(str(tmp_path), True)
    df = pieces.file_pieces(spark, str(tmp_path), "files")
    assert [r.name for r in df.filter("name = 'b'").collect()] == ["b"] and df.filter("name in ('a', 'c') and size = 1").count() == 2 and df.filter("name = 'z'").count() == 0
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("name",), "b"), GreaterThan(("size",), 0)]))
    assert len(left) == 1 and [p.name for p in reader.partitions()] == ["b"]
    with pytest.raises(Exception, match="nowhere"):
        pieces.file_pieces(spark, str(tmp_path / "nowhere")).collect()
