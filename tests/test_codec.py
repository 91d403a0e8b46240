from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import namespace


def test_packed_records(spark):
    df = spark.createDataFrame([(1, 2**62 + 5, 2**33), (255, 256, 7)], "id bigint, off bigint, size bigint")
    packed = [r.b for r in df.select(codec.pack(F.col("id"), F.col("off"), F.col("size")).alias("b")).collect()]
    assert bytes(packed[1]) == (255).to_bytes(8, "little") + (256).to_bytes(8, "little") + (7).to_bytes(4, "little")
    both = spark.createDataFrame([(bytearray(packed[0] + packed[1]),), (bytearray(b"short"),), (bytearray(),)], "b binary")
    got = [r.r for r in both.select(codec.unpack(F.col("b")).alias("r")).collect()]
    assert [tuple(map(int, x)) for x in got[0]] == [(1, 2**62 + 5, 2**32 - 1), (255, 256, 7)]
    assert got[1] is None and got[2] == []


def test_paths_survive_cycles_and_hard_links(spark):
    rows = [(1, "a", 2, 1), (2, "f", 9, 0), (1, "g", 9, 0), (7, "x", 8, 1), (8, "y", 7, 1)]
    dentry = spark.createDataFrame(rows, "parent bigint, name string, inode bigint, type int")
    got = namespace.paths_up(dentry, dentry.select("inode"), max_depth=5).collect()
    assert sorted((r.inode, r.path) for r in got) == [(2, "/a"), (9, "/a/f"), (9, "/g")]
    asked = spark.createDataFrame([("/a/f",), ("/g/f",), ("/",)], "path string")
    assert sorted((r.path, r.inode) for r in namespace.walk(dentry, asked).collect()) == [("/", 1), ("/a/f", 9), ("/g/f", None)]


def test_paths_of_any_depth(spark):
    rows = [(i, f"d{i}", i + 1, 1) for i in range(1, 67)] + [(200, "x", 201, 1), (201, "y", 200, 1)]
    dentry = spark.createDataFrame(rows, "parent bigint, name string, inode bigint, type int").coalesce(1).cache()
    asked = spark.sql("select cast(67 as bigint) as inode union all select 201")
    path = "".join(f"/d{i}" for i in range(1, 67))
    assert [(r.inode, r.path) for r in namespace.paths_up(dentry, asked).collect()] == [(67, path)]
    assert [r.inode for r in namespace.walk(dentry, spark.createDataFrame([(path,)], "path string")).collect()] == [67]
