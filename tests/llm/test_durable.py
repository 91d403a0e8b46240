from pathlib import Path

from tidemark.llm import durable


def test_saved_tables_are_read_back_and_cleared(spark):
    table = durable.save(spark.range(3), "t")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2]
    kept = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
    durable.release(spark)
    assert all(f.exists() for f in kept) and Path(durable.folder(spark).removeprefix("file://")) in kept[0].parents
    assert durable.clear(spark) >= 1 and durable.clear(spark) == 0 and not any(f.exists() for f in kept)
