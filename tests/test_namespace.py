from tidemark.operators import namespace

TREE = "parent bigint, name string, inode bigint, type int"


def _kept(monkeypatch):
    """Counts of the rows that namespace writes."""
    counts, keep = [], namespace.keep

    def counted(rows, name):
        counts.append((name, rows.count()))
        return keep(rows, name)

    monkeypatch.setattr(namespace, "keep", counted)
    return counts


def test_walk_writes_directories_and_not_paths(spark, monkeypatch):
    files = [(3, f"f{i}", 100 + i, 0) for i in range(50)]
    dentry = spark.createDataFrame([(1, "a", 2, 1), (2, "b", 3, 1), *files], TREE).coalesce(1)
    asked = [(f"/a//b/f{i}",) for i in range(50)] + [("/a/b/f1/x",), ("/a/c",), ("/",), (None,)]
    counts = _kept(monkeypatch)
    got = {r.path: (r.inode, r.type) for r in namespace.walk(dentry, spark.createDataFrame(asked, "path string")).collect()}
    want = {f"/a//b/f{i}": (100 + i, 0) for i in range(50)} | {"/a/b/f1/x": (None, None), "/a/c": (None, None), "/": (1, 1), None: (None, None)}
    assert got == want
    assert sum(n for _, n in counts) < 25


def test_paths_of_all_entries(spark):
    rows = [(1, "a", 2, 1), (2, "f", 9, 0), (1, "g", 9, 0), (1, "g", 9, 0), (7, "x", 8, 1), (8, "y", 7, 1), (2, "up", 1, 1)]
    dentry = spark.createDataFrame(rows, TREE).coalesce(1)
    every = sorted((r.inode, r.path) for r in namespace.paths_up(dentry).collect())
    assert every == sorted((r.inode, r.path) for r in namespace.paths_up(dentry, dentry).collect()) == [(1, "/"), (2, "/a"), (9, "/a/f"), (9, "/g")]


def test_resolve_deals_paths_by_their_number(spark, monkeypatch):
    dentry = spark.createDataFrame([(1, "a", 2, 1), *[(2, f"f{i}", 100 + i, 0) for i in range(40)], (1, "to", 50, 2)], TREE).coalesce(1)
    targets = spark.createDataFrame([(50, "/a")], "inode bigint, target string")
    asked = spark.createDataFrame([(f"/{d}/f{i}",) for d in ("a", "to") for i in range(40)] * 2, "path string")
    plans, keep = [], namespace.keep
    monkeypatch.setattr(namespace, "TASK_PATHS", 50, raising=False)
    monkeypatch.setattr(namespace, "keep", lambda rows, name: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), keep(rows, name))[1])
    got = {(r.path, r.inode, r.outcome) for r in namespace.resolve(dentry, targets, asked).collect()}
    assert got == {(f"/{d}/f{i}", 100 + i, "ok") for d in ("a", "to") for i in range(40)}
    assert any("REPARTITION_BY_NUM" in p for p in plans)
