"""A directory on disk as a source, and overviews of large directories."""

import os

from pyspark.sql import functions as F

from tessera.sources import ingest
from tessera.store import MemoryStore


def test_only_changed_files_are_opened(spark, tmp_path):
    top = tmp_path / "work"
    for name, text in {"a.md": b"alpha one", "_b/__init__.py": b"def f():\n  pass", "_b/.hidden": b"dot", "node_modules/x.js": b"no", ".git/config": b"no", "deep/er/c.md": b"gamma", "empty.md": b""}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(text)
    (top / "large.md").write_bytes(b"x" * (ingest.MAX_FILE + 1))
    (top / "just.md").write_bytes(b"y" * ingest.MAX_FILE)
    (top / "binary.md").write_bytes(b"a\0b")
    (top / "late.md").write_bytes(b"z" * 8192 + b"\0")
    (top / "bytes.md").write_bytes(b"caf\xe9")
    (top / "link").symlink_to(tmp_path)
    read = {r["path"]: r["text"] for r in ingest.read_directory(spark, str(top)).collect()}
    assert set(read) == {"a.md", "_b/__init__.py", "_b/.hidden", "deep/er/c.md", "empty.md", "just.md", "late.md", "bytes.md"} and read["bytes.md"] == "caf�"

    root, stats, store = MemoryStore.empty(spark).ingest_directory(str(top))
    assert store.get_scope(root)["title"] == "work" and (stats["files_added"], stats["files_unchanged"]) == (7, 1)
    # Another text with the same size and time: nothing shows that it has changed, so it isn't opened.
    held = (top / "a.md").stat()
    (top / "a.md").write_bytes(b"omega two")
    os.utime(top / "a.md", ns=(held.st_atime_ns, held.st_mtime_ns))
    again, stats, store = store.ingest_directory(str(top))
    text = lambda s: s.artifacts.filter("meta['path'] = 'a.md'").first()["content"]
    assert again == root and stats["files_updated"] == 0 and stats["files_unchanged"] == 8 and text(store) == "alpha one"
    # A later time, a lost chunk, a file that is gone; all else stays unread.
    os.utime(top / "a.md", ns=(held.st_atime_ns, held.st_mtime_ns + 1))
    (top / "deep/er/c.md").unlink()
    store = store.delete_artifact(store.artifacts.filter("meta['path'] = '_b/.hidden'").first()["id"])
    store.save(str(tmp_path / "saved"))
    store = MemoryStore.load(spark, str(tmp_path / "saved"))
    again, stats, store = store.ingest_directory(str(top))
    assert again == root and [stats[f"files_{x}"] for x in ("added", "updated", "removed", "unchanged")] == [1, 1, 1, 5] and text(store) == "omega two"
    assert "deep" not in {r["title"] for r in store.scopes.collect()} and store.get_scope(root)["rollup_summary"].startswith("directory work; files: a.md, ")


def test_overview_of_a_large_directory(spark):
    n = 300_000
    files = spark.range(n).select(F.concat(F.when(F.col("id") % 100 == 0, "small/").otherwise("large/"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("path"))
    got = {r["dir"]: r["rollup_text"] for r in ingest.directory_text(files.union(files.limit(0))).collect()}
    for dir, small in (("small", True), ("large", False)):
        assert got[dir] == f"directory {dir}; files: " + ", ".join(f"{k:07d}" for k in range(n) if (k % 100 == 0) == small)
    few = spark.createDataFrame([("b",), ("x/a",), ("a",), ("a",)], "path string")
    assert {r["dir"]: r["rollup_text"] for r in ingest.directory_text(few).collect()} == {"": "directory ; files: a, a, b", "x": "directory x; files: a"}
    assert ingest.directory_text(few.limit(0)).isEmpty()
