"""Text into chunks, and a directory of files against what is stored of it."""

from __future__ import annotations

import os
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

MAX_CHARS, OVERLAP, MAX_FILE = 1500, 200, 512 << 10
#: Characters of texts whose chunks a task holds before it passes them on.
HELD_CHARS = 1 << 20
#: Fixed values, which results depend on: sizes above, directories that a walk leaves out, starts of units.
SKIPPED = (".git", "node_modules", "vendor", "bin", "dist", "build", ".venv", "venv", "__pycache__", ".idea", ".vscode")
#: How a line at column 0 begins a unit, by language, and what above it belongs to the unit.
UNIT_STARTS = {
    "go": ("func ", "func(", "type ", "var ", "const ", "import (", 'import "'),
    "python": ("def ", "class ", "async def "),
    "markdown": ("#",),
    "jsts": ("function ", "class ", "export ", "const ", "let ", "async ", "interface ", "type ", "enum ", "abstract "),
}
LEADS = {"go": ("//",), "python": ("@", "#"), "jsts": ("//", "/*", "*", "@")}

Piece = tuple[str, int, int]


_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _limits(max_chars: int, overlap: int) -> tuple[int, int]:
    most = max_chars if max_chars > 0 else MAX_CHARS
    return most, overlap if 0 <= overlap < most else OVERLAP


def _offsets(lines: list[str]) -> list[int]:
    """Bytes before each line, and before the end: every line with its line feed."""
    return [0, *accumulate(len(x.encode()) + 1 for x in lines)]


def _piece(lines: list[str], a: int, b: int, shift: int = 0) -> list[Piece]:
    text = "\n".join(lines[a:b]).rstrip("\n")
    return [(text, a + 1 + shift, b + shift)] if text.strip(_WHITE) else []


def window_chunks(lines: list[str], max_chars: int, overlap: int, shift: int = 0) -> list[Piece]:
    """Whole lines up to max_chars bytes; the next window begins about overlap bytes back. Empty
    lines at a window's beginning belong to it, but not to its text."""
    most, overlap = _limits(max_chars, overlap)
    offsets, n, at, out = _offsets(lines), len(lines), 0, []
    while at < n:
        first = next((k for k in range(at, n) if lines[k]), n)
        end = n if first == n else max(first + 1, bisect_right(offsets, offsets[first] + most + 1) - 1)
        out += [(text, at + 1 + shift, to) for text, _, to in _piece(lines, first, end, shift)]
        # The first line whose distance to the end is below the overlap.
        back = bisect_right(offsets, offsets[end] - overlap) if overlap else end
        at = n if end == n else max(back, at + 1)
    return out


def unit_starts(lines: list[str], language: str) -> list[int]:
    if language == "generic":
        return [k for k in range(1, len(lines)) if lines[k].strip() and not lines[k - 1].strip()]
    found = set()
    for k, line in enumerate(lines):
        if line.startswith(UNIT_STARTS[language]):
            while k > 0 and lines[k - 1].startswith(LEADS.get(language, ("\0",))):
                k -= 1
            found.add(k)
    return sorted(found - {0})


def semantic_chunks(text: str, language: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[Piece]:
    """Whole units (functions, headings, paragraphs) packed up to max_chars bytes; a larger unit by windows."""
    most, overlap = _limits(max_chars, overlap)
    lines = text.split("\n")
    offsets, bounds = _offsets(lines), [0, *unit_starts(lines, language), len(lines)]
    ends, out, unit = [offsets[k] for k in bounds], [], 0
    while unit < len(bounds) - 1:
        # The last bound that the text from this unit on reaches within the limit.
        to = bisect_right(ends, ends[unit] + most + 1, lo=unit + 1) - 1
        a = bounds[unit]
        if to == unit:
            to = unit + 1
            out += window_chunks(lines[a : bounds[to]], most, overlap, a)
        else:
            out += _piece(lines, a, bounds[to])
        unit = to
    return out


def chunk(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, semantic: bool = True) -> DataFrame:
    """files (path, text, language) as path, chunk, start_line, end_line, text."""

    def passed_on(rows):
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "chunk", "start_line", "end_line", "text"])

    def run(batches):
        """A text at a time; chunks are passed on when they hold HELD_CHARS."""
        out, held = [], 0
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                text = row["text"] or ""
                found = semantic_chunks(text, row["language"], max_chars, overlap) if semantic else window_chunks(text.split("\n"), max_chars, overlap)
                out += ((row["path"], k, start, end, piece) for k, (piece, start, end) in enumerate(found))
                held += len(text)
                if out and held >= HELD_CHARS:
                    yield passed_on(out)
                    out, held = [], 0
        if out:
            yield passed_on(out)

    return files.select("path", "text", "language").mapInArrow(run, "path string, chunk int, start_line int, end_line int, text string")


LISTED = "path string, length long, modified long"


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), length, modified (ns) of the files below root, which all executors must see
    under this path. Directories of the skip list aren't entered, links aren't followed, and no file is
    opened. One round a level of the tree, for all of its directories at once."""

    def children(batches):
        for batch in batches:
            rows = []
            for dir in batch["dir"]:
                with os.scandir(os.path.join(root, dir)) as entries:
                    for entry in entries:
                        path = f"{dir}/{entry.name}" if dir else entry.name
                        if entry.is_dir(follow_symlinks=False):
                            if entry.name not in SKIPPED and not entry.name.startswith(".tessera"):
                                rows.append((path, True, 0, 0))
                        elif entry.is_file(follow_symlinks=False):
                            held = entry.stat(follow_symlinks=False)
                            rows.append((path, False, held.st_size, held.st_mtime_ns))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "modified"])

    level, found = spark.createDataFrame([("",)], "dir string"), []
    while not level.isEmpty():
        rows = cut(level.repartition("dir").mapInPandas(children, "path string, is_dir boolean, length long, modified long"))
        found.append(rows.filter("NOT is_dir").drop("is_dir"))
        level = rows.filter("is_dir").select(F.col("path").alias("dir"))
    return reduce(DataFrame.unionByName, found)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """path, text of files (path, length) below root that are small and text; one that has gone since it
    was listed gives no row, and what isn't UTF-8 is replaced."""

    def contents(batches):
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read(MAX_FILE + 1)
                except FileNotFoundError:
                    continue
                if len(data) <= MAX_FILE and b"\0" not in data[:8192]:
                    rows.append((path, data.decode("utf-8", "replace")))
                if len(rows) == 64:
                    yield pd.DataFrame(rows, columns=["path", "text"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "text"])

    return files.filter(F.col("length") <= MAX_FILE).select("path").repartition("path").mapInPandas(contents, "path string, text string")


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the files below root that are small, text, and not in a skipped directory."""
    return read_files(list_directory(spark, root), root)


def reconcile(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """path, action (add, update, unchanged, remove) of files by content signature (path, sig).
    A file without text counts as unchanged when first seen."""
    new, old = wanted.select("path", F.col("sig").alias("new"), F.col("blank")), stored.select("path", F.col("sig").alias("old"))
    action = F.when(F.col("new").isNull(), "remove").when(F.col("old").isNull(), F.when(F.col("blank"), "unchanged").otherwise("add")).when(F.col("new") != F.col("old"), "update").otherwise("unchanged")
    return new.join(old, "path", "full_outer").select("path", action.alias("action"))


def completeness(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, action of files (path, sig, n: chunks they give) by stored chunks (path, chunk, sig): a
    file is unchanged only if its chunks 0 .. n - 1 are all there once with its signature, so what
    was written in part is written again."""
    stored = chunks.groupBy("path").agg(F.count("*").alias("rows"), F.countDistinct("chunk").alias("kinds"), F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.min("sig").alias("sig1"), F.max("sig").alias("sig2"))
    n, rows = F.col("n"), F.col("rows")
    whole = (rows == n) & (F.col("kinds") == n) & (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("sig1") == F.col("sig")) & (F.col("sig2") == F.col("sig"))
    action = F.when(n.isNull(), "remove").when(rows.isNull(), F.when(n == 0, "unchanged").otherwise("add")).when(F.coalesce(whole, F.lit(False)), "unchanged").otherwise("update")
    return wanted.join(stored, "path", "full_outer").select("path", action.alias("action"))


def statistics(actions: DataFrame) -> DataFrame:
    """action, files: how many files a run adds, updates, leaves and removes."""
    return actions.groupBy("action").agg(F.count("*").alias("files"))


def depth(path: Column) -> Column:
    """Steps of a relative path; 0 for the root itself."""
    return F.when(path.isin("", "."), 0).otherwise(F.size(F.split(path, "/")))


def directory_scopes(dirs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Of directories (dir, parent: a scope, title) the child scope of that title that each reuses, the
    one with the least id; null where one has to be made."""
    known = scopes.groupBy("parent", "title").agg(F.min("id").alias("scope"))
    return dirs.join(known, ["parent", "title"], "left").select("dir", "scope")


def contained(root: str, target: str) -> str:
    """The real path of target; ValueError if links or dots lead it out of root."""
    base, path = os.path.realpath(root), os.path.realpath(os.path.join(root, target))
    if os.path.commonpath([base, path]) != base:
        raise ValueError(f"{target} lies outside of {root}")
    return path


def directory_text(files: DataFrame) -> DataFrame:
    """dir, rollup_text: the overview text of each directory. Names are sorted and joined by ranges of
    all names, so that no task sorts a large directory; its ranges are then put one after the other."""
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    ranged = parts.repartitionByRange("dir", "name").withColumn("range", F.spark_partition_id())
    joined = ranged.groupBy("dir", "range").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    runs = F.array_sort(F.collect_list(F.struct("range", "names")))
    return joined.groupBy("dir").agg(runs.alias("runs")).select("dir", F.concat(F.lit("directory "), "dir", F.lit("; files: "), F.array_join("runs.names", ", ")).alias("rollup_text"))
