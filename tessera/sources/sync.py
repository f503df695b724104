"""A set of files brought into the store: one diff, one write of chunks, and scopes for directories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import first_line, language_of
from tessera.operators import writes
from tessera.operators.retrieval import INGESTED
from tessera.operators.scopes import closure
from tessera.session import cut
from tessera.sources import ingest as I


class Synced(NamedTuple):
    scopes: DataFrame
    artifacts: DataFrame
    edges: DataFrame
    stats: DataFrame
    wanted: DataFrame  # path, sig, n: the files that are stored now


def _dir(path: str = "path"):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _place(files: DataFrame, root: str, scopes: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """dir, scope of every directory of files, "" being the root; and the rows of new scopes. One
    round a level of the tree, for all of its directories at once."""
    steps = F.split(_dir(), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    dirs = cut(files.filter(_dir() != "").select(F.explode(each).alias("dir")).distinct().withColumn("depth", I.depth(F.col("dir"))))
    workspaces = scopes.filter("role = 'workspace'")
    known = level = scopes.filter(F.col("id") == root).select(F.lit("").alias("dir"), F.col("id").alias("scope"))
    made = None
    for depth in range(1, (dirs.agg(F.max("depth")).first()[0] or 0) + 1):
        title = F.element_at(F.split("dir", "/"), -1)
        asked = dirs.filter(F.col("depth") == depth).select("dir", _dir("dir").alias("up"), title.alias("title"))
        asked = asked.join(level.select(F.col("dir").alias("up"), F.col("scope").alias("parent")), "up")
        id = F.concat(F.lit(run), F.substring(F.sha2(F.concat_ws("/", F.lit(root), "dir"), 256), 1, 24))
        found = asked.join(I.directory_scopes(asked, workspaces).withColumnRenamed("scope", "old"), "dir")
        level = cut(found.select("dir", F.coalesce("old", id).alias("scope"), "parent", "title", F.col("old").isNull().alias("new")))
        known = known.union(level.select("dir", "scope"))
        rows = level.filter("new").select(F.col("scope").alias("id"), "parent", F.lit("workspace").alias("role"), "title", F.lit(1).alias("version"), F.lit(False).alias("archived"), F.current_timestamp().alias("created_at"))
        made = rows if made is None else made.union(rows)
    return known, scopes.select("id", "parent", "role", "title", "version", "archived", "created_at").limit(0) if made is None else made


def signature(sha: Column, language: Column, max_chars: int, overlap: int) -> Column:
    """What a file's chunks depend on."""
    return F.concat_ws(":", sha, language, F.lit(max_chars), F.lit(overlap))


def stored_chunks(artifacts: DataFrame, below: DataFrame) -> DataFrame:
    """id, path, chunk, sig of the documents in scopes (scope)."""
    old = artifacts.filter("kind = 'document' AND meta['path'] IS NOT NULL").join(below, "scope", "left_semi")
    return old.select("id", F.col("meta")["path"].alias("path"), F.col("meta")["chunk"].cast("int").alias("chunk"), F.col("meta")["sig"].alias("sig"))


def unread(listed: DataFrame, seen: DataFrame, chunks: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """Of listed files (path, length, modified) those that needn't be read: size and time are as seen (path,
    length, modified, sig, n), and so are the sizes of chunks; and their chunks are all stored."""
    like = F.col("sig").endswith(f":{max_chars}:{overlap}")
    known = listed.join(seen.filter(like), ["path", "length", "modified"])
    whole = I.completeness(known.select("path", "sig", "n"), chunks).filter("action = 'unchanged'")
    return known.join(whole, "path", "left_semi")


def sync(files: DataFrame, root: str, scopes: DataFrame, artifacts: DataFrame, edges: DataFrame, run: str, label: str = "", embed=None, max_chars: int = I.MAX_CHARS, overlap: int = I.OVERLAP, same: DataFrame | None = None) -> Synced:
    """Makes the documents below the scope root those of files (path, relative to it, and text).

    Files whose chunks are all stored with their signature stay; others are chunked and written
    anew; chunks of files that are gone are deleted with their edges, and so are scopes below root
    that hold nothing any more. Directories become workspace scopes, whose overview names their
    files once one of these has changed. A null text is empty and gives no chunks; of rows with one
    path the first text in order counts. run: a prefix for new ids. same (path, sig, n): further files, known to be as
    stored, which aren't read. A second run changes nothing."""
    files = files.groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("language", language_of(F.col("path")))
    files = cut(files.withColumn("sig", signature(F.sha2("text", 256), F.col("language"), max_chars, overlap)))
    pieces = cut(I.chunk(files, max_chars, overlap))
    below = closure(scopes).filter(F.col("ancestor") == root).select(F.col("descendant").alias("scope"))
    old = cut(stored_chunks(artifacts, below))
    wanted = files.select("path", "sig").join(pieces.groupBy("path").agg(F.count("*").alias("n")), "path", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    paths = files.select("path")
    if same is not None:
        wanted, paths = wanted.unionByName(same), paths.union(same.select("path"))
    wanted = cut(wanted)
    actions = cut(I.completeness(wanted, old))

    known, new_scopes = _place(paths, root, scopes, run)
    lines = F.concat_ws("-", "start_line", "end_line")
    fresh = pieces.join(actions.filter("action IN ('add', 'update')"), "path", "left_semi").join(files.select("path", "sig"), "path")
    fresh = fresh.withColumn("dir", _dir()).join(known, "dir").select(
        F.concat(F.lit(run), F.substring(F.sha2(F.concat_ws("\0", F.lit(root), "path", "chunk"), 256), 1, 24)).alias("id"), "scope", F.lit("document").alias("kind"), F.lit("worktree").alias("tier"),
        F.concat("path", F.lit(":"), lines, F.lit(" — "), first_line(F.col("text"), 80)).alias("summary"), F.col("text").alias("content"), F.array().cast("array<string>").alias("derived_from"), F.lit(False).alias("published"),
        F.create_map(F.lit("path"), "path", F.lit("lines"), lines, F.lit("chunk"), F.col("chunk").cast("string"), F.lit("sig"), "sig", F.lit("trust"), F.lit(INGESTED)).alias("meta"), F.current_timestamp().alias("created_at"),
    )
    if embed:
        fresh = fresh.withColumn("vec", embed(F.col("content")))
    fresh = cut(fresh)
    gone = cut(old.join(actions.filter("action IN ('update', 'remove')"), "path", "left_semi").select("id"))
    left, edges = writes.delete(artifacts, edges, gone)
    artifacts = left.unionByName(fresh, allowMissingColumns=True).select(artifacts.columns)

    every = scopes.unionByName(new_scopes, allowMissingColumns=True)
    tree = closure(every)
    used = tree.join(artifacts.select(F.col("scope").alias("descendant")).distinct(), "descendant").select(F.col("ancestor").alias("id")).distinct()
    dead = cut(tree.filter((F.col("ancestor") == root) & (F.col("distance") > 0)).select(F.col("descendant").alias("id")).join(used, "id", "left_anti"))
    dirty = actions.filter("action <> 'unchanged'").select(_dir().alias("dir")).distinct()
    text = F.when(F.col("dir") == "", F.concat(F.lit(f"directory {label}"), F.expr("substr(rollup_text, 11)"))).otherwise(F.col("rollup_text"))
    overview = I.directory_text(paths).join(dirty, "dir", "left_semi").join(known, "dir").select(F.col("scope").alias("id"), text.alias("_text"))
    kept = every.join(dead, "id", "left_anti").join(overview, "id", "left")
    kept = kept.withColumn("rollup_summary", F.coalesce("_text", "rollup_summary"))
    if embed:
        kept = kept.withColumn("rollup_vec", F.when(F.col("_text").isNotNull(), embed(F.col("_text"))).otherwise(F.col("rollup_vec")))

    count = {"files_added": "add", "files_updated": "update", "files_unchanged": "unchanged", "files_removed": "remove"}
    stats = actions.agg(*(F.count_if(F.col("action") == action).alias(name) for name, action in count.items()))
    for name, rows in {"chunks_added": fresh, "chunks_removed": gone, "scopes_created": new_scopes, "scopes_removed": dead}.items():
        stats = stats.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return Synced(kept.select(scopes.columns), artifacts, edges, stats, wanted)
