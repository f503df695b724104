"""A store on disk as a log of writes: a segment for each batch, snapshots, contents out of line.

Folder of a log: commits (a row for each finished write) and a folder for each segment and snapshot.
A segment's rows are whole rows (put), columns of stored rows (patch) or tombstones (delete). What a
version holds is its last snapshot with the segments since then; both are one scan each however many
writes there were, and only the segments are grouped by key. Rows of the snapshot meet the changed
keys in one join, which broadcasts them while they are few.

A write that breaks off leaves a folder without a commit row, which nothing reads. One writer at a
time. Old versions stay readable; their files are never deleted here."""

from __future__ import annotations

from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators import writes
from tessera.session import cut, plain_unions
from tessera.sources import blobs
from tessera.spec import Detail, QuerySpec
from tessera.store import ARTIFACTS, CONFIG, EDGES, FILES, SCOPES, TRACES, VISIBLE, MemoryStore, new_id

COMMITS = "first long, version long, snapshot boolean, folder string, tables array<string>"
#: The log's tables, the keys of their rows, and the columns that a patch may set (never to null).
TABLES = {
    "scopes": (SCOPES, ["id"], ["seed_from", "archived", "rollup_summary", "rollup_vec"]),
    "artifacts": (ARTIFACTS.replace("content string", "hash string"), ["id"], ["published", "superseded_by"]),
    "edges": (EDGES, ["from_id", "to_id", "kind"], []),
    "traces": (TRACES, ["query_id"], []),
    "visible": (VISIBLE, ["query_id", "id"], []),
    "config": (CONFIG, ["key"], []),
    "files": (FILES, ["root", "path"], []),
    "blobs": ("hash string, body binary", ["hash"], []),
}
_MARKS = "_op string, _version long"


def fold(rows: DataFrame, key: list[str], patched: list[str]) -> DataFrame:
    """One row of rows (with _op, _version) for each key, which stands for all of them: the last put or
    delete, with what later patches set; patches alone give a patch."""
    rest = [c for c in rows.columns if c not in key and c != "_version"]
    whole, at = F.col("_op") != "patch", F.col("_version")
    aggregates = [F.max_by(F.struct(*rest), F.when(whole, at)).alias("_row"), F.max(F.when(whole, at)).alias("_whole"), F.max(at).alias("_version")]
    for c in patched:
        when = F.when(~whole & F.col(c).isNotNull(), at)
        aggregates += [F.max_by(c, when).alias(f"_to_{c}"), F.max(when).alias(f"_at_{c}")]
    last = rows.groupBy(*key).agg(*aggregates)
    newer = lambda c: F.col(f"_at_{c}") > F.coalesce("_whole", F.lit(-1))
    value = {c: F.col(f"_row.{c}") for c in rest}
    value |= {c: F.when(newer(c), F.col(f"_to_{c}")).otherwise(value[c]) for c in patched}
    value |= {"_op": F.coalesce(value["_op"], F.lit("patch"))}
    return last.select(*key, *(value[c].alias(c) for c in rest), "_version").select(rows.columns)


class StoreLog:
    """The verbs take frames, so that a batch of any size is one write, and give the new version."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None, embed=None, reranker=None, merge_every: int = 32):
        self.spark, self.path, self.key, self.embed, self.reranker, self.merge_every = spark, path.rstrip("/"), key, embed, reranker, merge_every
        self._commits: list = []
        plain_unions(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options) -> StoreLog:
        """A new log; with a key its contents and summaries are sealed (titles, vectors and meta aren't)."""
        log = cls(spark, path, **options)
        log._record(0, 0, True, "", [])
        plain = MemoryStore.empty(spark, embed=log.embed)
        config = plain.remember_model() if log.key is None else plain.remember_model().lock(log.key)
        if config is not plain:
            log._write(config=config.config)
        return log

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> StoreLog:
        """ValueError if the log is sealed with another key, or has none and one is given, or holds vectors of
        another embedder."""
        log = cls(spark, path, **options)
        log.refresh()
        store = log.store()
        store.unlock(log.key)
        store.remember_model()
        return log

    def refresh(self) -> None:
        """Sees what others have written."""
        self._commits = sorted(self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect(), key=lambda c: c["version"])

    @property
    def version(self) -> int:
        return self._commits[-1]["version"]

    def _record(self, *row) -> None:
        self.spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self._commits = sorted([*self._commits, Row("first", "version", "snapshot", "folder", "tables")(*row)], key=lambda c: c["version"])

    def parts(self, version: int | None = None) -> tuple[object, list]:
        """The commits that a version is read from: its snapshot, and segments that follow each other."""
        version = self.version if version is None else version
        if not self._commits[0]["version"] <= version <= self.version:
            raise LookupError(f"no version {version}")
        base = max((c for c in self._commits if c["snapshot"] and c["version"] <= version), key=lambda c: c["version"])
        at, chain = base["version"], []
        while at < version:
            chain.append(max((c for c in self._commits if not c["snapshot"] and c["first"] == at + 1 and c["version"] <= version), key=lambda c: c["version"]))
            at = chain[-1]["version"]
        return base, chain

    def _scan(self, name: str, commits: list, marks: bool) -> DataFrame:
        schema = TABLES[name][0] + (f", {_MARKS}" if marks else "")
        folders = [f"{self.path}/{c['folder']}/{name}" for c in commits if name in c["tables"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        _, key, patched = TABLES[name]
        base, chain = self.parts(version)
        rows, tail = self._scan(name, [base], False), self._scan(name, chain, True)
        if not any(name in c["tables"] for c in chain):
            return rows
        if name == "blobs":  # written once for each hash and never changed
            return rows.unionByName(tail.select(rows.columns))
        last = fold(tail, key, patched)
        if name not in base["tables"]:
            return last.filter("_op = 'put'").select(rows.columns)
        changes = last.select(*key, "_op", *(F.col(c).alias(f"_to_{c}") for c in patched))
        old = rows.join(changes, key, "left").filter("_op IS NULL OR _op = 'patch'")
        old = old.select(*(F.coalesce(f"_to_{c}", c).alias(c) if c in patched else c for c in rows.columns))
        return old.unionByName(last.filter("_op = 'put'").select(rows.columns))

    def _write(self, **changes: DataFrame) -> int:
        """One commit of changes by table: whole rows, or rows with _op, which lack the columns they don't set."""
        version = self.version + 1
        folder = f"v{version:012d}-{uuid4().hex[:8]}"
        for name, rows in changes.items():
            rows = rows if "_op" in rows.columns else rows.withColumn("_op", F.lit("put"))
            empty = self.spark.createDataFrame([], f"{TABLES[name][0]}, _op string")
            rows = empty.unionByName(rows, allowMissingColumns=True).select(empty.columns)
            rows.withColumn("_version", F.lit(version).cast("long")).write.option("compression", "zstd").parquet(f"{self.path}/{folder}/{name}")
        self._record(version, version, False, folder, list(changes))
        if len(self.parts()[1]) >= self.merge_every:
            self.merge()
        return version

    def merge(self) -> None:
        """The segments since the snapshot as one; as a new snapshot once they hold a quarter of its rows."""
        base, chain = self.parts()
        names = sorted({name for c in chain for name in c["tables"]})
        held, new = (sum(self._scan(n, commits, False).count() for n in names) for commits in ([base], chain))
        if 4 * new >= held:
            self.compact()
        elif len(chain) > 1:
            folder = f"m{self.version:012d}-{uuid4().hex[:8]}"
            for name in names:
                rows = self._scan(name, chain, True)
                (rows if name == "blobs" else fold(rows, *TABLES[name][1:])).write.option("compression", "zstd").parquet(f"{self.path}/{folder}/{name}")
            self._record(chain[0]["first"], self.version, False, folder, names)

    def compact(self) -> None:
        """The present version as a snapshot, from which later versions are read."""
        base, chain = self.parts()
        if chain:
            names, folder = sorted({*base["tables"], *(n for c in chain for n in c["tables"])}), f"s{self.version:012d}-{uuid4().hex[:8]}"
            for name in names:
                self.table(name).write.option("compression", "zstd").parquet(f"{self.path}/{folder}/{name}")
            self._record(self.version, self.version, True, folder, names)

    def _sealed(self, text, aad):
        return text.cast("binary") if self.key is None else blobs.seal(text, F.lit(self.key), aad)

    def _opened(self, body, aad):
        return (body if self.key is None else blobs.unseal(body, F.lit(self.key), aad)).cast("string")

    def contents(self, artifacts: DataFrame, version: int | None = None) -> DataFrame:
        """artifacts with the content of their hash, null where there is none."""
        found = self.table("blobs", version).withColumnRenamed("hash", "_hash")
        joined = artifacts.join(found, F.col("hash") == F.col("_hash"), "left")
        return joined.withColumn("content", self._opened(F.col("body"), F.col("hash"))).drop("_hash", "body")

    def artifacts(self, version: int | None = None) -> DataFrame:
        rows = self.table("artifacts", version)
        return rows if self.key is None else rows.withColumn("summary", self._opened(F.unbase64("summary"), F.col("id")))

    def store(self, version: int | None = None, contents: bool = False) -> MemoryStore:
        """The store as of a version, to be queried; contents are null unless asked for."""
        rows = self.artifacts(version)
        rows = self.contents(rows, version) if contents else rows.withColumn("content", F.lit(None).cast("string"))
        names = [x.strip().split(" ")[0] for x in ARTIFACTS.split(", ")]
        scopes, edges, traces, visible, config, files = (self.table(n, version) for n in ("scopes", "edges", "traces", "visible", "config", "files"))
        return MemoryStore(self.spark, scopes, rows.select(names), edges, traces, visible, config, files, embed=self.embed, reranker=self.reranker)

    def query(self, queries: DataFrame, spec: QuerySpec, version: int | None = None) -> DataFrame:
        """MemoryStore.query; contents are read for word ranks and rerankers, else for raw hits alone."""
        if spec.mode == "hybrid" or spec.rerank or spec.auto_rerank:
            return self.store(version, contents=True).query(queries, spec)
        hits = self.store(version).query(queries, spec)
        if spec.detail < Detail.RAW:
            return hits
        hashes = self.table("artifacts", version).select("id", "hash")
        return self.contents(hits.drop("content").join(hashes, "id"), version).drop("hash").select(hits.columns)

    def drill(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """The artifacts of ids (id) with their contents; ids that aren't stored give no row."""
        return self.contents(self.artifacts(version).join(ids.select("id").distinct(), "id", "left_semi"), version)

    def _known(self, table: str, ids: DataFrame) -> None:
        if not (lost := ids.join(self.table(table).select("id"), "id", "left_anti").take(1)) == []:
            raise LookupError(f"no {lost[0]['id']}")

    def create_scopes(self, scopes: DataFrame) -> int:
        """Scopes (id, parent, role, title); parents may be in the same batch."""
        fixed = scopes.withColumns({"version": F.lit(1), "archived": F.lit(False), "created_at": F.lit(datetime.now(UTC))})
        every = self.table("scopes").select("id").union(scopes.select("id"))
        if not scopes.filter("parent IS NOT NULL").join(every.select(F.col("id").alias("parent")), "parent", "left_anti").isEmpty():
            raise LookupError("a parent that doesn't exist")
        return self._write(scopes=fixed)

    def push(self, requests: DataFrame) -> int:
        """Artifacts (scope, summary; id, kind, tier, content, derived_from, supersedes, published, meta,
        trust, vec where given). A batch that names an unknown scope or artifact, or has an empty
        summary, is refused whole. A null content has no blob; an equal content is stored once. Of
        several artifacts that supersede one, the one with the greatest id does. Requests with ids of their
        own are read several times, so that their contents are kept nowhere else, and must be the same each
        time; others get ids and are cut, sealed if the log is."""
        none = F.array().cast("array<string>")
        usual = {"id": F.concat(F.lit(new_id()[:14]), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)), "kind": F.lit(None).cast("string"), "tier": F.lit(None).cast("string"), "content": F.lit(None).cast("string"), "derived_from": none, "supersedes": none, "published": F.lit(False), "meta": F.lit(None).cast("map<string,string>"), "trust": F.lit("")}
        rows = requests.withColumns({c: v for c, v in usual.items() if c not in requests.columns})
        if "vec" not in rows.columns:
            rows = rows.withColumn("vec", self.embed(F.col("summary")) if self.embed else F.lit(None).cast("array<float>"))
        rows = rows.withColumns({"hash": F.sha2("content", 256), "meta": writes.trust(F.col("meta"), F.col("trust")), "blank": F.trim(F.coalesce("summary", F.lit(""))) == ""})
        rows = rows.withColumn("body", self._sealed(F.col("content"), F.col("hash")))
        if self.key is not None:
            rows = rows.withColumn("summary", F.base64(self._sealed(F.col("summary"), F.col("id"))))
        rows = rows.select("id", "scope", "kind", "tier", "summary", "hash", "body", "vec", "derived_from", F.coalesce("supersedes", none).alias("supersedes"), F.coalesce("published", F.lit(False)).alias("_published"), "meta", "blank")
        if "id" not in requests.columns:
            rows = cut(rows)
        scopes = rows.select(F.lit("scope").alias("what"), F.col("scope").alias("id")).join(self.table("scopes").select("id"), "id", "left_anti")
        stored = self.table("artifacts").select("id").union(rows.select("id"))
        targets = rows.select(F.lit("artifact").alias("what"), F.explode("supersedes").alias("id")).join(stored, "id", "left_anti")
        wrong = rows.filter("blank").select(F.lit("summary").alias("what"), "id").unionByName(scopes).unionByName(targets).take(1)
        if wrong and wrong[0]["what"] == "summary":
            raise ValueError("empty summary")
        if wrong:
            raise LookupError(f"no {wrong[0]['what']} {wrong[0]['id']}")
        puts, marks = writes.push(rows.drop("body", "blank"), None)
        puts = puts.withColumns({"published": F.col("_published"), "created_at": F.lit(datetime.now(UTC)), "_op": F.lit("put")}).drop("_published")
        # A row of this very batch that another one replaces is written as replaced.
        both = puts.join(marks, "id", "left")
        patches = marks.join(rows.select("id"), "id", "left_anti").withColumn("_op", F.lit("patch"))
        fresh = blobs.new_blobs(rows.filter("hash IS NOT NULL").select("hash", "body"), self.table("blobs"))
        return self._write(artifacts=both.unionByName(patches, allowMissingColumns=True), blobs=fresh)

    def supersede(self, pairs: DataFrame) -> int:
        """Pairs (id, superseded_by); of several for one id the greatest counts."""
        self._known("artifacts", pairs.select("id").union(pairs.select("superseded_by")))
        if not pairs.filter("id = superseded_by").isEmpty():
            raise ValueError("an artifact can't supersede itself")
        return self._write(artifacts=pairs.groupBy("id").agg(F.max("superseded_by").alias("superseded_by")).withColumn("_op", F.lit("patch")))

    def publish(self, ids: DataFrame) -> int:
        self._known("artifacts", ids.select("id"))
        return self._write(artifacts=ids.select("id", F.lit(True).alias("published"), F.lit("patch").alias("_op")).distinct())

    def relate(self, edges: DataFrame) -> int:
        """Edges (from_id, to_id, kind), each stored once."""
        ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id"))
        self._known("artifacts", ends)
        if not edges.filter("from_id = to_id OR kind IS NULL OR kind = ''").isEmpty():
            raise ValueError("an edge needs two artifacts and a kind")
        return self._write(edges=edges.select("from_id", "to_id", "kind").distinct().withColumn("created_at", F.lit(datetime.now(UTC))))

    def delete(self, ids: DataFrame) -> int:
        """Artifacts (id) and their edges go."""
        self._known("artifacts", ids.select("id"))
        gone, edges = ids.select("id").distinct(), self.table("edges").select("from_id", "to_id", "kind")
        cut_off = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_semi")).distinct()
        return self._write(artifacts=gone.withColumn("_op", F.lit("delete")), edges=cut_off.withColumn("_op", F.lit("delete")))

    def set_config(self, values: dict[str, str]) -> int:
        return self._write(config=self.spark.createDataFrame(list(values.items()), CONFIG))
