"""A memory store: an immutable bundle of frames; every write verb returns a new store."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, lexical, retrieval, writes
from tessera.operators import scopes as S
from tessera.operators.evaluation import conformal_floor
from tessera.session import cut
from tessera.sources import blobs, sync
from tessera.sources.ingest import MAX_CHARS, OVERLAP, list_directory, read_files
from tessera.spec import QuerySpec, resolve_floors

SCOPES = "id string, parent string, role string, title string, version int, seed_from string, archived boolean, forked_from string, created_at timestamp, rollup_summary string, rollup_vec array<float>"
ARTIFACTS = "id string, scope string, kind string, tier string, summary string, content string, vec array<float>, derived_from array<string>, published boolean, meta map<string,string>, created_at timestamp, superseded_by string"
EDGES = "from_id string, to_id string, kind string, created_at timestamp"
TRACES = "query_id string, scope string, text string, created_at timestamp"
VISIBLE = "query_id string, id string, rank int"
CONFIG = "key string, value string"
FILES = "root string, path string, length long, modified long, sig string, n long"
_TABLES = {"scopes": SCOPES, "artifacts": ARTIFACTS, "edges": EDGES, "traces": TRACES, "visible": VISIBLE, "config": CONFIG, "files": FILES}


_ids, _last = Lock(), [0, 0]


def new_id() -> str:
    """Ids sort by time, and those of one process in the order in which they were made."""
    with _ids:
        now = int(datetime.now(UTC).timestamp() * 1000)
        _last[:] = [now, 0] if now > _last[0] else [_last[0] + _last[1] // 0xFFFF, _last[1] % 0xFFFF + 1]
        return f"{_last[0]:013d}-{_last[1]:04x}{uuid4().hex[:8]}"


@dataclass(frozen=True)
class MemoryStore:
    spark: SparkSession
    scopes: DataFrame
    artifacts: DataFrame
    edges: DataFrame
    traces: DataFrame
    visible: DataFrame
    config: DataFrame
    files: DataFrame
    embed: object = None
    reranker: object = None
    _closure: list = field(default_factory=list, compare=False)
    _index: list = field(default_factory=list, compare=False)

    @classmethod
    def empty(cls, spark: SparkSession, embed=None, reranker=None) -> MemoryStore:
        return cls(spark, *(spark.createDataFrame([], schema) for schema in _TABLES.values()), embed=embed, reranker=reranker)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed=None, reranker=None) -> MemoryStore:
        """The snapshot that the last save finished; ValueError if another embedder made its vectors."""
        last = spark.read.parquet(f"{path}/commits").agg(F.max("snapshot")).first()[0]
        store = cls(spark, *(spark.read.schema(schema).parquet(f"{path}/snapshot={last}/{name}") for name, schema in _TABLES.items()), embed=embed, reranker=reranker)
        store.remember_model()
        return store

    def save(self, path: str) -> str:
        """All tables as a new snapshot; it counts once its commit row is written."""
        snapshot, store = new_id(), self.remember_model()
        for name in _TABLES:
            getattr(store, name).write.option("compression", "zstd").parquet(f"{path}/snapshot={snapshot}/{name}")
        self.spark.createDataFrame([(snapshot,)], "snapshot string").write.mode("append").parquet(f"{path}/commits")
        return snapshot

    def _rows(self, schema: str, **values) -> DataFrame:
        names = [x.strip().split(" ")[0] for x in schema.split(", ")]
        return self.spark.createDataFrame([tuple(values.get(n) for n in names)], schema)

    def _has(self, table: DataFrame, id: str) -> None:
        if table.filter(F.col("id") == id).isEmpty():
            raise LookupError(f"no {id}")

    def remember_model(self) -> MemoryStore:
        """The store with its embedder's name (its attribute model, if it has one) in config; ValueError if
        config holds another one, since vectors of two models can't be compared."""
        model = getattr(self.embed, "model", "")
        held = self.get_config("emb_model") if model else None
        if held is not None and held != model:
            raise ValueError(f"a store of {held} can't be used with {model}")
        return self.set_config("emb_model", model) if model and held is None else self

    def _guard(self, rows: DataFrame, column: str) -> None:
        """Refuses vectors of another length than the stored ones: they would all score 0."""
        size = lambda df, c: (r := df.filter(F.col(c).isNotNull()).select(F.size(c)).first()) and r[0]
        if (new := size(rows, column)) and (old := size(self.artifacts, "vec")) and new != old:
            raise ValueError(f"a vector of {new} numbers, but the store's have {old}")

    def create_scope(self, parent: str | None, role: str, title: str) -> tuple[str, MemoryStore]:
        if parent is not None:
            self._has(self.scopes, parent)
        id = new_id()
        row = self._rows(SCOPES, id=id, parent=parent, role=role, title=title, version=1, archived=False, created_at=datetime.now(UTC))
        return id, replace(self, scopes=self.scopes.union(row), _closure=[])

    def push(self, scope: str, summary: str, kind: str = "insight", tier: str = "workspace", content: str | None = None, derived_from=(), supersedes=(), relations=(), meta=None, trust: str = "", published: bool = False, embed_text: str | None = None) -> tuple[str, MemoryStore]:
        """relations: (target, kind) pairs; embed_text: what the vector is made of, if not the summary."""
        self._has(self.scopes, scope)
        if not summary.strip():
            raise ValueError("empty summary")
        for target in {*supersedes, *(t for t, _ in relations)}:
            self._has(self.artifacts, target)
        id, now = new_id(), datetime.now(UTC)
        lineage = list(dict.fromkeys(x for x in (*derived_from, *supersedes) if x))
        row = self._rows(ARTIFACTS, id=id, scope=scope, kind=kind, tier=tier, summary=summary, content=content, derived_from=lineage, published=published, meta=meta, created_at=now)
        if self.embed:
            row = row.withColumn("vec", self.embed(F.lit(embed_text or summary)))
            self._guard(row.select("vec"), "vec")
        row = row.withColumn("meta", writes.trust(F.col("meta"), F.lit(trust)))
        old = self.artifacts.withColumn("superseded_by", F.when(F.col("id").isin(*supersedes), id).otherwise(F.col("superseded_by"))) if supersedes else self.artifacts
        store = replace(self, artifacts=old.unionByName(row))
        for target, relation in relations:
            store = store.relate(id, target, relation)
        return id, store

    def supersede(self, old: str, new: str) -> MemoryStore:
        if old == new:
            raise ValueError("an artifact can't supersede itself")
        self._has(self.artifacts, old), self._has(self.artifacts, new)
        return replace(self, artifacts=self.artifacts.withColumn("superseded_by", F.when(F.col("id") == old, new).otherwise(F.col("superseded_by"))))

    def publish(self, id: str) -> MemoryStore:
        self._has(self.artifacts, id)
        return replace(self, artifacts=self.artifacts.withColumn("published", (F.col("id") == id) | F.col("published")))

    def relate(self, a: str, b: str, kind: str) -> MemoryStore:
        if a == b or not kind:
            raise ValueError("an edge needs two artifacts and a kind")
        self._has(self.artifacts, a), self._has(self.artifacts, b)
        same = (F.col("from_id") == a) & (F.col("to_id") == b) & (F.col("kind") == kind)
        return replace(self, edges=self.edges.filter(~same).union(self._rows(EDGES, from_id=a, to_id=b, kind=kind, created_at=datetime.now(UTC))))

    def fork(self, source: str, title: str) -> tuple[str, MemoryStore]:
        s = self.get_scope(source)
        id = new_id()
        row = self._rows(SCOPES, id=id, parent=s["parent"], role=s["role"], title=title, version=s["version"], archived=False, forked_from=source, created_at=datetime.now(UTC))
        copies = writes.fork(self.artifacts, source, id).join(self.artifacts.select(F.col("id").alias("_from"), "vec", "content", "created_at"), F.get("derived_from", 0) == F.col("_from")).drop("_from")
        copies = copies.withColumn("meta", F.lit(None).cast("map<string,string>"))
        return id, replace(self, scopes=self.scopes.union(row), artifacts=self.artifacts.unionByName(copies), _closure=[])

    def consolidate(self, scope: str, summary: str, supersedes=()) -> tuple[str, MemoryStore]:
        home = self.get_scope(scope)["parent"] or scope
        return self.push(home, summary, "summary", "worktree", supersedes=supersedes, published=True)

    def cross_version(self, scope: str, constraints: str, lessons: str) -> tuple[str, MemoryStore]:
        s = self.get_scope(scope)
        id = new_id()
        store = replace(self, scopes=self.scopes.withColumn("archived", (F.col("id") == scope) | F.col("archived")))
        row = self._rows(SCOPES, id=id, parent=s["parent"], role=s["role"], title=s["title"], version=s["version"] + 1, forked_from=scope, archived=False, created_at=datetime.now(UTC))
        store = replace(store, scopes=store.scopes.union(row), _closure=[])
        first = None
        for line in (x.strip() for text in (constraints, lessons) for x in text.split("\n")):
            if line:
                seed, store = store.push(id, line, "seed", "worktree", published=True)
                first = first or seed
        # A scope is seeded from its first seed artifact.
        seeded = store.scopes.withColumn("seed_from", F.when(F.col("id") == id, F.lit(first)).otherwise(F.col("seed_from")))
        return id, replace(store, scopes=seeded)

    def ingest(self, root: str, files: DataFrame, **sizes) -> tuple[dict, MemoryStore]:
        """Brings files (path, text) in below the scope root: what has changed, and the new store.
        A directory on disk is brought in by ingest_directory()."""
        label = self.get_scope(root)["title"] or ""
        out = sync.sync(files, root, self.scopes, self.artifacts, self.edges, new_id()[:14], label, self.embed, **sizes)
        return out.stats.first().asDict(), replace(self, scopes=out.scopes, artifacts=out.artifacts, edges=out.edges, _closure=[])

    def ingest_directory(self, path: str, root: str | None = None, title: str = "", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[str, dict, MemoryStore]:
        """Brings the files of a directory in below root, or else below the scope that config remembers for
        it, or a new one. Files whose size and time are those of the last run aren't opened."""
        path = os.path.realpath(path)
        remembered = self.get_config(f"ingest:{path}")
        if root is None and remembered is not None and not self.scopes.filter(F.col("id") == remembered).isEmpty():
            root = remembered
        store = self
        if root is None:
            root, store = self.create_scope(None, "worktree", title or os.path.basename(path))
        listed = cut(list_directory(self.spark, path))
        below = store.closure().filter(F.col("ancestor") == root).select(F.col("descendant").alias("scope"))
        chunks = sync.stored_chunks(store.artifacts, below)
        seen = store.files.filter(F.col("root") == root).drop("root")
        same = cut(sync.unread(listed, seen, chunks, max_chars, overlap))
        read = read_files(listed.join(same, "path", "left_anti"), path)
        label = store.get_scope(root)["title"] or ""
        out = sync.sync(read, root, store.scopes, store.artifacts, store.edges, new_id()[:14], label, self.embed, max_chars, overlap, same.select("path", "sig", "n"))
        now = listed.join(out.wanted, "path").withColumn("root", F.lit(root)).select(self.files.columns)
        files = store.files.filter(F.col("root") != root).unionByName(now)
        store = replace(store, scopes=out.scopes, artifacts=out.artifacts, edges=out.edges, files=files, _closure=[])
        if remembered != root:
            store = store.set_config(f"ingest:{path}", root)
        return root, out.stats.first().asDict(), store

    def rollup_scope(self, scope: str, summary: str) -> MemoryStore:
        self._has(self.scopes, scope)
        here = F.col("id") == scope
        columns = {"rollup_summary": F.when(here, summary).otherwise(F.col("rollup_summary"))}
        if self.embed:
            columns["rollup_vec"] = F.when(here, self.embed(F.lit(summary))).otherwise(F.col("rollup_vec"))
        return replace(self, scopes=self.scopes.withColumns(columns))

    def delete_artifact(self, id: str) -> MemoryStore:
        self._has(self.artifacts, id)
        gone = self.spark.createDataFrame([(id,)], "id string")
        left, edges = writes.delete(self.artifacts, self.edges, gone)
        return replace(self, artifacts=left.select(self.artifacts.columns), edges=edges)

    def delete_scope(self, id: str) -> MemoryStore:
        self._has(self.scopes, id)
        if not (self.artifacts.filter(F.col("scope") == id).isEmpty() and self.scopes.filter(F.col("parent") == id).isEmpty()):
            raise ValueError("the scope isn't empty")
        return replace(self, scopes=self.scopes.filter(F.col("id") != id), _closure=[])

    def closure(self) -> DataFrame:
        if not self._closure:
            self._closure.append(S.closure(self.scopes))
        return self._closure[0]

    def index(self) -> lexical.Index:
        """The inverted index of the artifacts: built and written once, for all later queries."""
        if not self._index or self._index[0] is not self.artifacts:
            self._index[:] = [self.artifacts, lexical.build(self.artifacts)]
        return self._index[1]

    def query(self, queries: DataFrame, spec: QuerySpec) -> DataFrame:
        """Hits of queries (query_id, scope, text, qvec; the embedder fills a missing qvec)."""
        if "qvec" not in queries.columns:
            queries = queries.withColumn("qvec", self.embed(F.col("text")))
        self._guard(queries, "qvec")
        rollups = self.scopes.select(F.col("id").alias("scope"), "rollup_vec")
        return retrieval.retrieve(queries, self.scopes, self.artifacts, spec, closure=self.closure(), rollups=rollups, edges=self.edges, reranker=self.reranker, index=self.index() if spec.mode == "hybrid" else None)

    def query_traced(self, queries: DataFrame, spec: QuerySpec) -> tuple[DataFrame, MemoryStore]:
        """query(), and a store that holds the queries' traces: what they asked, saw and got."""
        if "qvec" not in queries.columns:
            queries = queries.withColumn("qvec", self.embed(F.col("text")))
        hits = self.query(queries, spec)
        rollups = self.scopes.select(F.col("id").alias("scope"), "rollup_vec")
        found = S.current(S.candidates(queries, self.scopes, self.artifacts, self.closure(), spec, rollups), spec)
        asked = queries.select("query_id", "scope", "text", F.lit(datetime.now(UTC)).alias("created_at"))
        return hits, replace(self, traces=self.traces.unionByName(asked), visible=self.visible.unionByName(retrieval.traces(found, hits)))

    def trace(self, query_id: str) -> tuple[dict, DataFrame]:
        """The trace of a query, and its visible set with the ranks of the hits."""
        row = self.traces.filter(F.col("query_id") == query_id).first()
        if row is None:
            raise LookupError(f"no trace {query_id}")
        return row.asDict(), self.visible.filter(F.col("query_id") == query_id).select("id", "rank")

    def respond(self, queries: DataFrame, spec: QuerySpec, model: str = "") -> DataFrame:
        """One row for each query: verdict by the model's floors (config overrides them) and hits."""
        return retrieval.respond(queries, self.query(queries, spec), resolve_floors(model, self.get_config))

    def calibrate(self, model: str, tops: DataFrame, recall: float = 0.9, reranked: bool = False) -> MemoryStore:
        """Stores the floor that keeps this share of probes (top_score, or rerank_score if reranked) as the
        model's floor of that score. ValueError if a probe wasn't reranked, or there is none."""
        if reranked:
            if not tops.filter("rerank_score IS NULL").isEmpty():
                raise ValueError("a probe that wasn't reranked")
            tops = tops.select(F.col("rerank_score").alias("top_score"))
        floor = conformal_floor(tops, recall).first()
        if not floor["probes"]:
            raise ValueError("no probes")
        return self.set_config(f"conf.{'rerank' if reranked else 'floor'}.{model}", repr(floor["floor"]))

    def lock(self, key: bytes) -> MemoryStore:
        """Marks an empty or unlocked store as sealed with this key."""
        sealed = F.base64(blobs.seal(F.lit("tessera"), F.lit(key), F.lit("sentinel")))
        return self.set_config("enc", self.spark.range(1).select(sealed).first()[0])

    def unlock(self, key: bytes | None) -> None:
        """ValueError if the store is sealed and the key isn't its own, or a key is given for a plain one."""
        mark = self.get_config("enc")
        if mark is None or key is None:
            if (mark is None) != (key is None):
                raise ValueError("a sealed store needs its key, and a plain one none")
            return
        opened = F.expr("try_aes_decrypt(unbase64(mark), key, 'GCM', 'DEFAULT', 'sentinel')").cast("string")
        if self.spark.createDataFrame([(mark, key)], "mark string, key binary").select(opened).first()[0] != "tessera":
            raise ValueError("this isn't the store's key")

    def neighbors(self, scope: str, text: str, k: int) -> DataFrame:
        return self.query(self.spark.createDataFrame([("q", scope, text)], "query_id string, scope string, text string"), QuerySpec(top_k=k))

    def drill(self, id: str) -> DataFrame:
        self._has(self.artifacts, id)
        return self.artifacts.filter(F.col("id") == id)

    def related(self, id: str, direction: str = "out", kinds: tuple[str, ...] = (), depth: int = 1) -> DataFrame:
        return graph.related(self.spark.createDataFrame([(id,)], "start string"), self.edges, self.artifacts, direction, kinds, depth)

    def sibling_overview(self, scope: str) -> DataFrame:
        return S.sibling_overview(self.scopes.filter(F.col("id") == scope).select(F.col("id").alias("scope")), self.scopes, self.artifacts)

    def ancestors(self, scope: str) -> DataFrame:
        return S.ancestors(self.closure()).filter(F.col("scope") == scope).orderBy("distance")

    def get_scope(self, id: str) -> dict:
        found = self.scopes.filter(F.col("id") == id).first()
        if found is None:
            raise LookupError(f"no {id}")
        return found.asDict()

    def recent_traces(self, n: int) -> DataFrame:
        rows = self.traces.orderBy(F.desc("query_id"))
        return rows.limit(n) if n > 0 else rows

    def set_config(self, key: str, value: str) -> MemoryStore:
        return replace(self, config=self.config.filter(F.col("key") != key).union(self._rows(CONFIG, key=key, value=value)))

    def get_config(self, key: str) -> str | None:
        found = self.config.filter(F.col("key") == key).first()
        return found["value"] if found else None

    def views(self) -> None:
        """Temporary views for Spark SQL."""
        for name in _TABLES:
            getattr(self, name).createOrReplaceTempView(name)
        self.closure().createOrReplaceTempView("scope_closure")
