"""The same results in SQL, over the tables alone."""

from __future__ import annotations

_FX = r"""
fx_scopes AS (
  SELECT 'R' AS id, CAST(NULL AS VARCHAR) AS parent, 'worktree' AS role, 'corpus' AS title, false AS archived
  UNION ALL SELECT DISTINCT 'R/' || lang, 'R', 'workspace', lang, false FROM documents
  UNION ALL SELECT DISTINCT 'R/' || lang || '/' || source, 'R/' || lang, 'session', source, source = 'src3' FROM documents),
fx_artifacts AS (
  SELECT lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS id, 'R/' || d.lang || '/' || d.source AS scope,
    CASE d.doc_id % 6 WHEN 0 THEN 'answer' WHEN 1 THEN 'insight' WHEN 2 THEN 'summary' WHEN 3 THEN 'document' WHEN 4 THEN 'reasoning' ELSE 'seed' END AS kind,
    CASE WHEN l.quality = 1 THEN 'worktree' ELSE 'workspace' END AS tier, substr(d.text, 1, 80) AS summary, d.text AS content,
    d.doc_id % 3 = 0 AS published, d.source = 'src2' AS ingested, e.embedding AS vec, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + d.doc_id * INTERVAL '1' HOUR AS created_at,
    lead(lpad(CAST(d.doc_id AS VARCHAR), 10, '0')) OVER (PARTITION BY d.text ORDER BY d.doc_id) AS superseded_by
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings e ON e.vec_id = d.doc_id % c.n LEFT JOIN labels l ON l.doc_id = d.doc_id),
fx_edges AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS from_id, lpad(CAST(CAST(floor(doc_id / 2.0) AS BIGINT) AS VARCHAR), 10, '0') AS to_id, 'depends_on' AS kind FROM documents WHERE doc_id > 0
  UNION ALL SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0'), lpad(CAST((doc_id * 7 + 3) % n AS VARCHAR), 10, '0'), 'relates_to'
  FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) t WHERE doc_id % 4 = 0 AND (doc_id * 7 + 3) % n <> doc_id
  UNION ALL SELECT superseded_by, id, 'refines' FROM fx_artifacts WHERE superseded_by IS NOT NULL),
fx_rollups AS (SELECT scope, min_by(vec, id) AS rollup_vec FROM fx_artifacts GROUP BY scope),
fx_queries AS (
  SELECT 'q' || lpad(CAST(e.vec_id AS VARCHAR), 10, '0') AS query_id, CASE e.vec_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'R/en' ELSE 'R/en/src1' END AS scope, b.text AS text, e.embedding AS qvec
  FROM embeddings e CROSS JOIN (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON b.item_id = e.vec_id // 50 % c.n WHERE e.vec_id % 50 = 0),
clo AS (
  SELECT id AS ancestor, id AS descendant, 0 AS distance FROM fx_scopes
  UNION ALL SELECT s.parent, c.descendant, c.distance + 1 FROM clo c JOIN fx_scopes s ON s.id = c.ancestor WHERE s.parent IS NOT NULL),
sib AS (SELECT a.id AS scope, b.id AS sibling, b.archived FROM fx_scopes a JOIN fx_scopes b ON a.parent IS NOT DISTINCT FROM b.parent AND a.id <> b.id),
pth AS (SELECT c.descendant AS scope, string_agg(s.title, '/' ORDER BY c.distance DESC) AS scope_path FROM clo c JOIN fx_scopes s ON s.id = c.ancestor GROUP BY c.descendant),
see AS (
  SELECT query_id, scope, true AS any_state FROM fx_queries
  UNION ALL SELECT q.query_id, c.ancestor, true FROM fx_queries q JOIN clo c ON c.descendant = q.scope WHERE c.distance > 0
  UNION ALL SELECT q.query_id, s.sibling, false FROM fx_queries q JOIN sib s USING (scope) WHERE NOT s.archived),
below AS (SELECT q.query_id, c.descendant AS scope, s.archived, q.qvec FROM fx_queries q JOIN clo c ON c.ancestor = q.scope JOIN fx_scopes s ON s.id = c.descendant WHERE c.distance > 0),
flat AS (SELECT DISTINCT s.query_id, a.* FROM see s JOIN fx_artifacts a USING (scope) WHERE s.any_state OR a.published),
coll AS (SELECT DISTINCT * FROM (SELECT * FROM flat UNION ALL SELECT b.query_id, a.* FROM below b JOIN fx_artifacts a USING (scope) WHERE NOT b.archived)),
crs0 AS (SELECT b.query_id, b.scope, list_dot_product(CAST(b.qvec AS DOUBLE[]), CAST(r.rollup_vec AS DOUBLE[])) AS score FROM below b JOIN fx_rollups r USING (scope) WHERE NOT b.archived),
crs1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scope) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM crs0),
crs AS (SELECT * FROM crs1 WHERE rank <= 6 AND (rank <= 3 OR score >= top - 0.05)),
hier AS (
  SELECT DISTINCT p.query_id, a.* FROM (SELECT query_id, scope FROM crs UNION SELECT query_id, scope FROM fx_queries WHERE query_id IN (SELECT query_id FROM crs)) p JOIN fx_artifacts a USING (scope)
  UNION ALL SELECT * FROM flat WHERE query_id NOT IN (SELECT query_id FROM crs))
"""


def _scored(source: str) -> str:
    return f"""sc AS (SELECT f.*, list_dot_product(CAST(q.qvec AS DOUBLE[]), CAST(f.vec AS DOUBLE[])) AS score FROM {source} f JOIN fx_queries q USING (query_id) WHERE f.superseded_by IS NULL)"""


_LEX = r"""
txt AS (SELECT query_id, id, list_filter(regexp_split_to_array(lower(CASE WHEN kind = 'document' AND length(content) > 0 THEN content ELSE summary END), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS w FROM sc),
tf AS (SELECT query_id, id, term, count(*) AS f FROM (SELECT query_id, id, unnest(w) AS term FROM txt) GROUP BY ALL),
dfr AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
siz AS (SELECT query_id, count(*) AS n, avg(len(w)) AS av FROM txt GROUP BY query_id),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS term FROM fx_queries) GROUP BY ALL),
hit AS (SELECT tf.query_id, tf.id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / av))) AS bm
        FROM tf JOIN ask USING (query_id, term) JOIN dfr USING (query_id, term) JOIN siz USING (query_id) JOIN txt USING (query_id, id) GROUP BY ALL),
bm AS (SELECT sc.query_id, sc.id, sc.scope, sc.score, coalesce(hit.bm, 0.0) AS bm25 FROM sc LEFT JOIN hit USING (query_id, id))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((_FX.strip(), *(p.strip() for p in parts[:-1]))) + "\n" + parts[-1]


def _top(source: str, key: str, k: int = 5, where: str = "true") -> str:
    return f"""SELECT t.query_id, t.rank, t.id, p.scope_path, round(t.score, 6) AS score FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, id) AS INTEGER) AS rank FROM {source} WHERE {where}) t JOIN pth p USING (scope) WHERE rank <= {k}"""


_FUSED = "fus AS (SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) + 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id)) AS fused FROM bm)"
_SEEDED = """seed AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5),
lnk AS (SELECT DISTINCT from_id, to_id, kind FROM fx_edges),
bth AS (SELECT from_id AS id, to_id AS nb FROM lnk UNION ALL SELECT to_id, from_id FROM lnk),
g AS (SELECT s.query_id, b.id, sum(s.score) AS g FROM bth b JOIN seed s ON s.id = b.nb GROUP BY ALL),
gb AS (SELECT sc.*, coalesce(g.g, 0.0) AS g, max(coalesce(g.g, 0.0)) OVER (PARTITION BY sc.query_id) AS gm FROM sc LEFT JOIN g USING (query_id, id)),
gk AS (SELECT *, CASE WHEN gm > 0 THEN 0.7 * score + 0.3 * g / gm ELSE score END AS k FROM gb)"""
_TWO = "two AS (SELECT query_id, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 2 GROUP BY query_id)"
_VERDICT = """ver AS (SELECT q.query_id, a, b, CASE WHEN a IS NULL THEN 'empty' WHEN a < 0.5 THEN 'floor_miss' WHEN b IS NOT NULL AND a - b < 0.03 THEN 'margin_ambiguous' ELSE 'ok' END AS confidence
FROM fx_queries q LEFT JOIN two USING (query_id))"""
_RERANK = r"""w20 AS (SELECT s.*, q.text AS asked, CASE WHEN s.kind = 'document' AND length(s.content) > 0 THEN s.content ELSE s.summary END AS rt
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r0 FROM sc) s JOIN fx_queries q USING (query_id) WHERE r0 <= 20),
rr0 AS (SELECT query_id, id, score, list_distinct(list_filter(regexp_split_to_array(lower(asked), '\s+'), lambda x: x <> '')) AS aw, list_distinct(list_filter(regexp_split_to_array(lower(substr(rt, 1, 2000)), '\s+'), lambda x: x <> '')) AS tw FROM w20),
rr AS (SELECT query_id, id, score, 4.0 * len(list_intersect(aw, tw)) / len(aw) - 2.0 AS logit FROM rr0)"""


def _related(start_dir: str, depth: int, kinds: str = "") -> str:
    # A way is a text of sides and ids of one length, after its number of steps.
    out, into = "SELECT from_id AS a, '0' AS side, to_id AS b FROM fx_edges", "SELECT to_id, '1', from_id FROM fx_edges"
    if start_dir == "in":
        out = "SELECT to_id AS a, '1' AS side, from_id AS b FROM fx_edges"
    out += f" WHERE kind IN ({kinds})" if kinds else ""
    links = f"lk AS ({out}{' UNION ' + into if start_dir == 'both' else ''})"
    walk, last = "wk0 AS (SELECT id AS start, id, '0' AS way FROM fx_artifacts WHERE kind = 'seed')", "SELECT * FROM wk0"
    for n in range(1, depth + 1):
        walk += f", wk{n} AS (SELECT w.start, lk.b AS id, min('{n}' || substr(w.way, 2) || lk.side || lk.b) AS way FROM wk{n - 1} w JOIN lk ON lk.a = w.id GROUP BY ALL)"
        last += f" UNION ALL SELECT * FROM wk{n}"
    return _with(links, walk, f"SELECT start, id, left(way, 1)::INT AS distance, row_number() OVER (PARTITION BY start ORDER BY way) AS place FROM (SELECT start, id, min(way) AS way FROM ({last}) GROUP BY start, id) JOIN (SELECT id FROM fx_artifacts WHERE superseded_by IS NULL) USING (id) WHERE left(way, 1) <> '0'")


_PROBES = """WITH pr AS (SELECT CAST(l.doc_id AS VARCHAR) AS query_id, l.quality = 1 AS present, v.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
FROM labels l CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings e ON e.vec_id = l.doc_id % c.n JOIN embeddings v ON v.vec_id <> e.vec_id),
tp AS (SELECT query_id, present, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pr) WHERE r <= 2 GROUP BY ALL)
"""
_PATH = "source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md'"
_HITS = "SELECT query_id, id FROM"
_COMPLETE = f"""WITH f AS (SELECT {_PATH} AS path, doc_id % 10 AS k FROM documents),
c AS (SELECT path, CASE k WHEN 0 THEN 'remove' WHEN 2 THEN 'add' WHEN 3 THEN CASE WHEN lines = 1 THEN 'add' ELSE 'update' END WHEN 4 THEN 'update' ELSE 'unchanged' END AS action
FROM f JOIN (SELECT {_PATH} AS path, len(string_split(text, chr(10))) AS lines FROM documents) USING (path))"""

_WALL = (
    "sc AS (SELECT f.*, list_dot_product(CAST(q.qvec AS DOUBLE[]), CAST(f.vec AS DOUBLE[])) AS score FROM coll f JOIN fx_queries q USING (query_id))",
    "h AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 20)",
    "ask AS (SELECT query_id, CAST(substr(query_id, 2) AS BIGINT) AS n FROM fx_queries)",
    """ranks AS (SELECT a.query_id, a.n, CAST(coalesce(x.r, 0) AS INTEGER) AS rank1, CAST(coalesce(y.r, 0) AS INTEGER) AS rank2, CAST(coalesce(z.r, 0) AS INTEGER) AS rank3 FROM ask a
LEFT JOIN h x ON x.query_id = a.query_id AND x.id = lpad(CAST(a.n AS VARCHAR), 10, '0') LEFT JOIN h y ON y.query_id = a.query_id AND y.id = lpad(CAST(a.n + 1 AS VARCHAR), 10, '0')
LEFT JOIN h z ON z.query_id = a.query_id AND z.id = lpad(CAST(a.n + 50 AS VARCHAR), 10, '0'))""",
    """gold AS (SELECT query_id, rank1, rank2, rank1 > 0 OR rank2 > 0 AS gold_found, CASE WHEN n % 4 <> 2 THEN rank1 END AS current_rank, CASE WHEN n % 4 <> 2 THEN rank3 END AS stale_rank,
CASE WHEN n % 4 <> 2 THEN rank1 > 0 AND (rank3 = 0 OR rank1 < rank3) END AS currency_ok FROM ranks)""",
)
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_SAYS = "coalesce(len(list_filter({0}, lambda x: x <> '' AND contains(lower({1}), lower(x)))) > 0, false)"
_TURNS = (
    _scored("coll"),
    "h AS (SELECT * FROM (SELECT query_id, id, summary, content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5)",
    """ask AS (SELECT query_id, n, k % 7 <> 6 AS expected, CASE WHEN k % 3 = 0 THEN lpad(CAST(n AS VARCHAR), 10, '0') END AS target, CASE WHEN k % 5 = 4 THEN [] ELSE w[1:2] END AS mentions,
CASE WHEN k % 2 = 0 THEN w[3:3] ELSE [] END AS forbid, CAST(k % 4 AS INTEGER) AS most FROM (SELECT query_id, CAST(substr(query_id, 2) AS BIGINT) AS n, CAST(substr(query_id, 2) AS BIGINT) // 50 AS k, string_split(text, ' ') AS w FROM fx_queries))""",
    f"""j AS (SELECT a.query_id, h.r, {_WORDS.format("h.summary")} AS sw, {_WORDS.format("h.content")} AS cw, h.id = a.target AS aim, {_SAYS.format("a.mentions", "h.summary")} AS told, {_SAYS.format("a.mentions", "h.content")} AS deep, {_SAYS.format("a.forbid", "h.summary")} AS bad FROM ask a JOIN h USING (query_id))""",
    "g AS (SELECT query_id, count(*) AS n_hits, sum(sw) AS sw, min(r) FILTER (aim) AS at_target, min(r) FILTER (told) AS at_told, min(r) FILTER (deep) AS at_deep, bool_or(bad) AS bad FROM j GROUP BY query_id)",
    """m AS (SELECT a.*, coalesce(sw, 0) AS sw, coalesce(n_hits, 0) AS n_hits, at_deep, NOT expected OR NOT coalesce(bad, false) AS forbid_ok, expected AND len(forbid) > 0 AS forbids, len(mentions) = 0 OR at_told IS NOT NULL AS said, target IS NULL OR at_target IS NOT NULL AS aimed,
CAST(CASE WHEN NOT expected THEN 0 WHEN target IS NOT NULL THEN coalesce(at_target, 0) WHEN len(mentions) > 0 THEN coalesce(at_told, 0) ELSE 0 END AS INTEGER) AS expected_rank FROM ask a LEFT JOIN g USING (query_id))""",
    """dr AS (SELECT *, expected AND aimed AND forbid_ok AND said AS sufficient, CAST(CASE WHEN NOT expected OR aimed AND forbid_ok AND said OR most = 0 THEN 0 WHEN aimed AND forbid_ok AND at_deep <= most THEN at_deep ELSE least(n_hits, most) END AS INTEGER) AS drills,
NOT expected OR aimed AND forbid_ok AND (said OR coalesce(at_deep <= most, false)) AS met FROM m)""",
    "raw AS (SELECT d.query_id, sum(cw) AS raw FROM dr d JOIN j ON j.query_id = d.query_id AND j.r <= d.drills GROUP BY d.query_id)",
    f"""base AS (SELECT a.query_id, sum({_WORDS.format("CASE WHEN length(x.content) > 0 THEN x.content ELSE x.summary END")}) AS base FROM ask a JOIN fx_artifacts x ON x.id IN (lpad(CAST(a.n AS VARCHAR), 10, '0'), lpad(CAST(a.n + 1 AS VARCHAR), 10, '0')) WHERE a.expected GROUP BY a.query_id)""",
    """tm AS (SELECT query_id, met, sufficient, drills, CAST(sw AS INTEGER) AS overview_tokens, CAST(coalesce(raw, 0) AS INTEGER) AS raw_tokens, CAST(coalesce(base, 0) AS BIGINT) AS baseline_tokens, expected_rank > 0 AS expected_found, expected_rank, forbid_ok, forbids
FROM dr LEFT JOIN raw USING (query_id) LEFT JOIN base USING (query_id))""",
)

ORACLES = {
    "scope_ancestors": _with("SELECT descendant AS scope, ancestor, distance FROM clo WHERE distance > 0"),
    "scope_descendants": _with("SELECT ancestor AS scope, descendant, distance FROM clo WHERE distance > 0"),
    "scope_siblings": _with("SELECT scope, sibling FROM sib"),
    "scope_path": _with("SELECT * FROM pth"),
    "deep_closure": """WITH RECURSIVE t AS (SELECT 'G' AS id, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'G' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), c AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM t UNION ALL SELECT t.parent, c.descendant, c.distance + 1 FROM c JOIN t ON t.id = c.ancestor WHERE t.parent IS NOT NULL)
SELECT ancestor, count(*) AS n, max(distance) AS depth FROM c GROUP BY ancestor""",
    "visible_set": _with(f"{_HITS} flat"),
    "collapsed_set": _with(f"{_HITS} coll"),
    "coarse_scopes": _with("SELECT query_id, scope, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM crs"),
    "hierarchical_set": _with(f"{_HITS} hier"),
    "currency_filter": _with(f"{_HITS} coll WHERE superseded_by IS NULL"),
    "kind_filter": _with(f"{_HITS} coll WHERE superseded_by IS NULL AND kind IN ('document', 'reasoning')"),
    "tier_filter": _with(f"{_HITS} coll WHERE superseded_by IS NULL AND tier = 'worktree'"),
    "full_history": _with("""se2 AS (SELECT query_id, scope, true AS any_state FROM fx_queries UNION ALL SELECT q.query_id, c.ancestor, true FROM fx_queries q JOIN clo c ON c.descendant = q.scope WHERE c.distance > 0
UNION ALL SELECT q.query_id, s.sibling, false FROM fx_queries q JOIN sib s USING (scope) UNION ALL SELECT query_id, scope, true FROM below)""", "SELECT DISTINCT s.query_id, a.id FROM se2 s JOIN fx_artifacts a USING (scope) WHERE s.any_state OR a.published"),
    "sibling_overview": _with("SELECT DISTINCT q.scope AS view, a.id, a.scope, a.kind FROM fx_queries q JOIN sib s USING (scope) JOIN fx_artifacts a ON a.scope = s.sibling WHERE a.published"),
    "vector_topk": _with(_scored("flat"), _top("sc", "score")),
    "vector_collapsed_topk": _with(_scored("coll"), _top("sc", "score")),
    "vector_minscore": _with(_scored("coll"), _top("sc", "score", where="score >= 0.3")),
    "neighbors": _with(_scored("flat"), _top("sc", "score", 3)),
    "drill_raw": _with("SELECT id, scope, kind, tier, summary, content FROM fx_artifacts WHERE id = '0000000007'"),
    "bm25_topk": _with(_scored("coll"), _LEX, "SELECT query_id, CAST(r AS INTEGER) AS rank, id, round(bm25, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS r FROM bm) WHERE r <= 5"),
    "bm25_stats": _with(
        r"tx AS (SELECT id, list_filter(regexp_split_to_array(lower(substr(CASE WHEN kind = 'document' AND length(content) > 0 THEN content ELSE summary END, 1, 2000)), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS w FROM fx_artifacts)",
        "dd AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS term FROM tx) GROUP BY term)", "nn AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tx)",
        "SELECT df, count(*) AS terms, any_value(n) AS n, round(any_value(av), 6) AS avg_len FROM dd CROSS JOIN nn GROUP BY df",
    ),
    "rrf_fusion": _with(_scored("coll"), "fu AS (SELECT query_id, id, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) + 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY length(summary) DESC, id)) AS fused FROM sc)",
                        "SELECT query_id, CAST(r AS INTEGER) AS rank, id, round(fused, 9) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS r FROM fu) WHERE r <= 5"),
    "hybrid_topk": _with(_scored("coll"), _LEX, _FUSED, _top("fus", "fused")),
    "hierarchical_hybrid_topk": _with(_scored("hier"), _LEX, _FUSED, _top("fus", "fused")),
    "hierarchical_vector_topk": _with(_scored("hier"), _top("sc", "score")),
    "recency_topk": _with(_scored("coll"), "rc AS (SELECT *, 0.85 * score + 0.15 * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400e6, 0.0) / 10.0) AS k FROM sc)", _top("rc", "k")),
    "importance_topk": _with(_scored("coll"), "im AS (SELECT *, 0.8 * score + 0.2 * CASE WHEN tier = 'worktree' THEN 1.0 ELSE 0.0 END AS k FROM sc)", _top("im", "k")),
    "graph_boost_topk": _with(_scored("coll"), _SEEDED, _top("gk", "k")),
    "rerank_topk": _with(_scored("coll"), _RERANK, "SELECT query_id, CAST(r AS INTEGER) AS rank, id, round(score, 6) AS score, round(1 / (1 + exp(-logit)), 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, id) AS r FROM rr) WHERE r <= 5"),
    "auto_rerank_flags": _with(_scored("coll"), _TWO, "SELECT query_id, a < 0.5 OR coalesce(a - b < 0.03, false) AS borderline FROM two"),
    "confidence_verdict": _with(_scored("coll"), _TWO, _VERDICT, "SELECT query_id, confidence, confidence <> 'ok' AS weak_match, 'cosine' AS ranked_by, round(coalesce(a, 0.0), 6) AS top_score, round(coalesce(a - b, 0.0), 6) AS margin FROM ver"),
    "untrusted_flag": _with(_scored("coll"), _TWO, _VERDICT, "SELECT v.query_id, v.confidence, coalesce(bool_or(h.ingested), false) AS untrusted FROM ver v LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5) h USING (query_id) GROUP BY ALL"),
    "query_response": _with(_scored("coll"), _TWO, _VERDICT, """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5)""",
                            "SELECT v.query_id, v.confidence, coalesce(bool_or(h.ingested), false) AS untrusted, round(coalesce(any_value(v.a), 0.0), 6) AS top_score, coalesce(string_agg(h.id, ',' ORDER BY h.r), '') AS hits FROM ver v LEFT JOIN top h USING (query_id) GROUP BY v.query_id, v.confidence"),
    "query_traces": _with(_scored("coll"), "tr AS (SELECT c.query_id, c.id, s.r FROM (SELECT query_id, id FROM coll WHERE superseded_by IS NULL) c LEFT JOIN (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) s USING (query_id, id))",
                          "SELECT query_id, count(*) AS visible, count(*) FILTER (r <= 5) AS hits, min_by(id, r) AS first FROM tr GROUP BY query_id"),
    "related_out": _related("out", 1),
    "related_in": _related("in", 1, "'depends_on'"),
    "related_both_depth2": _related("both", 2),
    "supersession_history": _with(
        "ch AS (SELECT id AS origin, id, superseded_by, 0 AS step FROM fx_artifacts WHERE superseded_by IS NOT NULL AND id NOT IN (SELECT superseded_by FROM fx_artifacts WHERE superseded_by IS NOT NULL) UNION ALL SELECT c.origin, a.id, a.superseded_by, c.step + 1 FROM ch c JOIN fx_artifacts a ON a.id = c.superseded_by)",
        "SELECT origin, id, step, superseded_by IS NULL AS current FROM ch",
    ),
    "fork_copy": _with("SELECT 'fork-' || id AS id, 'R/en/fork' AS scope, kind, 'workspace' AS tier, false AS published, id AS derived_from FROM fx_artifacts WHERE scope = 'R/en/src1' AND published"),
    "consolidate": _with("SELECT 'sum-' || a.scope AS id, coalesce(s.parent, s.id) AS scope, 'worktree' AS tier, true AS published, CAST(count(*) AS INTEGER) AS n_sources, string_agg(a.id, ',' ORDER BY a.id) AS derived_from FROM fx_artifacts a JOIN fx_scopes s ON s.id = a.scope WHERE a.superseded_by IS NULL AND a.kind = 'reasoning' GROUP BY a.scope, s.parent, s.id"),
    "crossversion_seeds": _with("ln AS (SELECT id AS scope, list_concat(list_filter(list_transform(string_split(chr(9) || chr(13) || chr(10) || content || chr(13), chr(10)), lambda x: regexp_replace(x, '^[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')), lambda x: x <> ''), ['one lesson', 'two lessons']) AS l FROM fx_artifacts WHERE kind = 'answer')",
                               "SELECT scope, CAST(unnest(range(len(l))) AS INTEGER) AS at, md5(unnest(l)) AS line, 'seed' AS kind, 'worktree' AS tier FROM ln"),
    "push_lineage": _with("SELECT 'new-' || superseded_by AS id, 'insight' AS kind, 'workspace' AS tier, superseded_by || ',' || id AS detail FROM fx_artifacts WHERE superseded_by IS NOT NULL UNION ALL SELECT id, 'marked', '-', 'new-' || superseded_by FROM fx_artifacts WHERE superseded_by IS NOT NULL"),
    "delete_cascade": _with("gn AS (SELECT id FROM fx_artifacts WHERE kind = 'seed')", "SELECT kind, count(*) AS n FROM fx_artifacts WHERE kind <> 'seed' GROUP BY kind UNION ALL SELECT kind, count(*) FROM fx_edges WHERE from_id NOT IN (SELECT id FROM gn) AND to_id NOT IN (SELECT id FROM gn) GROUP BY kind"),
    "chunk_window": f"""WITH RECURSIVE l AS (SELECT {_PATH} AS path, string_split(CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) ELSE '' END || text, chr(10)) AS x FROM documents),
w AS (SELECT path, x, 1 AS i, 1 AS a, octet_length(encode(x[1])) AS held FROM l
  UNION ALL SELECT path, x, i + 1, CASE WHEN held > 0 AND held + octet_length(encode(x[i + 1])) + 1 > 1500 THEN i + 1 ELSE a END,
    CASE WHEN held > 0 AND held + octet_length(encode(x[i + 1])) + 1 > 1500 THEN octet_length(encode(x[i + 1])) WHEN held > 0 THEN held + 1 + octet_length(encode(x[i + 1])) ELSE octet_length(encode(x[i + 1])) END FROM w WHERE i < len(x)),
c AS (SELECT path, a, max(i) AS b, any_value(x) AS x FROM w GROUP BY path, a),
t AS (SELECT path, a, b, trim(array_to_string(x[a:b], chr(10)), chr(10)) AS txt FROM c)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY a) - 1 AS INTEGER) AS chunk, a AS start_line, b AS end_line, md5(txt) AS text_md5 FROM t WHERE trim(txt, ' ' || chr(10)) <> ''""",
    "ingest_reconcile": f"""WITH f AS (SELECT {_PATH} AS path, doc_id, text FROM documents)
SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'remove' WHEN doc_id % 10 = 2 THEN CASE WHEN trim(text) = '' THEN 'unchanged' ELSE 'add' END WHEN doc_id % 10 = 1 THEN 'update' ELSE 'unchanged' END AS action FROM f""",
    "ingest_completeness": _COMPLETE + " SELECT * FROM c",
    "ingest_runs": """WITH f AS (SELECT doc_id % 10 AS k, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, lang, source FROM documents),
dirs AS (SELECT lang AS dir, k, blank FROM f UNION ALL SELECT lang || '/' || source, k, blank FROM f),
g AS (SELECT bool_or(k <> 2) AS in1, bool_or(k <> 2 AND NOT blank) AS alive1, bool_or(k <> 0) AS in2, bool_or(k <> 0 AND (k = 1 OR NOT blank)) AS alive2 FROM dirs GROUP BY dir),
d AS (SELECT count(*) FILTER (in1) AS made1, count(*) FILTER (in1 AND NOT alive1) AS gone1, count(*) FILTER (in2 AND NOT alive1) AS made2, count(*) FILTER ((alive1 OR in2) AND NOT alive2) AS gone2 FROM g)
SELECT 1 AS run, count(*) FILTER (k <> 2 AND NOT blank) AS files_added, 0 AS files_updated, count(*) FILTER (k <> 2 AND blank) AS files_unchanged, 0 AS files_removed, any_value(made1) AS scopes_created, any_value(gone1) AS scopes_removed FROM f, d
UNION ALL SELECT 2, count(*) FILTER (k = 2 AND NOT blank OR k = 1 AND blank), count(*) FILTER (k = 1 AND NOT blank), count(*) FILTER (k > 2 OR k = 2 AND blank), count(*) FILTER (k = 0 AND NOT blank), any_value(made2), any_value(gone2) FROM f, d""",
    "ingest_statistics": _COMPLETE + " SELECT action, count(*) AS files FROM c GROUP BY action",
    "dir_scopes": _with("SELECT p.id || '/' || d.source AS dir, s.id AS scope, 3 AS depth FROM (SELECT DISTINCT source FROM documents) d CROSS JOIN (SELECT id FROM fx_scopes WHERE parent = 'R') p LEFT JOIN fx_scopes s ON s.parent = p.id AND s.title = d.source"),
    "dir_rollup_text": "SELECT source AS dir, md5('directory ' || source || '; files: ' || string_agg(lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md', ', ' ORDER BY doc_id)) AS rollup_md5 FROM documents GROUP BY source",
    "content_dedupe": "SELECT sha256(text) AS hash, CAST(max(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(*) AS copies FROM documents GROUP BY text",
    "sealed_roundtrip": "SELECT doc_id, md5(text) AS text_md5, false AS plain_inside, false AS opens_elsewhere, false AS opens_tampered, 28 AS overhead FROM documents",
    "log_versions": """WITH a AS (SELECT doc_id AS n, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, 'R/' || lang || '/' || source AS scope, 'document ' || doc_id AS summary, md5(text) AS content_md5, lpad(CAST(doc_id - 1 AS VARCHAR), 10, '0') AS before FROM documents),
b AS (SELECT a.*, s.id AS after FROM a LEFT JOIN a s ON s.n = a.n + 1 AND a.n % 2 = 0)
SELECT 'old' AS version, id, scope, summary, content_md5, false AS published, CAST(NULL AS VARCHAR) AS superseded_by, '' AS derived_from, CAST(0 AS BIGINT) AS links FROM b WHERE n % 2 = 0
UNION ALL SELECT 'new', id, scope, summary, content_md5, n % 5 = 0, after, CASE WHEN n % 2 = 1 THEN before ELSE '' END, CAST(CASE WHEN n % 2 = 1 AND (n - 1) % 7 <> 0 THEN 1 ELSE 0 END AS BIGINT) FROM b WHERE n % 7 <> 0""",
    "log_blobs": "SELECT sha256(text) AS hash, CAST(any_value(octet_length(encode(text))) + 28 AS BIGINT) AS n_bytes, count(*) FILTER (doc_id % 7 <> 0) AS artifacts FROM documents WHERE text IS NOT NULL GROUP BY text",
    "recent_traces": "SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS query_id, CAST(user_id AS VARCHAR) AS scope, event_type FROM events ORDER BY 1 DESC LIMIT 50",
    "trace_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "config_latest": "SELECT 'user.' || user_id AS key, max_by(event_type, event_id) AS value FROM events GROUP BY user_id",
    "calibrate_floor": _PROBES + "SELECT round(greatest(0.0, least(1.0, quantile_cont(a, 0.1))), 6) AS floor, count(*) AS probes FROM tp WHERE present",
    "abstention_report": _PROBES + """, v AS (SELECT *, a < 0.4 OR a - b < 0.01 AS weak FROM tp)
SELECT count(*) FILTER (present) AS n_present, count(*) FILTER (NOT present) AS n_absent, count(*) FILTER (present AND weak) AS weak_present, count(*) FILTER (NOT present AND weak) AS weak_absent,
round(coalesce(count(*) FILTER (present AND weak) / nullif(count(*) FILTER (present), 0), 0.0), 6) AS fnr, round(coalesce(count(*) FILTER (NOT present AND NOT weak) / nullif(count(*) FILTER (NOT present), 0), 0.0), 6) AS fpr,
round(coalesce(max(a) FILTER (NOT present), 0.0), 6) AS max_absent FROM v""",
    "wall_report": _with(_scored("coll"), "gr AS (SELECT q.query_id, min(h.r) AS best FROM fx_queries q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 20) h ON h.query_id = q.query_id AND h.id = substr(q.query_id, 2) GROUP BY q.query_id)",
                         "SELECT count(*) AS questions, count(*) FILTER (best <= 5) AS found, round(avg(CASE WHEN coalesce(best, 6) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(best), 6) AS mean_rank FROM gr"),
    "wall_packets": _with(_scored("coll"), "h AS (SELECT * FROM (SELECT query_id, summary, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 5)",
                          "SELECT q.query_id, q.text AS question, md5(coalesce(string_agg(h.summary, chr(10) ORDER BY h.r), '')) AS retrieved_md5 FROM fx_queries q LEFT JOIN h USING (query_id) GROUP BY q.query_id, q.text"),
    "wall_gold": _with(*_WALL, "SELECT query_id, rank1, rank2, gold_found, coalesce(current_rank, -1) AS current_rank, coalesce(stale_rank, -1) AS stale_rank, coalesce(CAST(currency_ok AS VARCHAR), 'none') AS currency_ok FROM gold"),
    "wall_summary": _with(*_WALL, "SELECT count(*) AS questions, round(avg(CASE WHEN gold_found THEN 1.0 ELSE 0.0 END), 6) AS gold_recall, count(currency_ok) AS currency_probes, count(*) FILTER (currency_ok) AS currency_ok FROM gold"),
    "turn_metrics": _with(*_TURNS, "SELECT * FROM tm"),
    "scenario_report": _with(*_TURNS, """rp AS (SELECT count(*) AS turns, count(*) FILTER (sufficient) / count(*) AS suf, sum(overview_tokens + raw_tokens) / nullif(sum(baseline_tokens), 0) AS ratio, count(*) FILTER (forbids) AS nf, count(*) FILTER (forbids AND forbid_ok AND met) AS kept,
count(*) FILTER (expected_found) / count(*) AS rec, sum(expected_rank) / nullif(count(*) FILTER (expected_found), 0) AS mr FROM tm)""",
                             "SELECT turns, round(suf, 6) AS overview_sufficiency, round(coalesce(ratio, 0.0), 6) AS context_ratio, CASE WHEN nf = 0 THEN 'n/a' WHEN kept = nf THEN 'pass' ELSE 'fail' END AS constraint_survival, round(rec, 6) AS recall, round(coalesce(mr, 0.0), 6) AS mean_rank, suf >= 0.8 AND coalesce(ratio, 0.0) <= 0.25 AND rec >= 1 AND kept = nf AS passed FROM rp"),
    "scenario_metrics": r"""SELECT role, count(*) AS turns, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS words,
CAST(sum(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''))) AS BIGINT) AS tokens, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'der')) AS mentions FROM conversations GROUP BY role""",
}
