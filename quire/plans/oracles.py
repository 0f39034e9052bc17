"""Equivalent DuckDB SQL for the registered queries (check only; never used by a plan)."""

from __future__ import annotations

_NS = "unhex('6ba7b8129dad11d180b400c04fd430c8')"


def _uuid(prefix: str, key: str) -> str:
    return f"'{prefix}' || substr(sha1({_NS} || encode({key})), 1, 12)"


def _entity(doc: str, name: str) -> str:
    return _uuid("E:", f"{doc} || '::' || lower({name})")


VIEWS: dict[str, str] = {
    "og_pages": """
        SELECT r_name AS doc_id, o_orderkey AS page_id,
               'Order ' || o_orderkey || ' is ' || o_orderpriority || ' with status ' || o_orderstatus
                 || ' and total ' || CAST(floor(o_totalprice) AS BIGINT) AS text,
               CASE WHEN o_orderstatus <> 'P' THEN 'img/' || o_orderkey || '.png' END AS page_image_path,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'Urgent order ' || o_orderkey END AS page_summary,
               CAST(r_regionkey AS BIGINT) AS region_key
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "og_m0": """
        SELECT l.*, p.doc_id, p.page_id, p.region_key, p_name || ' ' || p_partkey AS part_name,
               lower(p_type) AS part_type, p_brand, CAST(p_size AS BIGINT) AS part_size, s_name AS supplier_name,
               (CASE l_returnflag WHEN 'R' THEN 'is shipping returned' WHEN 'A' THEN 'ships accepted' ELSE 'shipped' END)
                 || (CASE WHEN l_linestatus = 'F' THEN ' finally' ELSE '' END) AS relation,
               round(1 - l_discount, 2) AS confidence
        FROM lineitem l JOIN og_pages p ON l_orderkey = page_id
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "og_m1": f"""
        SELECT *, {_entity('doc_id', 'supplier_name')} AS src_id, {_entity('doc_id', 'part_name')} AS tgt_id FROM og_m0""",
    "og_mentions": f"""
        SELECT *, {_uuid('R:', "doc_id || '::' || src_id || '->' || tgt_id || '::' || lower(relation)")} AS edge_id
        FROM og_m1""",
    "og_mention_nodes": """
        SELECT tgt_id AS entity_id, doc_id, part_name AS name,
               CASE WHEN part_size < 25 THEN 'product' ELSE part_type END AS entity_type, 'visual' AS modality,
               part_name || ' by ' || p_brand AS description,
               CASE WHEN part_size % 3 = 0 THEN 'figure_panel' WHEN part_size % 3 = 1 THEN part_type END AS visual_type,
               page_id, l_partkey * 5 + region_key AS vec_key FROM og_mentions
        UNION ALL
        SELECT src_id, doc_id, supplier_name, 'organization', 'text', 'Supplier named ' || supplier_name, NULL,
               page_id, l_suppkey * 5 + region_key + 3 FROM og_mentions""",
    "og_nodes": """
        SELECT entity_id, doc_id, name, entity_type, modality, description, visual_type, vec_key,
               list_sort(list(DISTINCT page_id)) AS source_pages
        FROM og_mention_nodes GROUP BY ALL""",
    "og_edges": """
        SELECT edge_id, doc_id, src_id, tgt_id, relation, max(confidence) AS confidence,
               list_sort(list(DISTINCT page_id)) AS source_pages, min(page_id * 7 + l_partkey) AS vec_key,
               'semantic' AS edge_type, 'Line item that ' || relation || '.' AS description
        FROM og_mentions GROUP BY edge_id, doc_id, src_id, tgt_id, relation""",
    "og_same_as": f"""
        SELECT {_uuid('A:', "'ALIGN::' || src_id || '::' || tgt_id || '::same_as'")} AS edge_id, doc_id, src_id, tgt_id,
               'same_as' AS relation, max(confidence) AS confidence, list_sort(list(DISTINCT page_id)) AS source_pages,
               'same_as' AS edge_type, '' AS description
        FROM (SELECT m.tgt_id AS src_id, {_entity('doc_id', "(n.p_name || ' ' || n.p_partkey)")} AS tgt_id,
                     CASE WHEN l_linestatus = 'F' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, doc_id, page_id
              FROM og_mentions m JOIN part n ON n.p_partkey = (l_partkey + 1) % (SELECT count(*) FROM part)
              WHERE l_discount >= 0.095 AND l_tax >= 0.065)
        GROUP BY doc_id, src_id, tgt_id""",
    "og_judged": f"""
        SELECT {_uuid('A:', "'ALIGN::' || src_id || '::' || tgt_id || '::' || rel")} AS edge_id, src_id, tgt_id, rel AS relation,
               max(conf) AS confidence
        FROM (SELECT src_id, tgt_id, round(confidence - (CASE WHEN l_linenumber % 2 = 0 THEN 0.2::DOUBLE ELSE 0 END), 2) AS conf,
                     CASE l_returnflag WHEN 'N' THEN 'is_part_of' WHEN 'A' THEN 'supports' ELSE 'ships' END AS rel FROM og_mentions)
        GROUP BY src_id, tgt_id, rel""",
    "og_all_edges": """
        SELECT edge_id, doc_id, src_id, tgt_id, relation, confidence, source_pages, edge_type, description FROM og_edges
        UNION ALL SELECT edge_id, doc_id, src_id, tgt_id, relation, confidence, source_pages, edge_type, description FROM og_same_as""",
    "og_incidence": """
        SELECT DISTINCT 'entity:' || src_id AS evidence_id, 'entity' AS evidence_type, doc_id, page_id FROM og_mentions
        UNION SELECT 'entity:' || tgt_id, 'entity', doc_id, page_id FROM og_mentions
        UNION SELECT 'relation:' || edge_id, 'relation', doc_id, page_id FROM og_mentions""",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS v, count(*) OVER () AS n FROM embeddings",
    "og_keys": """
        SELECT 'page:' || doc_id || ':' || page_id AS evidence_id, 'page' AS evidence_type, doc_id, page_id AS k FROM og_pages
        UNION ALL SELECT DISTINCT 'entity:' || entity_id, 'entity', doc_id, vec_key FROM og_mention_nodes
        UNION ALL SELECT 'relation:' || edge_id, 'relation', doc_id, vec_key FROM og_edges""",
    "og_cards": """
        SELECT evidence_id, evidence_type, doc_id,
               list_transform(list_zip(a.v, b.v), lambda x: x[1] + 0.5::DOUBLE * x[2]) AS vector
        FROM og_keys JOIN vecs a ON k % a.n = a.vec_id JOIN vecs b ON (k // b.n + 1) % b.n = b.vec_id""",
    "og_questions": """
        SELECT item_id AS qid, text,
               list_transform(list_zip(a.v, b.v), lambda x: x[1] + 0.5::DOUBLE * x[2]) AS vector
        FROM benchmark JOIN vecs a ON (item_id * 37 + 5) % a.n = a.vec_id
        JOIN vecs b ON ((item_id * 37 + 5) // b.n + 1) % b.n = b.vec_id""",
    "og_cards_n": """
        SELECT evidence_id, evidence_type, doc_id, list_transform(vector, lambda x: x / nullif(nv, 0)) AS vector
        FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS nv FROM og_cards)""",
    "og_questions_n": """
        SELECT qid, text, list_transform(vector, lambda x: x / nullif(nv, 0)) AS vector
        FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS nv FROM og_questions)""",
}
_ORDER = list(VIEWS)


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the named views and all they need."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for v in _ORDER:
            if v not in need and _mentions(text, v):
                need.add(v)
                visit(VIEWS[v])

    import re

    def _mentions(text: str, name: str) -> bool:
        return re.search(rf"\b{name}\b", text) is not None

    visit(sql)
    for text in (extra or {}).values():
        visit(text)
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in _ORDER if v in need]
    parts += [f"{k} AS MATERIALIZED ({v})" for k, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, **extra: str) -> None:
    ORACLES[name] = with_views(sql, extra=extra)


_SEARCH = """
SELECT qid, evidence_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, evidence_id) AS rank FROM (
    SELECT q.qid, c.evidence_id, round(list_dot_product(q.vector, c.vector), 6) AS score
    FROM og_questions_n q CROSS JOIN og_cards_n c WHERE {where}))
WHERE rank <= {k}"""

oracle("anchor_pages", _SEARCH.format(where="c.evidence_type = 'page'", k=30))
oracle(
    "anchor_pages_by_document",
    _SEARCH.format(
        where="c.evidence_type = 'page' AND (q.qid % 3 = 0 OR c.doc_id = CASE q.qid % 3 WHEN 1 THEN 'ASIA' ELSE 'EUROPE' END)", k=30
    ),
)
oracle(
    "vector_topk_filtered",
    _SEARCH.format(where="c.evidence_type IN ('entity', 'relation') AND c.doc_id IN ('ASIA', 'EUROPE')", k=10),
)
oracle(
    "vector_topk_on_pages",
    _SEARCH.format(
        where="""c.evidence_id IN (SELECT i.evidence_id FROM og_incidence i JOIN og_pages p ON i.doc_id = p.doc_id AND i.page_id = p.page_id
    JOIN orders o ON p.page_id = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT')""", k=10,
    ),
)
oracle(
    "vector_lookup",
    """
SELECT o_orderkey AS pos, 'page:ASIA:' || o_orderkey AS evidence_id, c.evidence_id IS NOT NULL AS found, len(c.vector) AS dim, round(c.vector[1], 6) AS head
FROM orders LEFT JOIN og_cards c ON c.evidence_id = 'page:ASIA:' || o_orderkey""",
)
oracle(
    "vector_topk",
    """
SELECT qid, id, label, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT q.qid, e.vec_id AS id, e.label,
           round(list_dot_product(q.vector, e.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
    FROM og_questions_n q CROSS JOIN embeddings e)) WHERE rank <= 10""",
)

_LIST = "'[' || array_to_string({c}, ', ') || ']'"
oracle(
    "page_cards",
    """
SELECT 'page:' || doc_id || ':' || page_id AS evidence_id, doc_id, page_image_path AS image_payload,
       CASE WHEN page_image_path IS NOT NULL THEN '' ELSE
         '[PAGE]' || chr(10) || 'Document: ' || doc_id || chr(10) || 'Page number: ' || page_id || chr(10)
           || 'Snippet:' || chr(10) || text END AS text_payload
FROM og_pages""",
)
ENTITY_TEXT = (
    "'[ENTITY]' || chr(10) || 'Document: ' || doc_id || chr(10) || 'name: ' || name || chr(10) || 'entity_type: ' "
    "|| entity_type || chr(10) || 'modality: ' || modality || chr(10) || coalesce(CASE WHEN modality = 'visual' THEN "
    "'visual_type: ' || visual_type || chr(10) END, '') || 'description: ' || description || chr(10) || "
    "'mentioned_on_pages: ' || " + _LIST.format(c="source_pages")
)
oracle("entity_cards", f"SELECT 'entity:' || entity_id AS evidence_id, doc_id, {ENTITY_TEXT} AS text_payload FROM og_nodes")
RELATION_TEXT = (
    "'[RELATION]' || chr(10) || 'Document: ' || e.doc_id || chr(10) || 'head: ' || h.name || chr(10) || 'relation: ' "
    "|| relation || chr(10) || 'tail: ' || t.name || chr(10) || 'evidence: ' || e.description || chr(10) || "
    "'source_pages: ' || " + _LIST.format(c="e.source_pages")
)
_RELATION_CARDS = f"""
SELECT 'relation:' || edge_id AS evidence_id, e.doc_id, {RELATION_TEXT} AS text_payload
FROM og_edges e JOIN og_nodes h ON e.src_id = h.entity_id JOIN og_nodes t ON e.tgt_id = t.entity_id"""
oracle("relation_cards", _RELATION_CARDS)

# ---- expansion -----------------------------------------------------------------------

ANCHORS = """
SELECT qid, doc_id, page_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, evidence_id) AS rank FROM (
    SELECT q.qid, p.doc_id, p.page_id, c.evidence_id, round(list_dot_product(q.vector, c.vector), 6) AS score
    FROM og_questions_n q CROSS JOIN og_cards_n c JOIN og_pages p ON c.evidence_id = 'page:' || p.doc_id || ':' || p.page_id
    WHERE c.evidence_type = 'page')) WHERE rank <= 30"""


def expansion(rounds: int, beam: int, weight: float) -> dict[str, str]:
    """The expansion unrolled into one chain of views."""
    v = {
        "anch": ANCHORS,
        "bs": """SELECT q.qid, c.evidence_id, round(list_dot_product(q.vector, c.vector), 6) AS s
                 FROM og_questions_n q CROSS JOIN og_cards_n c WHERE c.evidence_type <> 'page'""",
        "f0": "SELECT DISTINCT qid, doc_id, page_id FROM anch",
    }
    for r in range(1, rounds + 1):
        v[f"t{r}"] = f"SELECT DISTINCT qid, evidence_id FROM f{r - 1} JOIN og_incidence USING (doc_id, page_id)"
        v[f"p{r}"] = (
            f"SELECT qid, doc_id, page_id, max(s) AS s FROM t{r} JOIN bs USING (qid, evidence_id) "
            "JOIN og_incidence USING (evidence_id) GROUP BY ALL"
        )
        v[f"f{r}"] = (
            "SELECT qid, doc_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, page_id, doc_id) "
            f"AS n FROM p{r}) WHERE n <= {beam}"
        )
    v["best"] = (
        "SELECT qid, doc_id, page_id, max(s) AS s FROM ("
        + " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(1, rounds + 1))
        + ") GROUP BY ALL"
    )
    v["cand"] = """
        SELECT qid, doc_id, page_id, coalesce(a.score, 0) AS a, b.s AS b,
               min(coalesce(a.score, 0)) OVER w AS alo, max(coalesce(a.score, 0)) OVER w AS ahi,
               min(b.s) OVER w AS blo, max(b.s) OVER w AS bhi
        FROM anch a FULL JOIN best b USING (qid, doc_id, page_id) WINDOW w AS (PARTITION BY qid)"""
    v["ranked"] = f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id, doc_id) AS rank FROM (
          SELECT qid, doc_id, page_id, round({weight}::DOUBLE * (CASE WHEN ahi <= alo THEN 1 ELSE (a - alo) / (ahi - alo) END)
            + (1 - {weight}::DOUBLE) * (CASE WHEN b IS NULL THEN 0 WHEN bhi <= blo THEN 1 ELSE (b - blo) / (bhi - blo) END), 6) AS score
          FROM cand)) WHERE rank <= {beam}"""
    v["touched"] = " UNION ".join(f"SELECT * FROM t{r}" for r in range(1, rounds + 1))
    v["node_scores"] = "SELECT qid, evidence_id, greatest(s, 0) AS score FROM touched JOIN bs USING (qid, evidence_id)"
    return v


_EXP = expansion(2, 50, 0.7)
oracle(
    "expanded_pages",
    """SELECT qid, doc_id, page_id, score, CAST(rank AS INTEGER) AS rank, page_image_path
       FROM ranked JOIN og_pages USING (doc_id, page_id)""",
    **_EXP,
)
oracle("expanded_bridge_scores", "SELECT qid, evidence_id, score FROM node_scores", **_EXP)

_ITEMS = {
    **_EXP,
    "per_page": """
        SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.doc_id, i.page_id, evidence_type ORDER BY evidence_id) AS n
        FROM og_incidence i WHERE (i.doc_id, i.page_id) IN (SELECT (doc_id, page_id) FROM ranked)) WHERE n <= 4""",
    "deck": f"""
        SELECT 'entity:' || entity_id AS evidence_id, {ENTITY_TEXT} AS payload, source_pages FROM og_nodes
        UNION ALL SELECT evidence_id, text_payload, source_pages FROM (
          SELECT 'relation:' || edge_id AS evidence_id, {RELATION_TEXT} AS text_payload, e.source_pages
          FROM og_edges e JOIN og_nodes h ON e.src_id = h.entity_id JOIN og_nodes t ON e.tgt_id = t.entity_id)""",
    "bodies": """
        SELECT evidence_id, source_pages, array_to_string(list_filter(string_split(payload, chr(10)),
          lambda x: x <> '' AND NOT starts_with(x, '[ENTITY]') AND NOT starts_with(x, '[RELATION]') AND NOT starts_with(x, 'Document:')), ' ') AS body
        FROM deck""",
    "raw_items": """
        SELECT qid, 'page' AS type, '[p' || page_id || '] ' || page_summary AS text, 'page:' || doc_id || ':' || page_id AS source_id,
               'page:' || doc_id || ':' || page_id AS card_id, [page_id] AS page_ids, rank, 0 AS slot, 0 AS n
        FROM ranked JOIN og_pages USING (doc_id, page_id) WHERE page_summary IS NOT NULL
        UNION ALL
        SELECT qid, 'page', '[p' || page_id || '] text: ' || text, 'page_text:' || doc_id || ':' || page_id,
               'page:' || doc_id || ':' || page_id, [page_id], rank, 1, 0
        FROM ranked JOIN og_pages USING (doc_id, page_id)
        UNION ALL
        SELECT qid, evidence_type, '[p' || page_id || '] ' || body, evidence_id, evidence_id, source_pages, rank,
               CASE WHEN evidence_type = 'entity' THEN 2 ELSE 3 END, n
        FROM ranked JOIN per_page USING (doc_id, page_id) JOIN bodies USING (evidence_id)""",
    "once": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY rank, slot, n) AS k FROM raw_items) WHERE k = 1""",
    "items": """
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, slot, n) AS seq FROM (
          SELECT o.qid, type, o.text, source_id, page_ids, rank, slot, o.n,
                 round(0.7::DOUBLE * coalesce(ns.score, 0) / (CASE WHEN coalesce(top, 0) = 0 THEN 1 ELSE top END)
                   + (1 - 0.7::DOUBLE) * greatest(round(list_dot_product(q.vector, c.vector), 6), 0), 6) AS score
          FROM once o JOIN og_cards_n c ON c.evidence_id = o.card_id JOIN og_questions_n q ON q.qid = o.qid
          LEFT JOIN node_scores ns ON ns.qid = o.qid AND ns.evidence_id = o.source_id
          LEFT JOIN (SELECT qid, max(score) AS top FROM node_scores GROUP BY qid) m ON m.qid = o.qid)""",
}
oracle("text_items", "SELECT qid, type, text, source_id, score, CAST(seq AS INTEGER) AS seq FROM items", **_ITEMS)
oracle(
    "evidence_within_budget",
    """
SELECT qid, string_agg(printf('%d. [%s; p%03d; score=%.3f] %s', seq, type, page_ids[1], round(score, 3), text), chr(10) ORDER BY seq) AS evidence
FROM (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY qid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS used FROM items)
WHERE seq = 1 OR used <= 2000 GROUP BY qid""",
    **_ITEMS,
)
oracle(
    "reranked_pages",
    """
SELECT qid, doc_id, page_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN p <= 10 THEN 0 ELSE 1 END,
       CASE WHEN p <= 10 THEN p ELSE rank END) AS INTEGER) AS rank
FROM (SELECT *, CASE WHEN cand AND n_cand > 1 THEN row_number() OVER (PARTITION BY qid, cand ORDER BY rs DESC, rank) END AS p
      FROM (SELECT *, count(*) FILTER (cand) OVER (PARTITION BY qid) AS n_cand
            FROM (SELECT r.qid, r.doc_id, r.page_id, r.rank,
                         round(((o_totalprice * 100 + qid * 977) % 1000) / 1000, 3) AS rs,
                         page_image_path IS NOT NULL AND count(page_image_path) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 20 AS cand
                  FROM ranked r JOIN og_pages USING (doc_id, page_id) JOIN orders ON o_orderkey = page_id)))""",
    **_EXP,
)

# ---- retrieval graph -------------------------------------------------------------------

RG = {
    "rel": """
        SELECT e.*, h.name AS head_name, t.name AS tail_name, h.entity_id IS NOT NULL AS hk, t.entity_id IS NOT NULL AS tk
        FROM og_all_edges e LEFT JOIN og_nodes h ON e.src_id = h.entity_id LEFT JOIN og_nodes t ON e.tgt_id = t.entity_id""",
    "on_page": """
        SELECT 'entity:' || entity_id AS me, 'entity' AS kind, doc_id, unnest(source_pages) AS page_id FROM og_nodes
        UNION ALL SELECT 'relation:' || edge_id, 'relation', doc_id, unnest(source_pages) FROM rel WHERE edge_type <> 'same_as'""",
    "pg": "SELECT me, kind, 'page:' || p.doc_id || ':' || p.page_id AS page FROM on_page JOIN og_pages p USING (doc_id, page_id)",
    "rge": """
        SELECT page AS src, me AS dst, CASE kind WHEN 'entity' THEN 'page_mentions_entity' ELSE 'page_supports_relation' END AS edge_type FROM pg
        UNION ALL SELECT me, page, CASE kind WHEN 'entity' THEN 'entity_source_page' ELSE 'relation_source_page' END FROM pg
        UNION ALL SELECT 'relation:' || edge_id, 'entity:' || src_id, 'relation_head_entity' FROM rel WHERE hk AND edge_type <> 'same_as'
        UNION ALL SELECT 'entity:' || src_id, 'relation:' || edge_id, 'entity_head_relation' FROM rel WHERE hk AND edge_type <> 'same_as'
        UNION ALL SELECT 'relation:' || edge_id, 'entity:' || tgt_id, 'relation_tail_entity' FROM rel WHERE tk AND src_id <> tgt_id AND edge_type <> 'same_as'
        UNION ALL SELECT 'entity:' || tgt_id, 'relation:' || edge_id, 'entity_tail_relation' FROM rel WHERE tk AND src_id <> tgt_id AND edge_type <> 'same_as'
        UNION ALL SELECT 'entity:' || src_id, 'entity:' || tgt_id, 'same_as' FROM rel WHERE hk AND tk AND src_id <> tgt_id AND edge_type = 'same_as'
        UNION ALL SELECT 'entity:' || tgt_id, 'entity:' || src_id, 'same_as' FROM rel WHERE hk AND tk AND src_id <> tgt_id AND edge_type = 'same_as'""",
}
oracle("retrieval_graph_edges", "SELECT src, dst, edge_type, 1.0::DOUBLE AS weight FROM rge", **RG)
oracle(
    "retrieval_graph_nodes",
    """
SELECT 'page:' || doc_id || ':' || page_id AS external_id, 'page' AS node_type, doc_id, CAST(page_id AS VARCHAR) AS pages, NULL AS head_name, NULL AS name FROM og_pages
UNION ALL SELECT 'entity:' || entity_id, 'entity', doc_id, array_to_string(source_pages, ','), NULL, name FROM og_nodes
UNION ALL SELECT 'relation:' || edge_id, 'relation', doc_id, array_to_string(source_pages, ','), coalesce(head_name, '?'), NULL FROM rel WHERE edge_type <> 'same_as'""",
    **RG,
)
oracle(
    "retrieval_graph_stats",
    """
SELECT (SELECT count(*) FROM og_pages) AS n_pages, (SELECT count(*) FROM og_nodes) AS n_entities,
       (SELECT count(*) FROM og_edges) AS n_relations, (SELECT count(*) FROM rge) AS n_edges,
       (SELECT count(*) FROM rel WHERE edge_type = 'same_as' AND hk AND tk AND src_id <> tgt_id) AS n_same_as_pairs,
       (SELECT count(*) FROM rel WHERE edge_type = 'same_as' AND NOT (hk AND tk AND src_id <> tgt_id)) AS n_same_as_dropped""",
    **RG,
)
oracle(
    "graph_reads",
    """
SELECT external_id, degree, n_entities, n_relations, n_pages, first_page FROM
  (SELECT src AS external_id, count(*) AS degree FROM rge GROUP BY src)
  LEFT JOIN (SELECT page AS external_id, count(DISTINCT me) AS n_entities FROM pg WHERE kind = 'entity' GROUP BY page) USING (external_id)
  LEFT JOIN (SELECT page AS external_id, count(DISTINCT me) AS n_relations FROM pg WHERE kind = 'relation' GROUP BY page) USING (external_id)
  LEFT JOIN (SELECT me AS external_id, count(DISTINCT page) AS n_pages, min(page) AS first_page FROM pg GROUP BY me) USING (external_id)""",
    **RG,
)


def walk(depth: int, cap: int) -> dict[str, str]:
    """Bounded search, one view per level."""
    v = {
        **RG,
        "anch": ANCHORS,
        "links": "SELECT DISTINCT src, dst FROM rge",
        "s0": "SELECT qid, 'page:' || doc_id || ':' || page_id AS node, 0 AS depth FROM anch",
    }
    for d in range(1, depth + 1):
        v[f"r{d}"] = (
            f"SELECT DISTINCT qid, dst AS node FROM s{d - 1} JOIN links ON node = src WHERE depth = {d - 1} "
            f"EXCEPT SELECT qid, node FROM s{d - 1}"
        )
        v[f"s{d}"] = (
            f"SELECT qid, node, depth FROM s{d - 1} UNION ALL SELECT qid, node, {d} FROM ("
            f"SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY node) AS n FROM r{d}) "
            f"JOIN (SELECT qid, count(*) AS used FROM s{d - 1} GROUP BY qid) USING (qid) WHERE n + used <= {cap}"
        )
    return v


oracle("bounded_neighbourhood", "SELECT qid, node, CAST(depth AS INTEGER) AS depth FROM s3", **walk(3, 1000))


def pagerank(depth: int, cap: int, iters: int) -> dict[str, str]:
    v = {
        **walk(depth, cap),
        "seed": """SELECT s.qid, s.node, greatest(coalesce(a.score, 0), 0) / sum(greatest(coalesce(a.score, 0), 0)) OVER (PARTITION BY s.qid) AS s
                   FROM s%d s LEFT JOIN anch a ON a.qid = s.qid AND 'page:' || a.doc_id || ':' || a.page_id = s.node""" % depth,
        "ie": """SELECT qid, src, dst, 1.0::DOUBLE / sum(n) OVER (PARTITION BY qid, src) AS w FROM (
                   SELECT a.qid, e.src, e.dst, count(*) AS n FROM s%d a JOIN rge e ON e.src = a.node
                   JOIN s%d b ON b.qid = a.qid AND b.node = e.dst GROUP BY ALL)""" % (depth, depth),
        "dang": "SELECT qid, node FROM seed EXCEPT SELECT qid, src FROM ie",
        "m0": "SELECT qid, node, s, s AS r FROM seed",
    }
    for i in range(1, iters + 1):
        v[f"m{i}"] = f"""
            SELECT m.qid, m.node, m.s, 0.15::DOUBLE * m.s + 0.85::DOUBLE * coalesce(f, 0) + 0.85::DOUBLE * coalesce(d, 0) * m.s AS r
            FROM m{i - 1} m
            LEFT JOIN (SELECT ie.qid, ie.dst, sum(x.r * w) AS f FROM ie JOIN m{i - 1} x ON x.qid = ie.qid AND x.node = ie.src GROUP BY ALL) fl
              ON fl.qid = m.qid AND fl.dst = m.node
            LEFT JOIN (SELECT x.qid, sum(x.r) AS d FROM dang JOIN m{i - 1} x ON x.qid = dang.qid AND x.node = dang.node GROUP BY ALL) dd
              ON dd.qid = m.qid"""
    v["pm"] = f"""SELECT m.qid, p.doc_id, p.page_id, m.r AS mass FROM m{iters} m JOIN og_pages p ON m.node = 'page:' || p.doc_id || ':' || p.page_id"""
    v["pc"] = """SELECT qid, doc_id, page_id, coalesce(score, 0) AS a, coalesce(mass, 0) AS b,
                 min(coalesce(score, 0)) OVER w AS alo, max(coalesce(score, 0)) OVER w AS ahi,
                 min(coalesce(mass, 0)) OVER w AS blo, max(coalesce(mass, 0)) OVER w AS bhi
                 FROM anch FULL JOIN pm USING (qid, doc_id, page_id) WINDOW w AS (PARTITION BY qid)"""
    return v


oracle(
    "pagerank_pages",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id, doc_id) AS INTEGER) AS rank FROM (
         SELECT qid, doc_id, page_id, round(0.7::DOUBLE * (CASE WHEN ahi <= alo THEN 1 ELSE (a - alo) / (ahi - alo) END)
           + (1 - 0.7::DOUBLE) * (CASE WHEN bhi <= blo THEN 1 ELSE (b - blo) / (bhi - blo) END), 6) AS score FROM pc)) WHERE rank <= 50""",
    **pagerank(3, 1000, 8),
)


# ---- ids and text rules --------------------------------------------------------------------

oracle("entity_ids", "SELECT entity_id, doc_id, name, len(source_pages) AS n_pages FROM og_nodes")
oracle("edge_ids", "SELECT edge_id, src_id, tgt_id, relation, confidence, len(source_pages) AS n_pages FROM og_edges")
oracle(
    "normalized_relations",
    r"""
SELECT raw, count(*) AS n, any_value(CASE WHEN length(r) > 80 THEN '' ELSE r END) AS relation FROM (
  SELECT raw, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[ \t/\\(){}\[\]''"`,;:!?-]', '_', 'g'), '_{2,}', '_', 'g'), '_') AS r
  FROM (SELECT ' Is (' || o_orderpriority || ') - ' || o_orderstatus || '/ordered; By! ' AS raw FROM orders)) GROUP BY raw""",
)
_STOP = "['to','of','by','for','in','on','at','with','as','the','a','an','is','are','be','being','been','was','were','and','or','that','which','this','these','those','can','could','should','would','may','might','will','shall']"
_STEM = "^(.{3,}?)(?:ization|ational|fulness|ousness|iveness|ication|iciency|ation|ement|ities|iness|ence|ance|ment|ness|tion|sion|ing|est|ity|or|er|ed|es|ly|al|ic|s)$"
_STEM_CALL = r"regexp_replace(w, '" + _STEM + r"', '\1')"
TOKENS = (
    r"list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(translate(lower(@c@), '-_', '  '), '\s+'), "
    f"lambda w: NOT list_contains({_STOP}, w)), lambda w: {_STEM_CALL}), lambda w: length(w) >= 3)))"
)
oracle(
    "document_token_sets",
    f"SELECT doc_id, len(tok) AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.replace('@c@', 'text')} AS tok FROM documents)",
)
_FRAG_STOP = "['the','a','an','of','to','in','on','for','by','at','with','as','is','are','was','were','be','been','being','and','or','that','which','this','these','those','it','its']"
_FRAG_STEM = _STEM.replace("|iciency", "")
COMPACT = {
    "frags": r"""
        SELECT doc_id, unnest(f) AS frag, generate_subscripts(f, 1) AS i FROM (
          SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1<SEP>', 'g'), '<SEP>'),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS f FROM documents)""",
    "toks": rf"""
        SELECT *, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(frag), '[a-z0-9]+'),
               lambda w: length(w) >= 3 AND NOT list_contains({_FRAG_STOP}, w)), lambda w: regexp_replace(w, '{_FRAG_STEM}', '\1')))) AS tk,
               max(i) OVER (PARTITION BY doc_id, frag) AS last_i, count(*) OVER (PARTITION BY doc_id) AS n_frag
        FROM frags""",
    "reps": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tk ORDER BY length(frag) DESC, i) AS rn FROM toks WHERE len(tk) > 0) WHERE rn = 1""",
    "inner_sets": """
        SELECT DISTINCT a.doc_id, a.tk FROM (SELECT doc_id, tk, unnest(tk) AS w FROM reps) a
        JOIN (SELECT doc_id, tk, unnest(tk) AS w FROM reps) b ON a.doc_id = b.doc_id AND a.w = b.w AND len(b.tk) > len(a.tk)
        GROUP BY a.doc_id, a.tk, b.tk HAVING count(*) = len(a.tk)""",
    "kept": """
        SELECT doc_id, string_agg(frag, ' ' ORDER BY last_i) AS k FROM reps
        WHERE NOT EXISTS (SELECT 1 FROM inner_sets s WHERE s.doc_id = reps.doc_id AND s.tk = reps.tk) GROUP BY doc_id""",
}
oracle(
    "compacted_documents",
    r"""
SELECT doc_id, length(k) AS n_chars, md5(k) AS digest FROM (
  SELECT d.doc_id, CASE WHEN coalesce(n, 0) < 2 THEN regexp_replace(d.text, '^\s+|\s+$', '', 'g') ELSE coalesce(kept.k, '') END AS k
  FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM frags GROUP BY doc_id) c ON c.doc_id = d.doc_id)""",
    **COMPACT,
)


def _postings(table: str, key: str) -> str:
    return (
        f"SELECT {key}, slot, sum(sign) AS w FROM (SELECT {key}, h % 256 AS slot, CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END AS sign "
        f"FROM (SELECT {key}, ('0x' || substr(md5(tok), 1, 16))::UBIGINT AS h FROM (SELECT {key}, "
        rf"unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS tok FROM {table}))) GROUP BY ALL HAVING sum(sign) <> 0"
    )


oracle(
    "hashed_text_search",
    """
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, id, round(CAST(dot AS DOUBLE) / sqrt(CAST(qq AS DOUBLE) * CAST(dd AS DOUBLE)), 6) AS score
    FROM (SELECT q.item_id AS qid, d.doc_id AS id, sum(q.w * d.w) AS dot FROM qp q JOIN dp d USING (slot) GROUP BY ALL)
    JOIN (SELECT item_id AS qid, sum(w * w) AS qq FROM qp GROUP BY ALL) USING (qid)
    JOIN (SELECT doc_id AS id, sum(w * w) AS dd FROM dp GROUP BY ALL) USING (id))) WHERE rank <= 5""",
    qp=_postings("benchmark", "item_id"),
    dp=_postings("documents", "doc_id"),
)

# ---- graph clean-up ------------------------------------------------------------------------

_DUP = {
    "ranked": f"""
        SELECT *, row_number() OVER (PARTITION BY src_id, tgt_id ORDER BY len(tk) DESC, confidence DESC, length(relation) DESC, edge_id) AS rn
        FROM (SELECT *, {TOKENS.replace('@c@', 'relation')} AS tk FROM og_edges)""",
    "covered": """
        SELECT a.edge_id, b.edge_id AS rep_id, b.rn AS rep_rn FROM ranked a JOIN ranked b
        ON a.src_id = b.src_id AND a.tgt_id = b.tgt_id AND b.rn < a.rn AND list_has_all(b.tk, a.tk)""",
    "reps": "SELECT * FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.edge_id = r.edge_id)",
    "member": """
        SELECT edge_id, edge_id AS rep_id FROM reps
        UNION ALL SELECT c.edge_id, arg_min(c.rep_id, c.rep_rn) FROM covered c JOIN reps ON reps.edge_id = c.rep_id GROUP BY c.edge_id""",
    "texts": """
        SELECT rep_id, string_agg(description, ' ' ORDER BY rn) AS description FROM (
          SELECT rep_id, description, min(rn) AS rn FROM member JOIN ranked USING (edge_id) GROUP BY ALL) GROUP BY rep_id""",
}
oracle(
    "near_duplicate_collapse",
    """
SELECT r.edge_id, r.src_id, r.tgt_id, r.relation, r.confidence, left(t.description, 4000) AS description,
       array_to_string(p.pages, ',') AS pages
FROM reps r JOIN texts t ON t.rep_id = r.edge_id
JOIN (SELECT rep_id, list_sort(list_distinct(flatten(list(source_pages)))) AS pages FROM member JOIN og_edges USING (edge_id) GROUP BY rep_id) p
  ON p.rep_id = r.edge_id""",
    **_DUP,
)
oracle(
    "orphan_edges_dropped",
    "SELECT edge_id, src_id, tgt_id FROM og_same_as WHERE src_id IN (SELECT entity_id FROM og_nodes) AND tgt_id IN (SELECT entity_id FROM og_nodes)",
)
_TEXT_TYPES = "('person','organization','group','location','event','date','work_of_art','product','scientific_concept','chapter','section','unit','assessment_type')"
_VIS_TYPES = "('visual_object','chart_element','diagram_component','table_region','layout_region','figure_panel')"
oracle(
    "sanitized_types",
    f"""
SELECT entity_id, modality, CASE WHEN et IN {_TEXT_TYPES} OR et IN {_VIS_TYPES} THEN et ELSE 'other' END AS entity_type,
       CASE WHEN modality = 'visual' AND visual_type NOT IN {_VIS_TYPES} THEN NULL ELSE visual_type END AS visual_type
FROM (SELECT *, CASE WHEN modality = 'visual' AND entity_type IN {_TEXT_TYPES}
                     THEN CASE WHEN visual_type IN {_VIS_TYPES} THEN visual_type ELSE 'visual_object' END ELSE entity_type END AS et FROM og_nodes)""",
)

_CC = """
WITH RECURSIVE e AS MATERIALIZED (SELECT src_id AS a, tgt_id AS b FROM {edges} UNION SELECT tgt_id, src_id FROM {edges}),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS component FROM reach GROUP BY a"""


def recursive(name: str, body: str, **extra: str) -> None:
    """Like :func:`oracle`, for a body whose closure sits in a nested WITH RECURSIVE."""
    oracle(name, body, **extra)


recursive("same_as_components", "SELECT * FROM comp", comp=_CC.format(edges="og_same_as"))
_CANON = {
    "ok_links": """SELECT src_id, tgt_id FROM og_same_as WHERE confidence >= 0.9 AND src_id IN (SELECT entity_id FROM og_nodes)
                   AND tgt_id IN (SELECT entity_id FROM og_nodes)""",
    "comp": _CC.format(edges="ok_links"),
    "cm": "SELECT n.*, coalesce(c.component, n.entity_id) AS component FROM og_nodes n LEFT JOIN comp c ON c.id = n.entity_id",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY component ORDER BY len(source_pages) DESC, length(description) DESC, lower(name), entity_id) AS rn,
                  count(*) OVER (PARTITION BY component) AS members FROM cm""",
    "head": "SELECT component, entity_id AS canonical_id FROM ordered WHERE rn = 1",
    "canon": "SELECT o.entity_id, h.canonical_id FROM ordered o JOIN head h USING (component)",
    "moved": """SELECT e.edge_id, coalesce(s.canonical_id, e.src_id) AS src_id, coalesce(t.canonical_id, e.tgt_id) AS tgt_id, relation, confidence, source_pages
                FROM og_edges e LEFT JOIN canon s ON s.entity_id = e.src_id LEFT JOIN canon t ON t.entity_id = e.tgt_id""",
}
oracle(
    "canonical_nodes",
    """
SELECT h.canonical_id AS entity_id, first(name ORDER BY rn) AS name, first(entity_type ORDER BY rn) AS entity_type, max(modality) AS modality,
       last(visual_type ORDER BY rn) FILTER (visual_type IS NOT NULL) AS visual_type, max(members) AS members,
       array_to_string(list_sort(list_distinct(flatten(list(source_pages)))), ',') AS pages
FROM ordered JOIN head h USING (component) GROUP BY h.canonical_id""",
    **_CANON,
)
oracle(
    "canonical_edges",
    """
SELECT min(edge_id) AS edge_id, src_id, tgt_id, first(relation ORDER BY edge_id) AS relation, max(confidence) AS confidence,
       array_to_string(list_sort(list_distinct(flatten(list(source_pages)))), ',') AS pages
FROM moved WHERE src_id <> tgt_id GROUP BY src_id, tgt_id, lower(trim(relation))""",
    **_CANON,
)

# ---- alignment -----------------------------------------------------------------------------

oracle(
    "cross_page_candidates",
    """
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score
    FROM ev a JOIN ev b ON a.vec_id % 50 <> b.vec_id % 50)) WHERE rank <= 20""",
    ev="SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings",
)
_GENERIC = "('is_part_of','part_of','supports_claim','supports','is_related_to','relates_to','related_to','is_associated_with','associated_with','includes','is_included_in','is_linked_to','linked_to')"
oracle(
    "hub_filtered_edges",
    f"""
SELECT edge_id, src_id, tgt_id, relation, confidence FROM og_judged WHERE NOT (relation IN {_GENERIC} AND tgt_id IN (
  SELECT tgt_id FROM og_judged WHERE relation IN {_GENERIC} GROUP BY tgt_id HAVING count(*) >= 5))""",
)
oracle(
    "strong_edges",
    """
SELECT edge_id, src_id, tgt_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY least(src_id, tgt_id), greatest(src_id, tgt_id) ORDER BY confidence DESC, edge_id) AS rn
  FROM og_judged WHERE confidence >= 0.9) j
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM og_edges e WHERE e.relation = 'is shipping returned' AND least(e.src_id, e.tgt_id) = least(j.src_id, j.tgt_id)
                             AND greatest(e.src_id, e.tgt_id) = greatest(j.src_id, j.tgt_id))""",
)
oracle(
    "judge_decisions",
    f"""
SELECT {_uuid('A:', "'ALIGN::' || src_id || '::' || tgt_id || '::' || relation")} AS edge_id, src_id, tgt_id, relation, edge_type, confidence,
       array_to_string(list_sort(list_distinct(list_concat(p1, p2))), ',') AS pages
FROM (SELECT e.src_id, e.tgt_id, CASE WHEN e.confidence >= 0.9 THEN 'same_as' ELSE 'sold_next_to' END AS relation,
             CASE WHEN e.confidence >= 0.9 THEN 'same_as' ELSE 'semantic' END AS edge_type, e.confidence, s.source_pages AS p1, t.source_pages AS p2,
             s.entity_type AS et1, t.entity_type AS et2
      FROM og_same_as e JOIN og_nodes s ON e.src_id = s.entity_id JOIN og_nodes t ON e.tgt_id = t.entity_id)
WHERE edge_type = 'semantic' OR et1 = et2""",
)
