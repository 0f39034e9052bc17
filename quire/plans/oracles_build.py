"""DuckDB SQL for layout, patch, statistics, store and reply queries."""

from __future__ import annotations

from quire.plans.oracles import ORACLES, _entity, _uuid, oracle

_LINES = {
    "lines0": r"""
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM (
          SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS l FROM documents)""",
    "blocks": r"""
        SELECT *, CASE WHEN i % 13 = 7 THEN 'page_footer' WHEN i % 11 = 5 THEN 'image' WHEN i % 7 = 3 THEN 'list'
                       WHEN length(x) < 40 THEN 'title' ELSE 'text' END AS type,
               CAST(i % 2 * 50 AS DOUBLE) AS x0, CAST(i * 12 + i % 3 AS DOUBLE) AS y0,
               CAST(i % 2 * 50 + 100 + length(x) % 50 AS DOUBLE) AS x1, CAST(i * 12 + i % 3 + 10 AS DOUBLE) AS y1,
               regexp_replace(x, '^\s+|\s+$', '', 'g') AS text_full FROM lines0""",
    "comps": """
        SELECT *, pre || row_number() OVER (PARTITION BY doc_id, pre ORDER BY i) AS component_id FROM (
          SELECT *, CASE type WHEN 'title' THEN 'T' WHEN 'text' THEN 'P' WHEN 'list' THEN 'L' ELSE 'IM' END AS pre
          FROM blocks WHERE type <> 'page_footer')""",
    "hints": """
        SELECT * FROM (VALUES ('title', 'section/subsection title'), ('text', 'body text'), ('list', 'bulleted/numbered list'),
          ('image', 'visual candidate; possible photo, figure, diagram, or chart')) h(type, role_hint)""",
}
oracle(
    "layout_components",
    """SELECT doc_id, component_id, type, x0, y0, x1, y1, text_full, role_hint, CAST(i AS INTEGER) AS ord FROM comps JOIN hints USING (type)""",
    **_LINES,
)
oracle(
    "page_texts",
    r"""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS page_id, md5(coalesce(t, '')) AS digest, coalesce(n, 0) AS n_blocks
FROM documents d LEFT JOIN (SELECT doc_id, regexp_replace(string_agg(x, ' ' ORDER BY i), '^\s+|\s+$', '', 'g') AS t, count(*) AS n FROM lines0 GROUP BY doc_id) l
  ON l.doc_id = CAST(d.doc_id AS VARCHAR)""",
    **_LINES,
)
_NEAR = {
    **_LINES,
    "cen": "SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, 300.0::DOUBLE AS w, (n * 12 + 20)::DOUBLE AS h FROM comps",
    "sides": """
        SELECT a.doc_id, a.component_id, b.component_id AS other, b.i AS bi, sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2) AS d,
               CASE WHEN abs(b.cy - a.cy) >= abs(b.cx - a.cx) THEN CASE WHEN b.cy < a.cy THEN 'above' ELSE 'below' END
                    ELSE CASE WHEN b.cx < a.cx THEN 'left' ELSE 'right' END END AS side
        FROM cen a JOIN cen b ON a.doc_id = b.doc_id AND a.i <> b.i""",
    "near": "SELECT doc_id, component_id, side, other FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, component_id, side ORDER BY d, bi) AS rn FROM sides) WHERE rn = 1",
}
oracle(
    "annotated_components",
    """
SELECT c.doc_id, c.component_id, (CASE WHEN cy < h / 3 THEN 'upper' WHEN cy > 2 * h / 3 THEN 'lower' ELSE 'middle' END) || '-' ||
       (CASE WHEN cx < w / 3 THEN 'left' WHEN cx > 2 * w / 3 THEN 'right' ELSE 'center' END) AS position,
       a."above", a."below", a."left", a."right"
FROM cen c LEFT JOIN (SELECT doc_id, component_id, max(other) FILTER (side = 'above') AS "above", max(other) FILTER (side = 'below') AS "below",
                             max(other) FILTER (side = 'left') AS "left", max(other) FILTER (side = 'right') AS "right" FROM near GROUP BY ALL) a
  USING (doc_id, component_id)""",
    **_NEAR,
)
_MERGE = {
    **_LINES,
    "srt": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, i) AS rn, greatest(20, floor((n * 12 + 20) * 0.03)) AS gap FROM comps",
    "folded": """
        WITH RECURSIVE f AS (
          SELECT doc_id, rn, rn AS grp, type, x0, y0, x1, y1 FROM srt WHERE rn = 1
          UNION ALL
          SELECT s.doc_id, s.rn, CASE WHEN j THEN f.grp ELSE s.rn END, s.type,
                 CASE WHEN j THEN least(f.x0, s.x0) ELSE s.x0 END, CASE WHEN j THEN least(f.y0, s.y0) ELSE s.y0 END,
                 CASE WHEN j THEN greatest(f.x1, s.x1) ELSE s.x1 END, CASE WHEN j THEN greatest(f.y1, s.y1) ELSE s.y1 END
          FROM f JOIN srt s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1,
          LATERAL (SELECT f.type = s.type AND s.type <> 'image' AND s.y0 - f.y1 <= s.gap AND s.y0 - f.y1 >= -2
                     AND greatest(0, least(f.x1, s.x1) - greatest(f.x0, s.x0)) / least(f.x1 - f.x0, s.x1 - s.x0) >= 0.5 AS j))
        SELECT * FROM f""",
    "grouped": """
        SELECT f.doc_id, f.grp, any_value(f.type) AS type, min(s.x0) AS x0, min(s.y0) AS y0, max(s.x1) AS x1, max(s.y1) AS y1,
               count(*) AS n_blocks, string_agg(s.text_full, ' ' ORDER BY f.rn) AS txt, any_value(pre) AS pre
        FROM folded f JOIN srt s ON s.doc_id = f.doc_id AND s.rn = f.rn GROUP BY f.doc_id, f.grp""",
    "final": "SELECT *, pre || row_number() OVER (PARTITION BY doc_id, pre ORDER BY grp) AS component_id FROM grouped",
}
oracle(
    "merged_components",
    "SELECT doc_id, component_id, type, x0, y0, x1, y1, n_blocks > 1 AS merged, n_blocks, md5(txt) AS digest FROM final",
    **_MERGE,
)
oracle(
    "component_manifests",
    """
SELECT doc_id, length(m) AS n_chars, md5(m) AS digest FROM (
  SELECT doc_id, string_agg('- ' || component_id || ' (' || type || ', ' || position || ')' || chr(10) || '    role: ' || role_hint || chr(10) ||
    CASE WHEN type = 'list' THEN '    [saturated: ' || ((rn - 1) % 4) || ' nodes already grounded here, use them only as edge endpoints]'
         WHEN type = 'image' THEN '    content: <image - see annotated page>'
         ELSE '    text: ' || text_full END, chr(10) ORDER BY i) AS m
  FROM (SELECT c.*, h.role_hint, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn,
               (CASE WHEN cy < h / 3 THEN 'upper' WHEN cy > 2 * h / 3 THEN 'lower' ELSE 'middle' END) || '-' ||
               (CASE WHEN cx < w / 3 THEN 'left' WHEN cx > 2 * w / 3 THEN 'right' ELSE 'center' END) AS position
        FROM cen c JOIN hints h USING (type)) GROUP BY doc_id)""",
    **{k: v for k, v in _NEAR.items() if k not in ("sides", "near")},
)

# ---- patches ---------------------------------------------------------------------------------

_PATCH = {
    "m": """SELECT *, 'P' || l_linenumber AS cid, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS ord,
                   l_linenumber <= 5 AS hit, EXISTS (SELECT 1 FROM og_mentions x WHERE x.page_id = og_mentions.page_id AND x.l_linenumber = og_mentions.l_linenumber AND x.l_linenumber <= 5) AS ok
            FROM og_mentions""",
    "adds": "SELECT doc_id, page_id, lower(part_name) AS key, part_name AS name, ord, [cid] AS sc FROM m WHERE l_tax > 0 AND hit",
    "cur": """SELECT doc_id, page_id, lower(supplier_name) AS key, supplier_name AS name, arg_max(CASE WHEN l_linestatus = 'O' THEN 'entity' ELSE 'organization' END, ord) AS et,
                     [arg_max(cid, ord)] AS sc, max(ord) AS ord FROM m WHERE l_returnflag = 'A' GROUP BY ALL""",
    "swaps": """SELECT s.*, c.et AS old, c.key IS NULL AS fresh, row_number() OVER (PARTITION BY s.page_id, s.key ORDER BY s.ord) AS turn
                FROM (SELECT doc_id, page_id, lower(supplier_name) AS key, supplier_name AS name, ord, [cid] AS sc FROM m WHERE l_returnflag = 'R' AND hit) s
                LEFT JOIN cur c ON c.page_id = s.page_id AND c.key = s.key""",
    "fate": "SELECT *, CASE WHEN fresh AND turn = 1 THEN 'demote' WHEN fresh OR old = 'organization' THEN 'drop' ELSE 'keep' END AS f FROM swaps",
    "known0": """
        SELECT page_id, key, sc, -1 AS tier, -ord AS at_ FROM fate WHERE f = 'keep' UNION ALL SELECT page_id, key, sc, 0, -ord FROM cur
        UNION ALL SELECT page_id, key, sc, 1, ord FROM adds UNION ALL SELECT page_id, key, sc, 2, ord FROM fate WHERE f = 'demote'""",
    "known": "SELECT page_id, key, sc FROM (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY tier, at_) AS rn FROM known0) WHERE rn = 1",
    "valid": "SELECT page_id, list(DISTINCT cid) AS v FROM m WHERE hit GROUP BY page_id",
    "edges0": """
        SELECT m.*, lower(supplier_name) AS sk, lower(part_name) AS tk, s.key IS NOT NULL AS sknown, t.key IS NOT NULL AS tknown,
               CASE WHEN l_tax > 0 AND hit THEN [cid] ELSE list_sort(list_distinct(list_intersect(list_concat(coalesce(s.sc, []), coalesce(t.sc, [])), coalesce(v.v, [])))) END AS fixed
        FROM m LEFT JOIN known s ON s.page_id = m.page_id AND s.key = lower(supplier_name)
        LEFT JOIN known t ON t.page_id = m.page_id AND t.key = lower(part_name) LEFT JOIN valid v ON v.page_id = m.page_id""",
    "edges": "SELECT * FROM edges0 WHERE len(fixed) > 0",
    "ends": """SELECT doc_id, page_id, supplier_name AS name, sk AS key, fixed, ord, 0 AS n FROM edges WHERE NOT sknown
               UNION ALL SELECT doc_id, page_id, part_name, tk, fixed, ord, 1 FROM edges WHERE NOT tknown""",
    "stubs": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY ord, n) AS rn FROM ends) WHERE rn = 1",
}
oracle(
    "patch_operations",
    """
SELECT doc_id, page_id, 'add_node' AS op, 0 AS phase, name, NULL AS src, NULL AS tgt, array_to_string(sc, ',') AS cites FROM adds
UNION ALL SELECT doc_id, page_id, 'add_node', 1, name, NULL, NULL, array_to_string(sc, ',') FROM fate WHERE f = 'demote'
UNION ALL SELECT doc_id, page_id, 'add_node', 2, name, NULL, NULL, array_to_string(fixed, ',') FROM stubs
UNION ALL SELECT doc_id, page_id, 'replace_node', 0, name, NULL, NULL, array_to_string(sc, ',') FROM fate WHERE f = 'keep'
UNION ALL SELECT doc_id, page_id, 'add_edge', 0, NULL, supplier_name, part_name, array_to_string(fixed, ',') FROM edges""",
    **_PATCH,
)
oracle(
    "patch_counters",
    """
SELECT p.doc_id, p.page_id, coalesce(a, 0) AS drop_nodes_no_grounding, coalesce(b, 0) AS drop_nodes_invalid_ids,
       coalesce(c, 0) AS drop_edges_no_grounding, coalesce(d, 0) AS drop_edges_invalid_ids, coalesce(e, 0) AS repair_edges_from_endpoints,
       coalesce(s, 0) AS materialised_stub_nodes, coalesce(g, 0) AS drop_invalid_replace, coalesce(h, 0) AS demoted_replace_to_add
FROM (SELECT DISTINCT doc_id, page_id FROM m) p
LEFT JOIN (SELECT page_id, count(*) FILTER (l_tax = 0) AS a, count(*) FILTER (l_tax > 0 AND NOT hit) + count(*) FILTER (l_returnflag = 'R' AND NOT hit) AS b FROM m GROUP BY page_id) USING (page_id)
LEFT JOIN (SELECT page_id, count(*) FILTER (len(fixed) = 0 AND l_tax = 0) AS c, count(*) FILTER (len(fixed) = 0 AND l_tax > 0) AS d,
                  count(*) FILTER (len(fixed) > 0 AND NOT (l_tax > 0 AND hit)) AS e FROM edges0 GROUP BY page_id) USING (page_id)
LEFT JOIN (SELECT page_id, count(*) AS s FROM stubs GROUP BY page_id) USING (page_id)
LEFT JOIN (SELECT page_id, count(*) FILTER (f = 'drop') AS g, count(*) FILTER (f = 'demote') AS h FROM fate GROUP BY page_id) USING (page_id)""",
    **_PATCH,
)
_APPLIED = {
    **_PATCH,
    "nrows": """
        SELECT doc_id, page_id, name, et, sc, 0 AS stage, 0 AS phase, ord FROM cur
        UNION ALL SELECT doc_id, page_id, name, 'product', sc, 1, 0, ord FROM adds
        UNION ALL SELECT doc_id, page_id, name, 'organization', sc, 1, 1, ord FROM fate WHERE f = 'demote'
        UNION ALL SELECT doc_id, page_id, name, 'entity', fixed, 1, 2, ord FROM stubs
        UNION ALL SELECT doc_id, page_id, name, 'organization', sc, 2, 0, ord FROM fate WHERE f = 'keep'""",
}
oracle(
    "patched_nodes",
    f"""
SELECT doc_id, page_id, {_entity('doc_id', 'name')} AS entity_id, name,
       coalesce(last(et ORDER BY stage, phase, ord) FILTER (stage = 2), first(et ORDER BY stage, phase, ord)) AS entity_type,
       array_to_string(list_sort(list_distinct(flatten(list(sc)))), ',') AS cites
FROM nrows GROUP BY doc_id, page_id, name""",
    **_APPLIED,
)
oracle(
    "patched_edges",
    f"""
SELECT doc_id, page_id, {_uuid('R:', "doc_id || '::' || src_id || '->' || tgt_id || '::' || lower(relation)")} AS edge_id, src_id, tgt_id,
       max(confidence) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(fixed)))), ',') AS cites
FROM edges GROUP BY doc_id, page_id, src_id, tgt_id, relation""",
    **_PATCH,
)
oracle(
    "scorecards",
    """
SELECT doc_id, page_id, regexp_replace(concat_ws(chr(10), cards, CASE WHEN rest IS NOT NULL THEN '== unanchored ==' || chr(10) || rest END), '\\s+$', '') AS scorecard
FROM (SELECT c.doc_id, c.page_id, string_agg('== ' || c.cid || ' (paragraph, upper-left) ==' || chr(10) || '  manifest text: line ' || c.cid || chr(10) ||
             '  nodes grounded here (' || coalesce(n, 0) || '): ' || coalesce(l, '(none)') || chr(10) || '  edges grounded here (0): (none)' || chr(10), chr(10) ORDER BY c.cid) AS cards
      FROM (SELECT DISTINCT doc_id, page_id, cid FROM m WHERE hit) c
      LEFT JOIN (SELECT page_id, sc[1] AS cid, count(*) AS n, string_agg(name || ' (' || et || ', text)' || CASE WHEN et = 'entity' THEN ' [STUB - upgrade via replace_nodes]' ELSE '' END, '; ' ORDER BY ord) AS l
                 FROM cur GROUP BY ALL) g ON g.page_id = c.page_id AND g.cid = c.cid GROUP BY ALL)
FULL JOIN (SELECT doc_id, page_id, string_agg('  - NODE ' || name || ' (' || et || ') cited=[' || sc[1] || ']', chr(10) ORDER BY cur.ord) AS rest
           FROM cur WHERE sc[1] IN ('P6', 'P7') GROUP BY ALL) USING (doc_id, page_id)""".replace("\\\\", "\\"),
    **_PATCH,
)
_SAT = {
    **_MERGE,
    "nd": "SELECT count(*) AS n_docs FROM documents",
    "rev": """
        SELECT CAST(event_id % n_docs AS VARCHAR) AS doc_id, event_id // n_docs AS round, event_id AS seq,
               CASE WHEN user_id % 2 = 0 THEN 'P1' ELSE 'T1' END AS component_id,
               CASE event_type WHEN 'view' THEN 'covered' WHEN 'click' THEN 'irrelevant' WHEN 'purchase' THEN 'partially_covered' WHEN 'error' THEN 'uncovered' ELSE 'needs_visual_inspection' END AS status,
               user_id % 5 AS nn FROM events CROSS JOIN nd""",
    "eff": """
        SELECT r.*, CASE WHEN status IN ('covered', 'irrelevant') AND f.type IN ('paragraph', 'list', 'table') AND length(f.txt) > 200 AND nn < 3 THEN 'deny_sanity'
                         WHEN status IN ('covered', 'irrelevant') THEN 'saturate' ELSE 'unsaturate' END AS effect
        FROM rev r JOIN final f USING (doc_id, component_id)""",
}
oracle(
    "saturated_components",
    """SELECT doc_id, CAST(1 AS BIGINT) AS page_id, component_id FROM eff GROUP BY doc_id, component_id HAVING arg_max(effect, seq) = 'saturate'""",
    **_SAT,
)
oracle(
    "saturation_log",
    """
SELECT doc_id, CAST(1 AS BIGINT) AS page_id, round, component_id, status, effect AS decision FROM (
  SELECT *, coalesce(lag(effect) OVER (PARTITION BY doc_id, component_id ORDER BY round, seq) = 'saturate', false) AS was FROM eff)
WHERE effect = 'deny_sanity' OR (effect = 'saturate' AND NOT was) OR (effect = 'unsaturate' AND was)""",
    **_SAT,
)

# ---- statistics --------------------------------------------------------------------------------

oracle(
    "trace_rollup",
    """
SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS wall_ms,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens, count(*) AS llm_calls,
       count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY ROLLUP (event_type)""",
)
_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
_SUMS = """count(*) AS calls, round(sum(value), 2) AS wall_ms, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens,
  count(*) FILTER (event_type = 'error') AS errors"""
oracle(
    "trace_tumbling",
    f"""
SELECT {_TIME.format(c='s')} AS "start", {_TIME.format(c="s + INTERVAL 1 HOUR")} AS "end", event_type AS stage, {_SUMS}
FROM (SELECT *, date_trunc('hour', ts) AS s FROM events) GROUP BY s, event_type""",
)
oracle(
    "trace_sliding",
    f"""
SELECT {_TIME.format(c='s')} AS "start", {_TIME.format(c="s + INTERVAL 2 HOURS")} AS "end", event_type AS stage, {_SUMS}
FROM (SELECT e.*, date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTES ELSE INTERVAL 0 MINUTES END - k * INTERVAL 30 MINUTES AS s
  FROM events e, range(4) r(k)) GROUP BY s, event_type""",
)
oracle(
    "trace_sessions",
    f"""
SELECT {_TIME.format(c='min(ts)')} AS "start", {_TIME.format(c="max(ts) + INTERVAL 30 MINUTES")} AS "end", CAST(user_id AS VARCHAR) AS run_id, {_SUMS}
FROM (SELECT *, sum(CASE WHEN ts < before + INTERVAL 30 MINUTES THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, n""",
)
oracle(
    "page_statistics",
    """
SELECT p.doc_id, p.page_id, coalesce(n, 0) AS nodes, coalesce(v, 0) AS visual, coalesce(e, 0) AS sem_edges FROM og_pages p
LEFT JOIN (SELECT doc_id, page_id, count(DISTINCT entity_id) AS n, count(DISTINCT entity_id) FILTER (modality = 'visual') AS v FROM og_mention_nodes GROUP BY ALL) USING (doc_id, page_id)
LEFT JOIN (SELECT doc_id, page_id, count(DISTINCT edge_id) AS e FROM og_mentions GROUP BY ALL) USING (doc_id, page_id)""",
)
oracle(
    "spread_histogram",
    """
SELECT CAST(len(source_pages) AS INTEGER) AS n_pages, count(*) AS nodes,
       (SELECT round(100.0::DOUBLE * count(*) FILTER (len(source_pages) > 1) / count(*), 1) FROM og_nodes) AS multi_page_pct
FROM og_nodes GROUP BY len(source_pages)""",
)
oracle(
    "type_distributions",
    """
SELECT 'entity_type' AS what, entity_type AS value, count(*) AS n FROM og_nodes GROUP BY ALL
UNION ALL SELECT 'modality', modality, count(*) FROM og_nodes GROUP BY ALL
UNION ALL SELECT 'edge_type', edge_type, count(*) FROM og_all_edges GROUP BY ALL
UNION ALL SELECT 'card', 'page', count(*) FROM og_pages UNION ALL SELECT 'card', 'entity', count(*) FROM og_nodes
UNION ALL SELECT 'card', 'relation', count(*) FROM og_edges""",
)
oracle("alignment_confidence", "SELECT min(confidence) AS lo, round(avg(confidence), 6) AS mean, max(confidence) AS hi, count(*) AS n FROM og_same_as")
oracle(
    "top_hubs",
    """
SELECT entity_id, degree, name FROM (SELECT e AS entity_id, count(*) AS degree FROM (
  SELECT src_id AS e FROM og_edges UNION ALL SELECT tgt_id FROM og_edges) GROUP BY e ORDER BY degree DESC, e LIMIT 8) JOIN og_nodes USING (entity_id)""",
)
oracle(
    "entity_page_ranges",
    """
SELECT entity_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM (
  SELECT entity_id, min(p) AS a, max(p) AS b FROM (
    SELECT entity_id, p, p - row_number() OVER (PARTITION BY entity_id ORDER BY p) AS g FROM (SELECT DISTINCT entity_id, page_id AS p FROM og_mention_nodes))
  GROUP BY entity_id, g) GROUP BY entity_id""",
)
oracle(
    "round_differences",
    r"""
SELECT 'c' AS doc_id, conv_id AS page_id, turn AS round_idx, len(w) - len(list_intersect(w, pw)) AS new_nodes, len(list_intersect(w, pw)) AS kept_nodes,
       CASE WHEN role = prole THEN len(w) - len(list_intersect(w, pw)) ELSE len(w) END AS new_edges,
       CASE WHEN role = prole THEN len(list_intersect(w, pw)) ELSE 0 END AS kept_edges
FROM (SELECT *, coalesce(lag(w) OVER o, []) AS pw, lag(role) OVER o AS prole
      FROM (SELECT *, list_distinct(regexp_split_to_array(text, '\s+')) AS w FROM conversations) WINDOW o AS (PARTITION BY conv_id ORDER BY turn))""",
)

# ---- store and index -----------------------------------------------------------------------------

oracle(
    "upserted_index",
    """
SELECT coalesce(d.doc_id, p.page_id * 7) AS evidence_id, coalesce(p.url, d.source) AS payload,
       CAST(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS batch, coalesce(d.doc_id, p.page_id) AS pos
FROM documents d FULL JOIN pages p ON d.doc_id = p.page_id * 7""",
)
oracle(
    "upserted_log",
    """
SELECT coalesce(b.evidence_id, l.doc_id) AS evidence_id, coalesce('quality ' || l.quality, b.payload) AS payload,
       CAST(coalesce(b.batch, 2) AS BIGINT) AS batch, coalesce(b.pos, l.doc_id) AS pos
FROM (SELECT coalesce(d.doc_id, p.page_id * 7) AS evidence_id, coalesce(p.url, d.source) AS payload, CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END AS batch,
        coalesce(d.doc_id, p.page_id) AS pos
      FROM documents d FULL JOIN pages p ON d.doc_id = p.page_id * 7) b FULL JOIN labels l ON b.evidence_id = l.doc_id""",
)
oracle(
    "graph_neighbours",
    """SELECT src_id AS entity_id, edge_id, tgt_id AS neighbour_id FROM og_all_edges
       UNION ALL SELECT tgt_id, edge_id, src_id FROM og_all_edges WHERE src_id <> tgt_id""",
)
oracle(
    "aligned_entities",
    "SELECT src_id AS entity_id, tgt_id AS aligned FROM og_same_as UNION SELECT tgt_id, src_id FROM og_same_as WHERE src_id <> tgt_id",
)
oracle(
    "cascaded_deletes",
    """
SELECT edge_id, src_id, tgt_id, relation FROM og_all_edges
WHERE src_id NOT IN (SELECT entity_id FROM og_nodes WHERE description LIKE '%by Brand#1') AND tgt_id NOT IN (SELECT entity_id FROM og_nodes WHERE description LIKE '%by Brand#1')""",
)
oracle(
    "relation_metadata",
    """SELECT edge_id, src_id, tgt_id, relation, confidence, description FROM og_edges WHERE edge_id IN (SELECT edge_id FROM og_mentions WHERE l_discount >= 0.095)""",
)
oracle(
    "crop_boxes",
    """
SELECT tgt_id AS entity_id, doc_id, page_id, round(greatest(0, x0 * 2 - (x1 - x0) * 2 * 0.06::DOUBLE), 6) AS cx0, round(greatest(0, y0 * 3 - (y1 - y0) * 3 * 0.06::DOUBLE), 6) AS cy0,
       round(least(400, x1 * 2 + (x1 - x0) * 2 * 0.06::DOUBLE), 6) AS cx1, round(least(300, y1 * 3 + (y1 - y0) * 3 * 0.06::DOUBLE), 6) AS cy1
FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY (x1 - x0) * (y1 - y0) DESC, cid, x0, y0, x1, y1, page_id) AS rn
      FROM (SELECT tgt_id, doc_id, page_id, 'P' || l_linenumber AS cid, l_quantity AS x0, l_quantity AS y0, l_quantity * 3 + l_linenumber AS x1, l_quantity * 2 + 1 AS y1 FROM og_mentions))
WHERE rn = 1 AND (least(400, x1 * 2 + (x1 - x0) * 2 * 0.06::DOUBLE) - greatest(0, x0 * 2 - (x1 - x0) * 2 * 0.06::DOUBLE)) *
      (least(300, y1 * 3 + (y1 - y0) * 3 * 0.06::DOUBLE) - greatest(0, y0 * 3 - (y1 - y0) * 3 * 0.06::DOUBLE)) >= 3600""",
)

# ---- replies ---------------------------------------------------------------------------------------

oracle(
    "loose_json_values",
    """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 5 IN (3, 4) AS is_empty FROM events""",
)
oracle(
    "parsed_answers",
    r"""
SELECT conv_id || '-' || turn || '-' || role AS qid,
       CASE turn % 4 WHEN 0 THEN md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE md5(md5(text)) END AS digest,
       CASE turn % 4 WHEN 0 THEN 'low' WHEN 3 THEN 'medium' ELSE CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'low' END END AS confidence,
       CASE WHEN turn % 4 IN (1, 2) THEN 'because' END AS reasoning,
       CASE WHEN turn % 4 = 1 THEN turn || ',7' ELSE (turn + 100)::VARCHAR END AS cited
FROM conversations""",
)

__all__ = ["ORACLES"]
