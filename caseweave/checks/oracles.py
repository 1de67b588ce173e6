"""DuckDB statements for the registered queries, written from the definitions."""

from __future__ import annotations

from caseweave.fixed import MEAN_METRICS

ORACLES: dict[str, str] = {}

RUNS = """
ev AS (SELECT user_id, strftime(ts, '%Y%m%d') AS day,
              event_id, event_type, value FROM events),
sides AS (
  SELECT user_id, day, event_id, 0 AS sub, event_type AS t,
         CASE WHEN value < 4 THEN NULL WHEN value < 12 THEN 'click' ELSE event_type END AS p,
         event_id + CASE WHEN value >= 30 AND value < 36 THEN 1000000000 ELSE 0 END AS ord FROM ev
  UNION ALL SELECT user_id, day, event_id, 1, NULL, 'refund', event_id
    FROM ev WHERE value > 140
  UNION ALL SELECT user_id, day, event_id, 2, NULL, event_type, event_id
    FROM ev WHERE value > 110 AND value <= 140),
runs AS (
  SELECT 'application_' || user_id || '__' || day AS case_id,
         user_id, day, min(event_id) AS record_pos,
         list(t ORDER BY event_id) FILTER (t IS NOT NULL) AS t,
         coalesce(list(p ORDER BY ord, sub) FILTER (p IS NOT NULL), []) AS p
  FROM sides GROUP BY user_id, day)"""

RECORDS = RUNS + """,
records AS (SELECT *, array_to_string(t, '>') AS unit_id, (user_id % 10) / 10.0 AS confidence,
                   len(t)::BIGINT AS size,
                   NOT (t[1] = 'error' AND len(t) = 1) AS has_email FROM runs)"""

# one row of the distance matrix per recursion step
EDIT = """,
ed AS (
  SELECT case_id, 0 AS i, range(0, len(p) + 1) AS r FROM runs
  UNION ALL
  SELECT e.case_id, e.i + 1,
         list_transform(range(1, len(s.p) + 2), lambda j: (j - 1) + list_min(list_transform(
           range(1, j + 1), lambda l: CASE WHEN l = 1 THEN e.i + 1
             ELSE least(e.r[l] + 1, e.r[l - 1] + CASE WHEN s.t[e.i + 1] = s.p[l - 1] THEN 0 ELSE 1 END)
             END - (l - 1))))
  FROM ed e JOIN runs s USING (case_id) WHERE e.i < len(s.t)),
dist AS (SELECT case_id, r[len(p) + 1] AS edit_distance
         FROM ed JOIN runs USING (case_id) WHERE i = len(t))"""

LCS = """,
lc AS (
  SELECT case_id, 0 AS i, list_transform(range(0, len(p) + 1), lambda x: 0) AS r FROM runs
  UNION ALL
  SELECT e.case_id, e.i + 1,
         list_transform(range(1, len(s.p) + 2), lambda j: list_max(list_transform(
           range(1, j + 1), lambda l: CASE WHEN l = 1 THEN 0
             WHEN s.t[e.i + 1] = s.p[l - 1] THEN greatest(e.r[l], e.r[l - 1] + 1) ELSE e.r[l] END)))
  FROM lc e JOIN runs s USING (case_id) WHERE e.i < len(s.t)),
lcs AS (SELECT case_id, r[len(p) + 1] AS lcs_length
        FROM lc JOIN runs USING (case_id) WHERE i = len(t))"""

TRACE = EDIT + """,
mats AS (SELECT case_id, list(r ORDER BY i) AS m FROM ed GROUP BY case_id),
walk AS (
  SELECT case_id, len(t) AS i, len(p) AS j, 0 AS k, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM runs
  UNION ALL
  SELECT case_id, i - CASE op WHEN 'i' THEN 0 ELSE 1 END, j - CASE op WHEN 'd' THEN 0 ELSE 1 END,
         k + 1, CASE WHEN op <> 'i' THEN t[i] END, CASE WHEN op <> 'd' THEN p[j] END
  FROM (SELECT w.case_id, w.i, w.j, w.k, s.t, s.p,
          CASE WHEN w.i > 0 AND w.j > 0 AND x.m[w.i + 1][w.j + 1] =
                    x.m[w.i][w.j] + CASE WHEN s.t[w.i] = s.p[w.j] THEN 0 ELSE 1 END THEN 'm'
               WHEN w.i > 0 AND x.m[w.i + 1][w.j + 1] = x.m[w.i][w.j + 1] + 1 THEN 'd'
               ELSE 'i' END AS op
        FROM walk w JOIN runs s USING (case_id) JOIN mats x USING (case_id)
        WHERE w.i > 0 OR w.j > 0)),
steps AS (SELECT case_id, k, a, b FROM walk WHERE k > 0)"""

COUNTS = """,
tok AS (
  SELECT case_id, tok, sum(nt) AS nt, sum(np) AS np FROM (
    SELECT case_id, unnest(t) AS tok, 1 AS nt, 0 AS np FROM runs
    UNION ALL SELECT case_id, unnest(p), 0, 1 FROM runs) GROUP BY ALL),
cnt AS (
  SELECT case_id, sum(least(nt, np)) AS overlap, count(*) AS types,
         count(*) FILTER (nt > 0) AS tt, count(*) FILTER (np > 0) AS pt,
         count(*) FILTER (nt > 0 AND np > 0) AS shared,
         sum(nt * np) AS dot, sum(nt * nt) AS tn, sum(np * np) AS pn,
         bool_and(nt = np) AS same_counts
  FROM tok GROUP BY case_id)"""

MEASURES = EDIT + LCS + COUNTS + """,
measures AS (
  SELECT *, CASE WHEN mp + mr = 0 THEN 0 ELSE 2 * mp * mr / (mp + mr) END AS mf,
         CASE WHEN sp + sr = 0 THEN 0 ELSE 2 * sp * sr / (sp + sr) END AS sf
  FROM (
    SELECT s.*, d.edit_distance, l.lcs_length, c.* EXCLUDE (case_id),
           d.edit_distance / greatest(len(t), len(p), 1)::DOUBLE AS ned,
           l.lcs_length / greatest(len(t), len(p))::DOUBLE AS lr,
           CASE WHEN len(p) = 0 THEN 0 ELSE c.overlap / len(p)::DOUBLE END AS mp,
           c.overlap / len(t)::DOUBLE AS mr,
           CASE WHEN len(p) = 0 THEN 0 ELSE l.lcs_length / len(p)::DOUBLE END AS sp,
           l.lcs_length / len(t)::DOUBLE AS sr,
           c.shared / c.types::DOUBLE AS jac, 2 * c.shared / (c.tt + c.pt)::DOUBLE AS dic,
           CASE WHEN len(p) = 0 THEN 0 ELSE c.dot / (sqrt(c.tn) * sqrt(c.pn)) END AS cosv,
           CASE WHEN t = p THEN 'exact' WHEN c.same_counts THEN 'ordering'
                WHEN c.shared = c.types THEN CASE WHEN len(p) > len(t)
                     THEN 'multiplicity(over)' ELSE 'multiplicity(under)' END
                WHEN c.tt = c.shared THEN 'over-generation'
                WHEN c.pt = c.shared THEN 'under-generation'
                ELSE 'substitution/mixed' END AS category
    FROM runs s JOIN dist d USING (case_id) JOIN lcs l USING (case_id) JOIN cnt c USING (case_id)))"""


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


ORACLES["hidden_runs"] = f"""WITH {RUNS}
SELECT case_id, record_pos, array_to_string(t, '>') AS true_list,
       array_to_string(p, '>') AS pred_list FROM runs"""

ORACLES["pair_edit_distance"] = f"""WITH RECURSIVE {RUNS}{EDIT}
SELECT case_id, edit_distance,
       {r6('edit_distance / greatest(len(t), len(p), 1)::DOUBLE')} AS normalized_edit_distance
FROM dist JOIN runs USING (case_id)"""

ORACLES["pair_lcs"] = f"""WITH RECURSIVE {RUNS}{MEASURES}
SELECT case_id, lcs_length, {r6('lr')} AS lcs_ratio, {r6('sp')} AS seq_precision,
       {r6('sr')} AS seq_recall, {r6('sf')} AS seq_f1 FROM measures"""

ORACLES["pair_overlap"] = f"""WITH RECURSIVE {RUNS}{MEASURES}
SELECT case_id, {r6('mp')} AS multiset_precision, {r6('mr')} AS multiset_recall,
       {r6('mf')} AS multiset_f1, {r6('jac')} AS jaccard, {r6('dic')} AS dice,
       {r6('cosv')} AS cosine FROM measures"""

ORACLES["pair_kendall"] = f"""WITH {RUNS},
ft AS (SELECT case_id, unnest(list_distinct(t)) AS tok, t, p FROM runs),
pos AS (SELECT case_id, list_position(t, tok) AS a, list_position(p, tok) AS b FROM ft
        WHERE list_contains(p, tok)),
agree AS (SELECT x.case_id, sum(sign((x.a - y.a) * (x.b - y.b))) AS s, count(*) AS n
          FROM pos x JOIN pos y ON x.case_id = y.case_id AND x.a < y.a GROUP BY x.case_id)
SELECT case_id, {r6('coalesce(s / n::DOUBLE, 1.0)')} AS kendall_tau
FROM runs LEFT JOIN agree USING (case_id)"""

ORACLES["pair_category"] = f"""WITH RECURSIVE {RUNS}{MEASURES}
SELECT case_id, category, t = p AS exact_match FROM measures"""

ORACLES["pair_fp_fn"] = f"""WITH {RUNS}{COUNTS}
SELECT record_pos, CASE WHEN np > nt THEN 'fp' ELSE 'fn' END AS kind, tok AS activity,
       abs(np - nt)::INTEGER AS n
FROM tok JOIN runs USING (case_id) WHERE np <> nt"""

ORACLES["alignment_ops"] = f"""WITH RECURSIVE {RUNS}{TRACE}
SELECT case_id, count(*) FILTER (a = b) AS n_match, count(*) FILTER (a <> b) AS n_sub,
       count(*) FILTER (k IS NOT NULL AND a IS NULL) AS n_ins,
       count(*) FILTER (k IS NOT NULL AND b IS NULL) AS n_del,
       coalesce(string_agg(a || '>' || b, ',' ORDER BY k DESC) FILTER (a <> b), '') AS subs
FROM runs LEFT JOIN steps USING (case_id) GROUP BY case_id"""

ORACLES["scored_rows"] = f"""WITH RECURSIVE {RECORDS}{MEASURES}
SELECT m.record_pos, r.unit_id, r.size, m.case_id, {r6('r.confidence')} AS confidence, m.category,
       m.t = m.p AS exact_match, len(m.t) AS true_length, len(m.p) AS pred_length,
       len(m.p) - len(m.t) AS length_bias, m.edit_distance, {r6('mf')} AS multiset_f1,
       {r6('sf')} AS seq_f1
FROM measures m JOIN records r USING (case_id) WHERE r.has_email"""

ORACLES["run_counts"] = f"""WITH {RECORDS}
SELECT count(*) AS n_records, count(*) FILTER (has_email) AS n_scored FROM records"""

CELLS = RECORDS + TRACE + """,
cells AS (
  SELECT r.size, coalesce(s.a, '__insert__') AS true_label, coalesce(s.b, '__delete__') AS pred_label,
         count(*) AS n
  FROM steps s JOIN records r USING (case_id) WHERE r.has_email GROUP BY ALL),
total_cells AS (SELECT true_label, pred_label, sum(n)::BIGINT AS n FROM cells GROUP BY ALL),
labels AS (SELECT DISTINCT label FROM (SELECT true_label AS label FROM total_cells
           UNION SELECT pred_label FROM total_cells)
           WHERE label NOT IN ('__insert__', '__delete__')),
framed AS (SELECT label FROM labels UNION ALL SELECT '__insert__' UNION ALL SELECT '__delete__'),
dense AS (SELECT x.label AS true_label, y.label AS pred_label, coalesce(c.n, 0) AS n
          FROM framed x CROSS JOIN framed y
          LEFT JOIN total_cells c ON c.true_label = x.label AND c.pred_label = y.label)"""

ORACLES["confusion_by_size"] = f"WITH RECURSIVE {CELLS} SELECT * FROM cells"
ORACLES["confusion_cells"] = f"WITH RECURSIVE {CELLS} SELECT * FROM total_cells"
ORACLES["confusion_labels"] = f"WITH RECURSIVE {CELLS} SELECT label FROM labels"
ORACLES["confusion_matrix_dense"] = f"WITH RECURSIVE {CELLS} SELECT * FROM dense"
ORACLES["confusion_matrix_sparse"] = f"""WITH RECURSIVE {CELLS}
SELECT * FROM dense WHERE true_label <> '__delete__' AND pred_label <> '__insert__'"""
ORACLES["substitution_list"] = f"""WITH RECURSIVE {CELLS}
SELECT * FROM total_cells WHERE true_label <> '__insert__' AND pred_label <> '__delete__'
  AND true_label <> pred_label"""
ORACLES["confusion_totals"] = f"""WITH RECURSIVE {CELLS}
SELECT size, n_match, n_sub, n_ins, n_del, n_aligned,
       {r6('n_match / n_aligned::DOUBLE')} AS match_rate, {r6('n_sub / n_aligned::DOUBLE')} AS sub_rate,
       {r6('n_ins / n_aligned::DOUBLE')} AS ins_rate, {r6('n_del / n_aligned::DOUBLE')} AS del_rate
FROM (SELECT size, sum(n)::BIGINT AS n_aligned,
        coalesce(sum(n) FILTER (true_label = pred_label), 0)::BIGINT AS n_match,
        coalesce(sum(n) FILTER (true_label = '__insert__'), 0)::BIGINT AS n_ins,
        coalesce(sum(n) FILTER (pred_label = '__delete__'), 0)::BIGINT AS n_del,
        coalesce(sum(n) FILTER (true_label <> pred_label AND true_label <> '__insert__'
                         AND pred_label <> '__delete__'), 0)::BIGINT AS n_sub
      FROM cells GROUP BY size)"""

ORACLES["substitutions_by_size"] = f"""WITH RECURSIVE {CELLS}
SELECT * FROM cells WHERE true_label <> '__insert__' AND pred_label <> '__delete__'
  AND true_label <> pred_label"""
SIZED = CELLS + """,
sized AS (SELECT size, true_label AS label FROM cells UNION SELECT size, pred_label FROM cells
          UNION SELECT size, unnest(['__insert__', '__delete__']) FROM cells),
dense_sized AS (SELECT x.size, x.label AS true_label, y.label AS pred_label, coalesce(c.n, 0) AS n
                FROM sized x JOIN sized y USING (size)
                LEFT JOIN cells c ON c.size = x.size AND c.true_label = x.label
                  AND c.pred_label = y.label)"""
ORACLES["confusion_labels_by_size"] = f"""WITH RECURSIVE {SIZED}
SELECT size, label FROM sized WHERE label NOT IN ('__insert__', '__delete__')"""
ORACLES["confusion_matrix_by_size"] = f"WITH RECURSIVE {SIZED} SELECT * FROM dense_sized"
ORACLES["confusion_sparse_by_size"] = f"""WITH RECURSIVE {SIZED}
SELECT * FROM dense_sized WHERE true_label <> '__delete__' AND pred_label <> '__insert__'"""
ORACLES["scored_row_lines"] = f"""WITH RECURSIVE {RECORDS}{MEASURES}{TRACE[len(EDIT):]},
steps_of AS (SELECT case_id, count(*) FILTER (a = b) AS n_match, count(*) FILTER (a <> b) AS n_sub,
               count(*) FILTER (a IS NULL) AS n_ins, count(*) FILTER (b IS NULL) AS n_del,
               string_agg(a || '>' || b, ',' ORDER BY k DESC) FILTER (a <> b) AS subs
             FROM steps GROUP BY case_id),
diffs AS (SELECT case_id,
            string_agg(tok || '=' || (np - nt)::BIGINT, ',' ORDER BY tok) FILTER (np > nt) AS fp,
            string_agg(tok || '=' || (nt - np)::BIGINT, ',' ORDER BY tok) FILTER (nt > np) AS fn
          FROM tok GROUP BY case_id)
SELECT m.record_pos, r.unit_id, r.size, m.case_id, {r6('r.confidence')} AS confidence, m.category,
       array_to_string(m.t, '>') AS true_list, array_to_string(m.p, '>') AS pred_list,
       coalesce(d.fp, '') AS fp, coalesce(d.fn, '') AS fn,
       concat_ws(',', s.n_match, s.n_sub, s.n_ins, s.n_del) AS ops, coalesce(s.subs, '') AS subs
FROM measures m JOIN records r USING (case_id) JOIN steps_of s USING (case_id)
JOIN diffs d USING (case_id) WHERE r.has_email"""

METRIC_SQL = {
    "normalized_edit_distance": "ned", "multiset_f1": "mf", "multiset_precision": "mp",
    "multiset_recall": "mr", "seq_f1": "sf", "seq_precision": "sp", "seq_recall": "sr",
    "jaccard": "jac", "lcs_ratio": "lr", "length_bias": "(len(m.p) - len(m.t))",
}
MEANS = ", ".join(f"avg({METRIC_SQL[m]}) AS {m}" for m in MEAN_METRICS)
STDS = ", ".join(f"stddev_pop({METRIC_SQL[m]}) AS {m}_std" for m in MEAN_METRICS)
SUMMARY = MEASURES + f""",
summary AS (
  SELECT CASE grouping(r.size, r.unit_id) WHEN 3 THEN 'overall' WHEN 1 THEN 'size' ELSE 'unit' END
           AS scope, r.size, r.unit_id, count(*) AS n,
         avg(CASE WHEN m.t = m.p THEN 1.0 ELSE 0.0 END) AS exact_rate,
         arg_min(r.size, m.record_pos) AS first_size, {MEANS}, {STDS}
  FROM measures m JOIN records r USING (case_id) WHERE r.has_email
  GROUP BY GROUPING SETS ((), (r.size), (r.unit_id)))"""
ORACLES["summary_grouping_sets"] = f"""WITH RECURSIVE {RECORDS}{SUMMARY}
SELECT scope, size, unit_id, n, first_size, {r6('exact_rate')} AS exact_rate,
  {', '.join(f'{r6(m)} AS {m}, {r6(m + "_std")} AS {m}_std' for m in MEAN_METRICS)} FROM summary"""
ORACLES["category_mix"] = f"""WITH RECURSIVE {RECORDS}{MEASURES}
SELECT CASE grouping(r.size, r.unit_id) WHEN 3 THEN 'overall' WHEN 1 THEN 'size' ELSE 'unit' END
         AS scope, r.size, r.unit_id, m.category, count(*) AS n
FROM measures m JOIN records r USING (case_id) WHERE r.has_email
GROUP BY GROUPING SETS ((m.category), (r.size, m.category), (r.unit_id, m.category))"""

# --- case graph ---------------------------------------------------------------------

GRAPH = """
item AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
                'e' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS e,
                l_returnflag AS flag, l_linestatus AS status FROM lineitem),
nodes AS (
  SELECT 'p' || o_orderkey AS id, 'ProcessInstance' AS label, o_orderkey AS pos,
         'application_' || o_custkey || '__' || o_orderkey AS stable,
         'Purchase order' AS shown FROM orders
  UNION ALL SELECT 'ac' || o_orderkey, 'ActivityCluster', o_orderkey, '#ac' || o_orderkey,
         'no details' FROM orders
  UNION ALL SELECT 'd' || o_orderkey, 'DecisionNode', o_orderkey, 'dec_' || o_orderkey,
         'final_choice=' || o_orderstatus || ' | decision_type=' || o_orderpriority FROM orders
  UNION ALL SELECT 'r' || o_orderkey, 'RationaleNode', o_orderkey, 'rat_' || o_orderkey,
         '"' || o_orderpriority || '"' FROM orders
  UNION ALL SELECT 'x' || o_orderkey, 'Event', o_orderkey, '#x' || o_orderkey, o_orderstatus
         FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT e, 'EvidenceNode', o, 'ev_' || concat_ws('_', o, pk, sk) || '__s' || ln,
         '"' || min(flag) || ' ' || min(status) || '", this email, span=' || ln
         FROM item GROUP BY e, o, ln, pk, sk
  UNION ALL SELECT 's' || s_suppkey, 'Actor', s_suppkey, '#s' || s_suppkey,
         s_name || ' | actor_type=Supplier' FROM supplier
  UNION ALL SELECT 'v' || p_partkey, 'ValueNode', p_partkey, '#v' || p_partkey, p_name FROM part),
edges AS (
  SELECT 'ac' || o_orderkey AS src, 'part_of' AS rel, 'p' || o_orderkey AS dst FROM orders
  UNION ALL SELECT 'ac' || o_orderkey, 'has_decision', 'd' || o_orderkey FROM orders
  UNION ALL SELECT 'd' || o_orderkey, 'justified_by', 'r' || o_orderkey FROM orders
  UNION ALL SELECT 'x' || o_orderkey, 'names', 'ac' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'ac' || o, 'produced', e FROM item
  UNION ALL SELECT 's' || sk, ['prepared', 'reviewed', 'ran', 'completed', 'approved',
         'signed_off'][least(ln, 6)], 'ac' || o FROM item
  UNION ALL SELECT 'd' || o, 'supported_by', e FROM item WHERE ln = 1
  UNION ALL SELECT 'd' || o, 'about', 'v' || pk FROM item WHERE ln = 1 AND flag = 'R'),
flagged AS (SELECT *, label IN ('ProcessInstance', 'ActivityCluster', 'Actor') AS boundary,
                   label = 'Actor' AS actor, label = 'Event' AS leaky,
                   CASE WHEN label = 'ProcessInstance' THEN stable END AS app FROM nodes),
adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)),
masked AS (SELECT DISTINCT src, CASE WHEN rel IN ('prepared', 'reviewed', 'ran', 'completed',
                  'approved', 'signed_off') THEN 'linked_to' ELSE rel END AS rel, dst FROM edges)"""


def around(hops: int) -> str:
    """Nodes within some hops of each case: walks whose inner nodes may be left."""
    return f""",
seeds AS (SELECT app AS asked, id AS node FROM flagged WHERE app IS NOT NULL
          UNION SELECT f.app, a.dst FROM flagged f JOIN adj a ON a.src = f.id
            JOIN flagged c ON c.id = a.dst AND c.label = 'ActivityCluster' WHERE f.app IS NOT NULL),
reach AS (
  SELECT asked, node, 0 AS depth FROM seeds
  UNION
  SELECT r.asked, a.dst, r.depth + 1 FROM reach r
  JOIN flagged f ON f.id = r.node JOIN adj a ON a.src = r.node JOIN flagged g ON g.id = a.dst
  WHERE r.depth < {hops} AND (r.depth = 0 OR NOT f.boundary) AND NOT g.leaky),
members AS (SELECT DISTINCT asked, node FROM reach)"""


def lines(hops: int) -> str:
    return around(hops) + """,
tags AS (
  SELECT m.asked, m.node, f.label, f.shown,
         CASE f.label WHEN 'EvidenceNode' THEN 0 WHEN 'ActivityCluster' THEN 1
           WHEN 'ProcessInstance' THEN 2 WHEN 'DecisionNode' THEN 4 WHEN 'RationaleNode' THEN 5
           WHEN 'Actor' THEN 7 ELSE 8 END AS rank,
         CASE f.label WHEN 'EvidenceNode' THEN 'E' WHEN 'ActivityCluster' THEN 'AC'
           WHEN 'ProcessInstance' THEN 'P' WHEN 'DecisionNode' THEN 'D'
           WHEN 'RationaleNode' THEN 'R' WHEN 'Actor' THEN 'A' ELSE 'N' END AS prefix,
         row_number() OVER (PARTITION BY m.asked, f.label ORDER BY
           CASE WHEN f.label = 'EvidenceNode'
                THEN regexp_extract(f.stable, '__s([0-9]+)$', 1)::INT ELSE 0 END, m.node) AS n
  FROM members m JOIN flagged f ON f.id = m.node),
rels AS (
  SELECT a.asked, a.prefix || a.n AS s, e.rel, b.prefix || b.n AS d
  FROM tags a JOIN masked e ON e.src = a.node JOIN tags b ON b.asked = a.asked AND b.node = e.dst),
lines AS (
  SELECT asked, 0 AS section, rank, n, prefix || n || ' ' || label || '(' || shown || ')' AS line
  FROM tags
  UNION ALL
  SELECT asked, 1, 0, row_number() OVER (PARTITION BY asked ORDER BY s, rel, d),
         s || ' is ' || rel || ' ' || d FROM rels),
texts AS (
  SELECT asked, 'Node:' || chr(10)
         || string_agg(line, chr(10) ORDER BY rank, n) FILTER (section = 0)
         || chr(10) || chr(10) || 'Relationships:'
         || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY n) FILTER (section = 1), '') AS text
  FROM lines GROUP BY asked)"""


ORACLES["graph_nodes"] = f"""WITH {GRAPH}
SELECT id AS node_id, label, stable AS stable_id, app AS app_id, boundary AS is_boundary,
       leaky AS is_leaky,
       coalesce(try_cast(regexp_extract(stable, '__s([0-9]+)$', 1) AS BIGINT), 0) AS span
FROM flagged"""
ORACLES["graph_adjacency"] = f"""WITH {GRAPH}
SELECT a.src, a.dst, f.app AS src_app, g.actor AS dst_actor, g.boundary AS dst_boundary,
       g.leaky AS dst_leaky
FROM adj a JOIN flagged f ON f.id = a.src JOIN flagged g ON g.id = a.dst"""
ORACLES["alias_resolution"] = f"""WITH {GRAPH}
SELECT app AS asked, id AS node_id FROM flagged WHERE app IS NOT NULL
UNION ALL SELECT 'Purchase order', arg_min(id, pos) FROM flagged WHERE app IS NOT NULL"""
ORACLES["alias_fanout"] = f"""WITH {GRAPH}
SELECT 'Purchase order' AS alias, count(*) AS n_cases, min(app) AS min_app
FROM flagged WHERE app IS NOT NULL"""
for hops in (1, 2):
    ORACLES[f"case_neighbourhood_{hops}"] = f"""WITH RECURSIVE {GRAPH}{around(hops)}
SELECT asked, node AS node_id FROM members"""
ORACLES["node_owner"] = f"""WITH RECURSIVE {GRAPH},
reach AS (
  SELECT id AS start, id AS node, 0 AS depth FROM flagged
  WHERE label IN ('DecisionNode', 'RationaleNode')
  UNION
  SELECT r.start, a.dst, r.depth + 1 FROM reach r JOIN flagged f ON f.id = r.node
  JOIN adj a ON a.src = r.node JOIN flagged g ON g.id = a.dst
  WHERE r.depth < 4 AND f.app IS NULL AND NOT f.actor AND NOT g.actor)
SELECT start AS node_id, min(f.app) AS app FROM reach r JOIN flagged f ON f.id = r.node
WHERE f.app IS NOT NULL GROUP BY start"""
ORACLES["case_seed_ids"] = f"""WITH RECURSIVE {GRAPH}{around(2)}
SELECT asked, CASE label WHEN 'DecisionNode' THEN 'decisions' WHEN 'RationaleNode' THEN 'rationales'
       ELSE 'evidence' END AS kind, stable AS stable_id
FROM members m JOIN flagged f ON f.id = m.node
WHERE label IN ('DecisionNode', 'RationaleNode', 'EvidenceNode')"""
ORACLES["masked_edges"] = f"WITH {GRAPH} SELECT src, rel, dst FROM masked"
ORACLES["case_neighbourhood_leaky"] = f"""WITH RECURSIVE {GRAPH}{around(1).replace(" AND NOT g.leaky", "")}
SELECT asked, node AS node_id FROM members"""
ORACLES["bare_case_drop"] = f"""WITH RECURSIVE {GRAPH}{around(0).replace("members AS", "seen AS")},
members AS (SELECT asked || '#clusters' AS asked, node FROM seen
            UNION ALL SELECT app, id FROM flagged WHERE app IS NOT NULL)
SELECT m.asked, m.node AS node_id FROM members m JOIN flagged f ON f.id = m.node
WHERE f.app IS NULL OR EXISTS (
  SELECT 1 FROM adj a JOIN members o ON o.node = a.dst JOIN flagged g ON g.id = a.dst
  WHERE a.src = m.node AND o.asked = m.asked
    AND g.label IN ('EvidenceNode', 'DecisionNode', 'RationaleNode', 'ActivityCluster'))"""
ORACLES["induced_edges"] = f"""WITH RECURSIVE {GRAPH}{around(2)}
SELECT a.asked, e.src, e.rel, e.dst FROM members a JOIN masked e ON e.src = a.node
JOIN members b ON b.asked = a.asked AND b.node = e.dst"""
ORACLES["render_subgraph"] = f"WITH RECURSIVE {GRAPH}{lines(2)} SELECT * FROM lines"
UNMASKED = lines(1).replace("JOIN masked e", "JOIN (SELECT DISTINCT * FROM edges) e")
ORACLES["render_unmasked"] = f"WITH RECURSIVE {GRAPH}{UNMASKED} SELECT * FROM lines"
ORACLES["subgraph_text"] = f"WITH RECURSIVE {GRAPH}{lines(1)} SELECT * FROM texts"
ORACLES["evidence_spans"] = f"""WITH {GRAPH}
SELECT stable AS stable_id, regexp_extract(stable, '__s([0-9]+)$', 1)::BIGINT AS span,
       string_split(stable, '__')[1] AS base, shown AS details,
       regexp_extract(shown, '^("[^"]*")', 1) AS props
FROM flagged WHERE label = 'EvidenceNode'"""

# --- similarity ---------------------------------------------------------------------------

VECTORS = """
vec AS (SELECT 'd' || vec_id AS id, 'application_' || label || '__' || vec_id % 5 AS app,
               'application_' || label AS base,
               list_transform(embedding[1:32], lambda x: x::DOUBLE) AS t,
               list_transform(embedding[33:64], lambda x: x::DOUBLE) AS s FROM embeddings),
unit AS (SELECT id, app, base,
           list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-12)) AS t,
           list_transform(s, lambda x: x / (sqrt(list_dot_product(s, s)) + 1e-12)) AS s FROM vec)"""


def topk(k: int, alpha: float, rule: str) -> str:
    return f"""WITH {VECTORS},
scored AS (
  SELECT q.id AS request_id, c.id AS node_id, c.app,
         list_dot_product(q.t, c.t) AS semantic, list_dot_product(q.s, c.s) AS structural
  FROM unit q JOIN unit c ON q.id <> c.id AND {rule}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
             round({alpha} * semantic + (1.0 - {alpha}) * structural, 12) DESC, node_id) AS rank
           FROM scored)
SELECT request_id, rank, node_id, app, {r6(f'{alpha} * semantic + (1.0 - {alpha}) * structural')} AS score,
       {r6('semantic')} AS semantic, {r6('structural')} AS structural
FROM ranked WHERE rank <= {k}"""


ORACLES["hybrid_topk"] = topk(5, 0.5, "q.app <> c.app")
ORACLES["guarded_topk"] = topk(3, 0.7, "q.base <> c.base")
ORACLES["chained_guard_topk"] = topk(
    4, 0.5, "q.base <> c.base AND c.base <> 'application_' || length(q.id)"
)
ORACLES["vector_gate"] = """
SELECT 'DecisionNode' AS kind, vector, 32 AS min_size, 32 AS max_size, count(*) AS n
FROM embeddings CROSS JOIN (SELECT unnest(['text_embedding', 'fastrp_embedding']) AS vector)
GROUP BY vector"""

# --- reports --------------------------------------------------------------------------------

# printf rounds the binary value correctly, which round() does not on ties
def d4(expr: str) -> str:
    return f"printf('%.4f', round({expr}, 12))::DOUBLE"


def cell(mean: str, std: str | None = None) -> str:
    text = f"printf('%.3f', {d4(mean)} + 0.0)"
    return text if std is None else f"{text} || ' ± ' || printf('%.3f', {d4(std)} + 0.0)"


EXPORTED = [*MEAN_METRICS, *[f"{m}_std" for m in MEAN_METRICS], "exact_rate"]
ORACLES["summary_export"] = f"WITH RECURSIVE {RECORDS}{SUMMARY} " + " UNION ALL ".join(
    f"SELECT scope, size, unit_id, n, '{m}' AS metric, {d4(m)} + 0.0 AS value FROM summary"
    for m in EXPORTED
)
SHOWN = {
    "ms_f1": "multiset_f1", "ms_prec": "multiset_precision", "ms_rec": "multiset_recall",
    "seq_f1": "seq_f1", "seq_prec": "seq_precision", "seq_rec": "seq_recall",
    "norm_edit": "normalized_edit_distance", "jaccard": "jaccard", "len_bias": "length_bias",
}
ORACLES["report_table"] = f"""WITH RECURSIVE {RECORDS}{SUMMARY}
SELECT scope, size, n, {cell('exact_rate')} AS exact,
  {', '.join(f'{cell(m, m + "_std")} AS {name}' for name, m in SHOWN.items())}
FROM summary WHERE scope <> 'unit'"""
ORACLES["unit_report"] = f"""WITH RECURSIVE {RECORDS}{SUMMARY}
SELECT unit_id AS unit, first_size AS size, n, {cell('exact_rate')} AS exact,
  {cell('multiset_f1', 'multiset_f1_std')} AS multiset_f1,
  {cell('normalized_edit_distance', 'normalized_edit_distance_std')} AS norm_edit
FROM summary WHERE scope = 'unit'"""


def counted(kind: str) -> str:
    return f"n_{kind} || ' (' || printf('%.3f', n_{kind} / n_aligned::DOUBLE) || ')'"


COUNTED = ", ".join(f'{counted(k)} AS "{k}"' for k in ("match", "sub", "ins", "del"))
ORACLES["ops_report"] = f"""WITH t AS ({ORACLES['confusion_totals']})
SELECT size, n_aligned, {COUNTED} FROM t WHERE n_sub + n_ins + n_del > 0
UNION ALL SELECT NULL, n_aligned, {COUNTED}
FROM (SELECT sum(n_aligned)::BIGINT AS n_aligned, sum(n_match)::BIGINT AS n_match,
        sum(n_sub)::BIGINT AS n_sub, sum(n_ins)::BIGINT AS n_ins, sum(n_del)::BIGINT AS n_del FROM t)"""
ORACLES["summary_lines"] = f"""WITH mix AS ({ORACLES['category_mix']}), counts AS ({ORACLES['run_counts']}),
t AS ({ORACLES['confusion_totals']})
SELECT scope, unit_id, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY n DESC, category)
         || '}}' AS categories, size, sum(n)::BIGINT AS n, NULL AS n_records, NULL AS n_scored,
       NULL AS n_match, NULL AS n_sub, NULL AS n_ins, NULL AS n_del
FROM mix GROUP BY scope, size, unit_id
UNION ALL SELECT 'config', NULL, NULL, NULL, NULL, n_records, n_scored, NULL, NULL, NULL, NULL FROM counts
UNION ALL SELECT 'confusion', NULL, NULL, size, NULL, NULL, NULL, n_match, n_sub, n_ins, n_del FROM t"""

ORACLES["summary_document"] = f"""
SELECT NULL::BIGINT AS size, true_label, pred_label, n FROM ({ORACLES['confusion_matrix_dense']})
UNION ALL SELECT size, true_label, pred_label, n FROM ({ORACLES['confusion_matrix_by_size']})"""

# --- logs, mails, prompts ---------------------------------------------------------------------

MARK = ">>> THIS hidden email TO RECONSTRUCT (activities unknown) <<<"
MAILS = f"""
mev AS (SELECT user_id, strftime(ts, '%Y%m%d') AS day, event_id,
              event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, day)
             // 2 AS middle, 'application_' || user_id || '__' || day AS case_id
           FROM mev WINDOW w AS (PARTITION BY user_id, day ORDER BY event_id)),
mails AS (SELECT conv_id AS user_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS body
          FROM conversations GROUP BY conv_id),
logs AS (SELECT p.case_id, p.pos, p.time, p.event_id, p.pos = p.middle AS hidden,
                CASE WHEN p.pos = p.middle THEN 'internal_email_sent' ELSE p.event_type END AS type,
                p.user_id, m.body FROM placed p LEFT JOIN mails m USING (user_id)),
recs AS (SELECT case_id, any_value(user_id) AS user_id, any_value(body) AS body,
                min(event_id) AS record_pos, count(*) AS n,
                string_agg(CASE WHEN hidden THEN '{MARK}' ELSE '- ' || time || ' | ' || type END,
                           chr(10) ORDER BY pos) AS timeline
         FROM logs GROUP BY case_id)"""


def event_lines(subject: str, body: str) -> str:
    return f""",
lines AS (
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY time, pos) AS n,
    CASE WHEN hidden THEN '- ' || time || ' | internal_email_sent (HIDDEN activities are here)' || chr(10)
      || '  EmailID=m' || event_id || CASE WHEN body IS NULL THEN '' ELSE ' | Sender=user' END
      || ' | objects: u' || user_id || chr(10)
      || '  Subject: ' || {subject} || chr(10) || '  Body: ' || {body}
    ELSE '- ' || time || ' | ' || type || ' [objects: u' || user_id || ']' END AS line
  FROM logs)"""


SHOWN_MAIL = event_lines("coalesce(left(body, 40), '')", "coalesce(body, '')")
ORACLES["nested_log_flatten"] = f"""WITH {MAILS}
SELECT case_id AS graph_key, pos, type, time, CASE WHEN hidden THEN 'm' || event_id END AS email_id,
       'u' || user_id AS objects FROM logs"""
ORACLES["case_timeline"] = f"""WITH {MAILS}{SHOWN_MAIL}
SELECT case_id AS graph_key, n, line FROM lines"""
ORACLES["case_timeline_redacted"] = f"""WITH {MAILS}{event_lines("'[redacted]'", "'[redacted]'")}
SELECT case_id AS graph_key, string_agg(line, chr(10) ORDER BY n) AS body FROM lines GROUP BY case_id"""
ORACLES["log_requests"] = f"""WITH {MAILS}{SHOWN_MAIL},
bodies AS (SELECT case_id, string_agg(line, chr(10) ORDER BY n) AS body, count(*) AS n
           FROM lines GROUP BY case_id),
asked AS (SELECT 'A' || case_id[2:] AS id, case_id FROM bodies
          UNION ALL SELECT case_id, case_id FROM bodies)
SELECT id AS application_id, 'ok' AS status, 'Observed event log of application ' || id
         || ' (hidden activities are behind the internal_email_sent event):' || chr(10)
         || 'Events (chronological):' || chr(10) || body AS text
FROM asked JOIN bodies USING (case_id)
UNION ALL SELECT 'no_' || case_id, 'unknown_id', NULL FROM bodies
UNION ALL SELECT 'customer_' || c_custkey, 'missing_file', NULL FROM customer"""
ORACLES["guarded_log_requests"] = f"""WITH {MAILS}{SHOWN_MAIL},
bodies AS (SELECT case_id, 'A' || case_id[2:] AS other, string_agg(line, chr(10) ORDER BY n) AS body
           FROM lines GROUP BY case_id),
asked AS (
  SELECT case_id AS id, case_id AS current_app, 'refused_current' AS verdict, body FROM bodies
  UNION ALL SELECT other, case_id, 'refused_current', body FROM bodies
  UNION ALL SELECT case_id, other, 'refused_current', body FROM bodies
  UNION ALL SELECT other, string_split(case_id, '__')[1] || '__none', 'refused_sibling', body FROM bodies
  UNION ALL SELECT case_id, 'application_none__1', 'allowed', body FROM bodies
  UNION ALL SELECT other, NULL, 'allowed', body FROM bodies
  UNION ALL SELECT 'no_' || case_id, case_id, 'allowed', NULL FROM bodies)
SELECT id AS application_id, current_app, verdict,
       CASE WHEN verdict <> 'allowed' THEN NULL WHEN body IS NULL THEN 'unknown_id' ELSE 'ok' END AS status,
       CASE WHEN verdict = 'allowed' THEN 'Observed event log of application ' || id
         || ' (hidden activities are behind the internal_email_sent event):' || chr(10)
         || 'Events (chronological):' || chr(10) || body END AS text FROM asked"""

ORACLES["guarded_requests"] = """WITH r AS (
  SELECT vec_id, 'application_' || label AS base, 'application_' || label || '__' || vec_id % 5
           AS application_id,
         CASE WHEN label < 5 THEN 'application_' || label || '__0'
              WHEN label < 9 THEN 'application_0__1' END AS current_app,
         CASE WHEN label < 5 THEN 'application_' || label
              WHEN label < 9 THEN 'application_0' END AS current_base FROM embeddings)
SELECT vec_id, application_id, current_app,
       CASE WHEN application_id = current_app THEN 'refused_current'
            WHEN base = current_base THEN 'refused_sibling' ELSE 'allowed' END AS verdict,
       CASE WHEN application_id = current_app THEN 'refused_current' ELSE 'allowed' END
         AS verdict_same_case_allowed FROM r"""
OTHERS_TEXT = lines(1).replace("f.label, f.shown,", "f.label, replace(f.shown, ', this email', ', other') AS shown,")
ORACLES["guarded_subgraph"] = f"""WITH RECURSIVE {GRAPH}{OTHERS_TEXT},
r AS (SELECT 'application_' || o_custkey || '__' || o_orderkey AS application_id, o_orderstatus AS s,
             o_custkey FROM orders)
SELECT application_id, CASE s WHEN 'O' THEN application_id
         WHEN 'P' THEN 'application_' || o_custkey || '__none' ELSE 'application_none__1' END AS current_app,
       CASE s WHEN 'O' THEN 'refused_current' WHEN 'P' THEN 'refused_sibling' ELSE 'allowed' END AS verdict,
       CASE WHEN s = 'F' THEN 'ok' END AS status,
       CASE WHEN s = 'F' THEN 'Context subgraph for application ' || application_id
         || ' (<= 1 hop(s)):' || chr(10) || text END AS text
FROM r JOIN texts ON texts.asked = r.application_id"""
ORACLES["coverage_gate"] = f"""SELECT count(*) AS n_records,
  count(*) FILTER (o_orderpriority <> '1-URGENT') AS n_resolved,
  {r6("count(*) FILTER (o_orderpriority <> '1-URGENT') / count(*)::DOUBLE")} AS coverage FROM orders"""
ORACLES["case_subgraph_text"] = f"""WITH RECURSIVE {GRAPH}{lines(2)},
named AS (SELECT asked AS id, asked FROM texts
          UNION ALL SELECT 'Purchase order', arg_min(app, pos) FROM flagged WHERE app IS NOT NULL)
SELECT id AS asked, 'ok' AS status, 'Context subgraph for application ' || id || ' (<= 2 hop(s)):'
       || chr(10) || text AS text FROM named JOIN texts USING (asked)
UNION ALL SELECT 'application_none', 'unknown_id', NULL"""

SIMILAR = lines(1)
SIMILAR = SIMILAR[SIMILAR.index(",\ntags AS"):].replace(
    "f.label, f.shown,", "f.label, replace(f.shown, ', this email', ', other') AS shown,"
)
ORACLES["similar_context"] = f"""WITH RECURSIVE {GRAPH},
{topk(5, 0.5, "q.base <> c.base")[5:topk(5, 0.5, "q.base <> c.base").index("SELECT request_id, rank")]},
hits AS (SELECT *, request_id || '#' || rank AS hit FROM ranked WHERE rank <= 5),
members AS (SELECT hit AS asked, node_id AS node FROM hits
            UNION SELECT h.hit, a.dst FROM hits h JOIN adj a ON a.src = h.node_id
              JOIN flagged g ON g.id = a.dst WHERE NOT g.leaky){SIMILAR},
entries AS (
  SELECT h.request_id, h.rank, rank || '. [dec_' || node_id[2:] || '] score='
    || printf('%.3f', 0.5 * semantic + 0.5 * structural) || ' (semantic=' || printf('%.3f', semantic)
    || ', structural=' || printf('%.3f', structural) || ') application=' || app || chr(10)
    || '   neighborhood (<= 1 hop(s)):' || chr(10) || '   '
    || replace(t.text, chr(10), chr(10) || '   ') AS entry
  FROM hits h JOIN texts t ON t.asked = h.hit)
SELECT request_id, 'Top ' || count(*) || ' decisions similar to dec_' || request_id[2:]
  || ' (hybrid score = 0.50*semantic + 0.50*structural):' || chr(10)
  || string_agg(chr(10) || entry, chr(10) ORDER BY rank) AS text
FROM entries GROUP BY request_id"""



def hits_of(kind: str, letter: str, short: str, k: int, alpha: float, swapped: bool) -> str:
    """Ranked hits among nodes of one kind made from the embeddings, siblings left out."""
    found = topk(k, alpha, "q.base <> c.base").replace("'d' || vec_id AS id", f"'{letter}' || vec_id AS id")
    if swapped:
        found = found.replace("embedding[1:32]", "embedding[0:0]").replace(
            "embedding[33:64]", "embedding[1:32]").replace("embedding[0:0]", "embedding[33:64]")
    return found[5:found.index("SELECT request_id, rank")]


ORACLES["similar_rationales"] = f"""WITH RECURSIVE {GRAPH},
{hits_of('RationaleNode', 'r', 'rat', 3, 0.7, True)},
hits AS (SELECT *, request_id || '#' || rank AS hit FROM ranked WHERE rank <= 3),
members AS (SELECT hit AS asked, node_id AS node FROM hits
            UNION SELECT h.hit, a.dst FROM hits h JOIN adj a ON a.src = h.node_id
              JOIN flagged g ON g.id = a.dst WHERE NOT g.leaky){SIMILAR},
entries AS (
  SELECT h.request_id, h.rank, rank || '. [rat_' || node_id[2:] || '] score='
    || printf('%.3f', 0.7 * semantic + (1.0 - 0.7) * structural) || ' (semantic=' || printf('%.3f', semantic)
    || ', structural=' || printf('%.3f', structural) || ') application=' || app || chr(10)
    || '   text: "' || app || '"'
    || coalesce(chr(10) || '   neighborhood (<= 1 hop(s)):' || chr(10) || '   '
       || replace(t.text, chr(10), chr(10) || '   '), '') AS entry
  FROM hits h LEFT JOIN texts t ON t.asked = h.hit)
SELECT request_id, 'Top ' || count(*) || ' rationales similar to rat_' || request_id[2:]
  || ' (hybrid score = 0.70*semantic + 0.30*structural):' || chr(10)
  || string_agg(chr(10) || entry, chr(10) ORDER BY rank) AS text
FROM entries GROUP BY request_id"""
ORACLES["similar_answers"] = f"""WITH RECURSIVE {GRAPH},
{hits_of('DecisionNode', 'd', 'dec', 1, 0.5, False)},
hits AS (SELECT *, request_id || '#' || rank AS hit FROM ranked WHERE rank <= 1),
members AS (SELECT hit AS asked, node_id AS node FROM hits){SIMILAR},
found AS (
  SELECT h.request_id, 'Top 1 decisions similar to dec_' || h.request_id[2:]
    || ' (hybrid score = 0.50*semantic + 0.50*structural):' || chr(10) || chr(10)
    || rank || '. [dec_' || node_id[2:] || '] score='
    || printf('%.3f', 0.5 * semantic + 0.5 * structural) || ' (semantic=' || printf('%.3f', semantic)
    || ', structural=' || printf('%.3f', structural) || ') application=' || app
    || coalesce(chr(10) || '   neighborhood (<= 0 hop(s)):' || chr(10) || '   '
       || replace(t.text, chr(10), chr(10) || '   '), '') AS text
  FROM hits h LEFT JOIN texts t ON t.asked = h.hit),
asked AS (SELECT vec_id, 'd' AS letter, 'dec_' AS short, 'decision' AS noun, 'DecisionNode' AS kind FROM embeddings
          UNION ALL SELECT vec_id, 'r', 'rat_', 'rationale', 'RationaleNode' FROM embeddings WHERE label = 0)
SELECT letter || vec_id AS request_id, short || vec_id AS query_id,
       CASE WHEN letter = 'd' THEN 'found' ELSE 'nothing_comparable' END AS status,
       coalesce(f.text, 'There is no other ' || noun || ' to compare it with.') AS text
FROM asked LEFT JOIN found f ON f.request_id = letter || vec_id
UNION ALL SELECT 'no_' || letter || vec_id, 'no_' || short || vec_id, 'unknown_id',
       'The graph has no ' || noun || ' with the id no_' || short || vec_id || '. Use the id of a ' || kind
         || ' in the subgraph of the current application.'
FROM asked"""
BLANK = "' ' || " + " || ".join(f"chr({c})" for c in (
    *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
))
ORACLES["clipped_texts"] = f"""WITH t AS (SELECT doc_id, nullif(text, '') AS raw, trim(text, {BLANK}) AS shown FROM documents)
SELECT doc_id, '"' || CASE WHEN coalesce(shown, '') = '' THEN '(no text)' WHEN length(shown) > 4000
         THEN left(shown, 4000) || '…' ELSE shown END || '", other' AS details,
       CASE WHEN raw IS NULL THEN 'no details' WHEN length(raw) > 4000 THEN '"' || left(raw, 4000) || '…"'
         ELSE '"' || raw || '"' END AS props,
       CASE WHEN raw IS NULL THEN '' WHEN length(raw) > 2000 THEN left(raw, 2000) || '…' ELSE raw END AS hit
FROM t"""

ORACLES["timeline_text"] = f"""WITH {MAILS}
SELECT record_pos, timeline, CASE WHEN body IS NULL THEN '' ELSE 'u' || user_id END AS objects FROM recs"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ANSWER = (
    '{"activities": ["<exact event_type>", ...], "confidence": <number 0-1>, '
    '"reasoning": "<one short sentence>"}'
)
SYSTEM = (
    "You analyse business processes. One e-mail of a case stands for a hidden run of events. List the "
    "activities of that run in the order they happened, using catalog names exactly as written and at "
    "least one of them. Take the order from the given sources, not from the catalog. Answer with JSON only."
)
EMAIL_NOTE = "The status mail sent inside the case. List what its sender reports, in their order."
TIMELINE_NOTE = (
    "Events seen before and after the mail; >>> THIS marks its place. Events on either side are not part "
    "of the answer. Use them only to tell similar activities apart."
)
TIMELINE_HEADING = "=== OCEL CONTEXT (observed case timeline) ==="
CATALOG_NOTE = 'Catalog of possible activities, one "<event_type>: <description>" per line:'
CATALOG = (
    "- signup: a new account is opened\n- error: a request could not be served\n"
    "- click: an element of a page is chosen\n- view: a page is shown\n- purchase: an order is paid"
)

MAIL_BLOCK = (
    quoted(f"=== EMAIL ===\n{EMAIL_NOTE}\nSender : user\nObjects: u")
    + " || user_id || " + quoted("\nSubject: ") + " || left(body, 40) || " + quoted("\nBody:\n")
    + " || body || " + quoted("\n\n")
)
LOG_BLOCK = (
    quoted(f"{TIMELINE_HEADING}\n{TIMELINE_NOTE}\n") + " || timeline || " + quoted("\n\n")
)
CATALOG_BLOCK = quoted(f"{CATALOG_NOTE}\n{CATALOG}\n\n")


def keyed(user: str, cap: int) -> str:
    return f"sha256(concat_ws(chr(0), '{cap}', '0', 'high', {quoted(SYSTEM)}, {user}))"


TASK = (
    "List the activities of the hidden e-mail in the order performed.\nRespond with JSON only:\n"
    + ANSWER + "\nRepeat an activity only if it happened more than once. Never return an empty list."
)
WITH_CAP = quoted(TASK + " Return AT MOST 3 activities - never more than 3.")
ORACLES["prompt_table"] = f"""WITH {MAILS},
p AS (SELECT record_pos, {CATALOG_BLOCK} || {MAIL_BLOCK} || {LOG_BLOCK} || {WITH_CAP} AS "user"
      FROM recs WHERE body IS NOT NULL)
SELECT record_pos, {quoted(SYSTEM)} AS system, "user", {keyed('"user"', 3)} AS prompt_key FROM p"""
ONE = quoted(
    "Name the single most relevant activity of the hidden e-mail.\nRespond with JSON only:\n"
    + ANSWER.replace(", ...]", "]") + "\nReturn exactly one activity."
)
ORACLES["prompt_single"] = f"""WITH {MAILS},
p AS (SELECT record_pos, {CATALOG_BLOCK} || {MAIL_BLOCK} || {LOG_BLOCK} || {ONE} AS "user"
      FROM recs WHERE body IS NOT NULL)
SELECT record_pos, {quoted(SYSTEM)} AS system, "user",
       {keyed('"user"', 0).replace("'0', '0', 'high'", "'0', '1', 'high'")} AS prompt_key FROM p"""
MAIL_PROMPTS = f"""WITH {MAILS},
p AS (SELECT record_pos, case_id, {CATALOG_BLOCK} || CASE WHEN body IS NULL THEN '' ELSE {MAIL_BLOCK} END
        || {quoted(TASK)} AS "user" FROM recs),
k AS (SELECT record_pos, case_id, "user", {keyed('"user"', 0)} AS prompt_key FROM p)"""
ORACLES["prompt_dedup"] = f"""{MAIL_PROMPTS}
SELECT prompt_key, count(*) AS n_records, min(record_pos) AS record_pos FROM k GROUP BY prompt_key"""

GRAPH_SYSTEM = (
    SYSTEM + " Actors are tied to the cluster by linked_to. Look up comparable decisions or rationales "
    "by the seed ids, then read the logs and subgraphs of the cases found. The current case and other "
    "samplings of it are refused. Go through the evidence spans in ascending order, decide for each "
    "whether it reports no step, one step or several, and name the catalog activities. Answer with one "
    "JSON object: " + ANSWER
)
GRAPH_HEAD = quoted("List the ordered activities hidden behind the e-mail of application ")
ORACLES["prompt_table_graph"] = f"""WITH RECURSIVE {GRAPH}{lines(2)},
o AS (SELECT *, 'application_' || o_custkey || '__' || o_orderkey AS app FROM orders)
SELECT o_orderkey AS record_pos, app AS application_id, {quoted(GRAPH_SYSTEM)} AS system,
  {GRAPH_HEAD} || app || {quoted(f".{chr(10)}{chr(10)}{CATALOG_NOTE}{chr(10)}{CATALOG}")}
  || {quoted(f"{chr(10)}{chr(10)}Current application id: ")} || app
  || {quoted(f"{chr(10)}Seed node ids in this application:{chr(10)}- decisions: ")} || 'dec_' || o_orderkey
  || {quoted(f"{chr(10)}- rationales: ")} || 'rat_' || o_orderkey
  || {quoted(f"{chr(10)}{chr(10)}The case as a graph. Evidence marked span=<n> is the mail, in reading order.{chr(10)}")}
  || 'Context subgraph for application ' || app || ' (<= 2 hop(s)):' || chr(10) || text
  || {quoted(f"{chr(10)}{chr(10)}{TIMELINE_HEADING}{chr(10)}{TIMELINE_NOTE}{chr(10)}")}
  || '- ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderstatus
  || {quoted(f"{chr(10)}{chr(10)}Compare with similar cases before answering; this case's own log is above.{chr(10)}{chr(10)}Respond with one JSON object: {ANSWER}")}
    AS "user"
FROM o JOIN texts ON texts.asked = o.app"""

# --- answers ------------------------------------------------------------------------------------

ANSWERS = RECORDS + """,
raw AS (SELECT record_pos, case_id, has_email, confidence,
               list_filter(p, lambda x: x <> 'refund') AS named,
               list_contains(p, 'error') AND len(p) > 3 AS vague, len(p) = 0 AS lost,
               NOT list_contains(p, 'refund') AND t[len(t)] = 'click' AS chatty FROM records),
plain AS (SELECT *, CASE WHEN lost OR chatty THEN 'no_json' WHEN vague THEN 'bad_confidence' END AS error
          FROM raw)"""
ORACLES["response_normalise"] = f"""WITH {ANSWERS}
SELECT record_pos, error, CASE WHEN error IS NULL THEN array_to_string(named[1:4], '>') ELSE '' END AS pred,
       CASE WHEN error IS NULL THEN {r6('confidence')} ELSE 0.0 END AS confidence FROM plain"""
ORACLES["response_normalise_agent"] = f"""WITH {ANSWERS}
SELECT record_pos, CASE WHEN lost THEN 'no_json' END AS error, array_to_string(named, '>') AS pred,
       CASE WHEN lost OR vague THEN 0.0 ELSE {r6('confidence')} END AS confidence FROM raw"""
ORACLES["response_single"] = f"""WITH {ANSWERS}
SELECT record_pos, error, CASE WHEN error IS NULL THEN array_to_string(named[1:1], '>') ELSE '' END AS pred FROM plain"""
ORACLES["response_outcomes"] = f"""WITH {ANSWERS}
SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM plain GROUP BY 1"""
ORACLES["predictions_echo"] = f"""WITH {ANSWERS}
SELECT record_pos, case_id,
       CASE WHEN has_email AND error IS NULL THEN array_to_string(named, '>') ELSE '' END AS pred,
       CASE WHEN has_email AND error IS NULL THEN {r6('confidence')} ELSE 0.0 END AS confidence FROM plain"""

ORACLES["predictions_echo_lines"] = f"""WITH {ANSWERS}
SELECT record_pos, case_id, array_to_string(t, '>') AS unit_id,
       CASE WHEN len(t) = 1 THEN 0 ELSE len(t) END AS declared_size,
       CASE WHEN has_email THEN case_id END AS subject, array_to_string(t, '>') AS true_list,
       CASE WHEN has_email AND error IS NULL THEN array_to_string(named, '>') ELSE '' END AS pred,
       CASE WHEN has_email AND error IS NULL THEN {r6('confidence')} ELSE 0.0 END AS confidence
FROM plain JOIN (SELECT case_id, t FROM records) USING (case_id)"""

# --- scans ----------------------------------------------------------------------------------------

ORACLES["graph_json_scan"] = f"""WITH {GRAPH}
SELECT id AS node_id, label, stable AS stable_id, app AS app_id,
       CASE WHEN label = 'RationaleNode' THEN shown
            WHEN label = 'EvidenceNode' THEN regexp_extract(shown, '^("[^"]*")', 1)
            ELSE shown END AS props
FROM flagged WHERE label <> 'ValueNode' OR id IN (SELECT dst FROM edges)"""
ORACLES["graph_json_edges"] = f"WITH {GRAPH} SELECT * FROM edges"
ORACLES["graph_json_rejects"] = f"""WITH {GRAPH}
SELECT (SELECT count(*) FROM nodes WHERE label <> 'ValueNode') + (SELECT count(*) FROM edges)
       + (SELECT count(*) FROM supplier) AS n_lines, (SELECT count(*) FROM supplier) AS n_rejected"""
ORACLES["vector_json_scan"] = f"""
SELECT 'd' || vec_id AS node_id, 'dec_' || vec_id AS stable_id, 32 AS n_text, label = 0 AS lacks_structure,
       {r6('list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE))')} AS text_sum FROM embeddings"""
ORACLES["records_json_scan"] = f"""WITH {RECORDS}
SELECT record_pos, case_id, unit_id, has_email, {r6('confidence')} AS confidence,
       CASE WHEN size = 1 THEN 0 ELSE size END AS declared_size, array_to_string(t, '>') AS true_list,
       array_to_string(p, '>') AS pred_list, CASE WHEN has_email THEN case_id END AS subject FROM records"""
ORACLES["records_by_fallback"] = f"""WITH {RECORDS}
SELECT case_id, unit_id, has_email, CASE WHEN size = 1 THEN 0 ELSE size END AS declared_size,
       array_to_string(t, '>') AS true_list FROM records"""
ORACLES["catalog_scan"] = """WITH c AS (
  SELECT event_type, upper(event_type[1]) || event_type[2:] AS capital, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT event_type AS low, event_type, 0 AS o, n, capital FROM c
      UNION ALL SELECT event_type, capital, 1, n, capital FROM c)
SELECT (row_number() OVER (ORDER BY low, o) - 1)::INTEGER AS pos, event_type,
       'seen ' || n || ' times' AS description, capital AS canonical,
       string_agg('- ' || event_type || ': seen ' || n || ' times', chr(10))
         OVER (ORDER BY low, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS catalog
FROM e"""
ORACLES["prompt_audit"] = f"""{MAIL_PROMPTS},{ANSWERS},
told AS (SELECT r.record_pos, t, p, '{{"activities": ' || CASE
           WHEN len(p) = 1 THEN '"' || p[1] || '"'
           WHEN t[1] = 'view' THEN to_json(list_transform(p, lambda x: ' ' || upper(x) || chr(9)))::VARCHAR
           ELSE to_json(p)::VARCHAR END || ', "confidence": '
           || CASE WHEN list_contains(p, 'error') AND len(p) > 3 THEN '"high"' ELSE confidence::VARCHAR END
           || ', "reasoning": "as told"}}' AS body FROM records r),
raws AS (SELECT record_pos, CASE WHEN len(p) = 0 THEN 'I cannot tell {{from this}}.'
           WHEN list_contains(p, 'refund') THEN '```json' || chr(10) || body || chr(10) || '```'
           WHEN t[len(t)] = 'click' THEN 'Here it is: ' || body || ' Done.' ELSE body END AS raw FROM told),
firsts AS (SELECT prompt_key, min(record_pos) AS first_pos FROM k GROUP BY prompt_key),
asked AS (SELECT f.prompt_key, f.first_pos, a.error, w.raw FROM firsts f
          JOIN plain a ON a.record_pos = f.first_pos JOIN raws w ON w.record_pos = f.first_pos)
SELECT k.record_pos, k.case_id AS folder, {quoted(SYSTEM)} AS system, k."user", asked.raw AS assistant,
       CASE WHEN error IS NOT NULL THEN 'failed' WHEN k.record_pos <> first_pos THEN 'cache-hit'
            ELSE 'ok' END AS status, error
FROM k JOIN asked USING (prompt_key) WHERE error IS NULL OR k.record_pos = first_pos"""
