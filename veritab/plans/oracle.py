"""The queries in DuckDB's SQL, on the driver's tables. Written apart from the Spark plans, with their own values; those of rules and questions are in ``rule_sql``."""

from __future__ import annotations

from difflib import SequenceMatcher

from veritab.plans import rule_sql
from veritab.plans.rule_sql import PARAMETERS, quoted, some

UNITS = """units_fx AS (
  SELECT 'u' || o_orderkey AS id, o_totalprice AS value, 0.5 AS agreement, CAST(o_custkey % 97 AS VARCHAR) AS doc_id, CAST(o_orderkey % 7 AS INT) AS page, o_orderkey AS fact_ord,
    ['VCC', 'VCC max', 'ICC', 'PD', 'RthJA', 'TJ max', 'FCLK', 'IO'][o_orderkey % 8 + 1] AS label,
    ['supply voltage', 'absolute maximum voltage', 'supply current', 'power dissipation', 'thermal resistance junction to ambient',
     'maximum junction temperature', 'maximum clock frequency', 'output current'][o_orderkey % 8 + 1] AS context,
    CASE o_orderkey % 8 WHEN 0 THEN (CASE WHEN o_orderkey % 3 = 0 THEN 'mV' ELSE 'V' END) WHEN 1 THEN 'V' WHEN 2 THEN 'mA' WHEN 3 THEN 'mW' WHEN 4 THEN '°C/W' WHEN 5 THEN '°C' WHEN 6 THEN 'MHz'
      ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE 'mA' END) END AS uom
  FROM orders)"""
RANGES = """ranges_fx AS (
  SELECT 'r' || p_partkey AS id, p_brand AS label, CAST(p_size AS DOUBLE) AS lo, CAST(p_partkey % 60 AS DOUBLE) AS typ, p_retailprice / 20 AS hi, CAST(p_partkey % 97 AS VARCHAR) AS doc_id, p_partkey AS fact_ord FROM part)"""
BASE = f"""{UNITS},
base_fx AS (
  SELECT *, CASE uom WHEN 'mV' THEN 0.001 WHEN 'mA' THEN 0.001 WHEN 'mW' THEN 0.001 WHEN 'MHz' THEN 1000000.0 WHEN '°C/W' THEN NULL ELSE 1.0 END * value AS base,
    CASE uom WHEN 'mV' THEN 'V' WHEN 'V' THEN 'V' WHEN 'mA' THEN 'A' WHEN 'A' THEN 'A' WHEN 'mW' THEN 'W' WHEN 'MHz' THEN 'Hz' WHEN '°C' THEN 'C' END AS base_unit
  FROM units_fx)"""
CONTRADICTIONS = f"""{BASE},
keyed AS (SELECT *, lower(label) || '|' || CASE WHEN contains(context, 'minimum') THEN 'min' WHEN contains(context, 'maximum') THEN 'max' ELSE '' END AS key FROM base_fx WHERE base IS NOT NULL),
first_fx AS (SELECT *, first_value(base) OVER w AS ref, first_value(base_unit) OVER w AS ref_unit, row_number() OVER w AS n FROM keyed WINDOW w AS (PARTITION BY doc_id, key ORDER BY fact_ord)),
contradiction AS (SELECT doc_id, key, ref, base FROM first_fx WHERE n > 1 AND base_unit = ref_unit AND abs(base - ref) >= 1e-9)"""
GRIDS = """cells_fx AS (
  SELECT s_nationkey, CAST(s_nationkey % 5 AS VARCHAR) AS doc_id, 'g' || s_nationkey AS id, CAST(s_nationkey // 5 AS INT) AS page, lower(s_name) AS header, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS value,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n_rows, s_name
  FROM supplier),
grids_fx AS (SELECT s_nationkey, doc_id, id, page, n_rows, min(CASE WHEN r = 0 THEN header END) AS h0, min(CASE WHEN r = 0 THEN value END) AS h1 FROM cells_fx GROUP BY ALL),
pairs_fx AS (
  SELECT a.doc_id, a.id AS id_a, b.id AS id_b, a.page, a.s_nationkey AS a_key, b.s_nationkey AS b_key, CASE WHEN a.h1 = b.h1 THEN 1.0 / 3 ELSE 0.0 END AS similarity
  FROM grids_fx a JOIN grids_fx b ON a.doc_id = b.doc_id AND b.page = a.page + 1
  WHERE 0.72 + 0.05 * (a.s_nationkey % 7) >= 0.80 AND 0.06 * (b.s_nationkey % 5) <= 0.20)"""
CORRECTIONS = """corrections_fx AS (
  SELECT event_id AS id, CAST(user_id % 50 AS VARCHAR) AS doc_id, ['unit', 'unit', 'range', 'grid'][event_id % 4 + 1] AS ctype, event_id % 3 <> 0 AS correct, event_id % 5 AS k, event_id % 9 + 1 AS n, event_id, ts FROM events)"""
PATTERNS = f"""{CORRECTIONS},
found AS (
  SELECT 'unit_confusion' AS category, CASE k WHEN 0 THEN 'mv' ELSE 'ma' END AS original_pattern, CASE k WHEN 0 THEN 'v' ELSE 'a' END AS corrected_pattern, doc_id FROM corrections_fx WHERE correct AND k IN (0, 3)
  UNION ALL SELECT 'value_scaling', CASE k WHEN 1 THEN '10x' ELSE '1000x' END, CASE k WHEN 1 THEN 'divide_by_10x' ELSE 'divide_by_1000x' END, doc_id FROM corrections_fx WHERE correct AND k IN (1, 4)
  UNION ALL SELECT 'label_misread', 'therml resistance', 'thermal resistance', doc_id FROM corrections_fx WHERE correct AND k = 2
  UNION ALL SELECT 'type_bias', ctype, '', doc_id FROM corrections_fx WHERE correct),
grouped AS (
  SELECT category, original_pattern, corrected_pattern, count(*) AS occurrences, CAST(count(DISTINCT doc_id) AS INT) AS n_docs, (SELECT count(*) FROM corrections_fx WHERE correct) AS total
  FROM found GROUP BY ALL),
patterns AS (
  SELECT category, original_pattern, corrected_pattern, occurrences, n_docs,
    round(CASE category WHEN 'type_bias' THEN occurrences / total WHEN 'label_misread' THEN least(1.0, occurrences / 8.0) ELSE least(1.0, occurrences / 10.0) END, 4) AS confidence,
    category <> 'type_bias' AND occurrences >= 5 AS auto_correctable
  FROM grouped WHERE (category <> 'label_misread' OR occurrences >= 2) AND (category <> 'type_bias' OR (occurrences > 0.3 * total AND occurrences >= 3 AND total >= 5)))"""
RESULTS = """results_fx AS (SELECT 'chip' || doc_id % 5 AS chip, quality = 1 AS correct, ['verified', 'review', 'refused'][doc_id % 3 + 1] AS status FROM labels)"""
FIGURES = """count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) * 100.0 / count(*) AS accuracy,
  count(*) FILTER (status = 'refused') * 100.0 / count(*) AS false_refuse_rate,
  CASE WHEN count(*) FILTER (status = 'verified') > 0 THEN count(*) FILTER (status = 'verified' AND NOT correct) * 100.0 / count(*) FILTER (status = 'verified') ELSE 0.0 END AS false_accept_rate,
  CASE WHEN count(*) FILTER (status = 'refused') > 0 THEN count(*) FILTER (status = 'refused' AND NOT correct) * 100.0 / count(*) FILTER (status = 'refused') ELSE 100.0 END AS refuse_precision"""
CORPUS = "corpus_fx AS (SELECT doc_id, sha256(text) AS content_hash, 'M' || doc_id % 500 AS mpn, source AS chip_name FROM documents)"


def first_unit(where: str, as_of: str = "min") -> str:
    return f"arg_{as_of}(struct_pack(value := value, uom := uom, id := id), fact_ord) FILTER ({where})"


DERIVED = f"""{UNITS},
d AS (
  SELECT doc_id,
    {first_unit("label IN ('VCC', 'VCC max') AND uom IN ('V', 'mV')")} AS v, {first_unit("label = 'ICC'")} AS i, {first_unit("label = 'RthJA'")} AS th, {first_unit("label = 'PD'")} AS p, {first_unit("label = 'TJ max'")} AS tj,
    {first_unit("label IN ('VCC', 'VCC max') AND uom = 'V'")} AS op, {first_unit("label = 'VCC max'")} AS mx,
    count(*) FILTER (label = 'IO' OR label = 'PD' AND uom IN ('A', 'mA')) AS n_out, coalesce(sum(value) FILTER (label = 'IO' AND uom = 'mA'), 0) AS ma, coalesce(sum(value) FILTER (label = 'IO' AND uom = 'A'), 0) AS a
  FROM units_fx GROUP BY doc_id)"""
COMPARE = f"""{UNITS},
docs AS (SELECT DISTINCT doc_id, CAST(doc_id AS INT) AS doc_ord FROM units_fx),
hits AS ({" UNION ALL ".join(f"SELECT '{n}' AS parameter, doc_id, value, uom, id, fact_ord FROM units_fx WHERE ({some('lower(context)', ctx)} OR {some('lower(label)', lbl)}) AND {rule_sql.among('lower(uom)', units)}" for n, _, ctx, lbl, units, _ in PARAMETERS)}),
firsts AS (SELECT parameter, doc_id, arg_min(value, fact_ord) AS value, arg_min(uom, fact_ord) AS unit, arg_min(id, fact_ord) AS source_id FROM hits GROUP BY ALL),
params AS (SELECT * FROM (VALUES {", ".join(f"('{p[0]}', {p[1]})" for p in PARAMETERS)}) AS v(parameter, sign)),
compared AS (
  SELECT p.parameter, d.doc_id, f.value, f.unit, f.source_id,
    f.value IS NOT NULL AND row_number() OVER (PARTITION BY p.parameter ORDER BY f.value IS NULL, f.value * p.sign, d.doc_ord) = 1 AS is_best
  FROM params p CROSS JOIN docs d LEFT JOIN firsts f ON f.parameter = p.parameter AND f.doc_id = d.doc_id)"""
OVERLAP = [w for w in "what is the maximum supply voltage of the clock output".split() if w not in rule_sql.STOP.split()]
MEASURED = {"voltage": ("mV", "kV"), "current": ("µA", "A"), "capacity": ("mAh", "Wh"), "power": ("mW", "W"), "temperature": ("K", "K"), "frequency": ("GHz", "Hz"), "time": ("µs", "ms"), "dimension": ("in", "mm"), "weight": ("kg", "oz")}

#: The labels of facts, of both sides of a consensus, and how alike they are.
LABELS = ["vcc", "vcc max", "icc", "pd", "rthja", "tj max", "fclk", "io", "unlike"]
CONSENSUS = f"""RECURSIVE {UNITS},
ratio_fx(l, r, ratio) AS (VALUES {", ".join(f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()!r}::DOUBLE)" for a in LABELS for b in LABELS)}),
a_fx AS (SELECT doc_id, page, fact_ord, lower(label) AS label, value, lower(uom) AS uom, row_number() OVER (PARTITION BY doc_id, page ORDER BY fact_ord) AS i FROM units_fx),
b_fx AS (SELECT doc_id, page, i, CASE WHEN fact_ord % 5 = 0 THEN 'unlike' ELSE label END AS label, CASE WHEN fact_ord % 5 = 0 THEN -value ELSE value END AS value, CASE WHEN fact_ord % 5 = 0 THEN 'lm' ELSE uom END AS uom FROM a_fx),
alike AS (
  SELECT a.doc_id, a.page, a.i, b.i AS j, (0.4::DOUBLE * (abs(a.value - b.value) < 0.01)::INT + 0.3::DOUBLE * r.ratio + 0.2::DOUBLE * (a.uom = b.uom)::INT + 0.1::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE) AS s
  FROM a_fx a JOIN b_fx b ON a.doc_id = b.doc_id AND a.page = b.page JOIN ratio_fx r ON r.l = a.label AND r.r = b.label),
choices AS (SELECT doc_id, page, i, list(struct_pack(j := j, s := s) ORDER BY s DESC, j) AS options FROM alike WHERE s >= 0.6::DOUBLE GROUP BY ALL),
sizes AS (SELECT doc_id, page, count(*) AS n FROM a_fx GROUP BY ALL),
run(doc_id, page, n, i, used, total) AS (
  SELECT doc_id, page, n, 0::BIGINT, []::BIGINT[], 0::DOUBLE FROM sizes
  UNION ALL
  SELECT doc_id, page, n, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, total + coalesce(best.s, 0)
  FROM (SELECT r.doc_id, r.page, r.n, r.i, r.used, r.total, list_filter(c.options, lambda o: NOT list_contains(r.used, o.j))[1] AS best
    FROM run r LEFT JOIN choices c ON c.doc_id = r.doc_id AND c.page = r.page AND c.i = r.i + 1 WHERE r.i < r.n))"""

ORACLE_SQL: dict[str, str] = {
    "facts_by_doc": f"WITH {UNITS} SELECT id, label, value AS value_num, uom AS unit_of_measure, context, page, fact_ord FROM units_fx WHERE doc_id = '7'",
    "facts_union_all": f"""WITH {UNITS}, {RANGES} SELECT 'units' AS kind, doc_id, page, fact_ord, id FROM units_fx UNION ALL SELECT 'ranges', doc_id, 0, fact_ord, id FROM ranges_fx
        UNION ALL SELECT DISTINCT 'bijections', CAST(n_regionkey AS VARCHAR), 0, CAST(n_regionkey AS BIGINT), 'pins' || n_regionkey FROM nation""",
    "doc_object_counts": f"""WITH {UNITS}, {RANGES} SELECT u.doc_id, count(DISTINCT u.id) AS n_units, (SELECT count(*) FROM ranges_fx r WHERE r.doc_id = u.doc_id) AS n_ranges,
        (SELECT count(DISTINCT n_regionkey) FROM nation WHERE CAST(n_regionkey AS VARCHAR) = u.doc_id) AS n_bijections FROM units_fx u GROUP BY u.doc_id""",
    "project_doc_counts": "SELECT n_nationkey AS project_id, n_name AS name, count(c_custkey) AS doc_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    "project_documents": "SELECT c_nationkey AS project_id, CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS filename FROM customer",
    "project_links": """SELECT CAST(c_nationkey AS BIGINT) AS project_id, CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT (c_nationkey + 1) % 25, CAST(c_custkey AS VARCHAR) FROM customer""",
    "doc_delete_cascade": f"""WITH {UNITS}, {RANGES} SELECT kind, doc_id, count(*) AS n FROM (SELECT 'units' AS kind, doc_id FROM units_fx UNION ALL SELECT 'ranges', doc_id FROM ranges_fx)
        WHERE doc_id NOT IN (SELECT doc_id FROM units_fx WHERE CAST(doc_id AS INT) % 10 = 3) GROUP BY ALL""",
    "upsert_last_write_wins": """WITH s AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS write_seq FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
        w AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS write_seq FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
        SELECT * FROM w UNION ALL SELECT * FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM w)""",
    "first_match_unit": f"""WITH {UNITS} SELECT doc_id, arg_min(value, fact_ord) AS value, '°C/W' AS unit, arg_min(id, fact_ord) AS source_id, round(0.3 * 0.5 + 0.3 * 0.8 + 0.4 * 0.7, 4) AS score
        FROM units_fx WHERE contains(context, 'thermal resistance') GROUP BY doc_id""",
    "best_numeric_max": f"""WITH {UNITS} SELECT doc_id, value, uom AS unit, id AS source_id, 0.67 AS score FROM units_fx WHERE uom IN ('V', 'mV')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, fact_ord) = 1""",
    "best_numeric_min": f"""WITH {UNITS} SELECT doc_id, value, uom AS unit, id AS source_id, 0.67 AS score FROM units_fx WHERE uom IN ('V', 'mV')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY value, fact_ord) = 1""",
    "range_assembly": f"""WITH {UNITS}, s AS (SELECT *, CASE WHEN label = 'ICC' THEN 2 ELSE 1 END AS stage FROM units_fx WHERE label IN ('VCC', 'VCC max', 'ICC')),
        f AS (SELECT * FROM s QUALIFY stage = min(stage) OVER (PARTITION BY doc_id)) SELECT doc_id, CASE WHEN count(*) > 1 THEN 'range' ELSE 'value' END AS shape, min(value) AS low, CASE WHEN count(*) > 1 THEN max(value) END AS high, arg_min(uom, (value, fact_ord)) AS unit, arg_min(id, (value, fact_ord)) AS source_id
        FROM f GROUP BY doc_id""",
    "multi_value_concat": f"""WITH {UNITS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fact_ord) AS n FROM units_fx WHERE uom IN ('V', 'mV'))
        SELECT doc_id, CASE WHEN count(*) > 1 THEN 'several' ELSE 'value' END AS shape, string_agg(label || ':' || CAST(round(value * 100) AS BIGINT) || uom, ';' ORDER BY n) AS shown, arg_min(id, n) AS source_id FROM n WHERE n <= 4 GROUP BY doc_id""",
    "keyword_overlap_score": f"WITH {UNITS} SELECT fact_ord, CAST({' + '.join(f'CAST(contains(lower(label || chr(32) || context), {quoted(w)}) AS INT)' for w in OVERLAP)} AS INT) AS overlap FROM units_fx",
    "intent_classify": rule_sql.INTENTS,
    "rule_gate_matrix": rule_sql.GATES,
    "unit_by_intent": f"WITH {UNITS} SELECT CAST(doc_id AS BIGINT) AS q_id, arg_min(value, fact_ord) AS value, 'MHz' AS unit, arg_min(id, fact_ord) AS source_id FROM units_fx WHERE uom = 'MHz' GROUP BY ALL",
    "grid_header_lookup": f"""WITH {GRIDS} SELECT doc_id, arg_min(value, (s_nationkey, r)) AS value, arg_min(id, (s_nationkey, r)) AS source_id, arg_min(page, (s_nationkey, r)) AS page FROM cells_fx
        WHERE contains(header, '7') OR contains(header, '9') GROUP BY doc_id""",
    "grid_cell_lookup": f"""WITH {GRIDS} SELECT CAST(doc_id AS BIGINT) AS q_id, arg_min(value, (header <> 'supplier#000000042', s_nationkey, r)) AS value, arg_min(id, (header <> 'supplier#000000042', s_nationkey, r)) AS source_id
        FROM cells_fx WHERE n_rows >= 2 GROUP BY doc_id""",
    "pin_lookup": "SELECT CAST(n_nationkey AS BIGINT) AS q_id, n_name AS answer, 'pins' || n_regionkey AS source_id, 'bijection' AS source_type FROM nation",
    "pin_inverse_lookup": "SELECT CAST(n_nationkey AS BIGINT) AS q_id, n_name AS answer, 'pins' || n_regionkey AS source_id, 'bijection' AS source_type FROM nation",
    "pin_count": "SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(count(*) AS INT) AS n_pins, 'pins' || n_regionkey AS source_id FROM nation GROUP BY n_regionkey",
    "unit_label_lookup": f"WITH {UNITS} SELECT CAST(doc_id AS BIGINT) AS q_id, arg_min(value, fact_ord) AS value, arg_min(id, fact_ord) AS source_id FROM units_fx WHERE label = 'RthJA' OR context = 'output current' GROUP BY ALL",
    "derived_power": f"""WITH {DERIVED}, c AS (SELECT doc_id, CASE v.uom WHEN 'mV' THEN v.value / 1000.0 ELSE v.value END * (i.value / 1000.0) AS w FROM d WHERE v IS NOT NULL AND i IS NOT NULL)
        SELECT doc_id, round(w * 1000.0, 3) AS value, 'mW' AS unit, round(w, 3) AS second, 0.73 AS score FROM c""",
    "derived_thermal": f"""WITH {DERIVED}, w AS (SELECT *, coalesce(p.value / 1000.0, CASE v.uom WHEN 'mV' THEN v.value / 1000.0 ELSE v.value END * (i.value / 1000.0)) AS watts FROM d),
        c AS (SELECT doc_id, 25.0 + watts * th.value AS t, tj.value AS m FROM w WHERE th IS NOT NULL AND watts IS NOT NULL)
        SELECT doc_id, round(t, 3) AS value, '°C' AS unit, round(m - t, 3) AS second, 0.68 AS score FROM c""",
    "derived_margin": f"""WITH {DERIVED} SELECT doc_id, round((mx.value - op.value) / mx.value * 100.0, 3) AS value, '%' AS unit, round(mx.value - op.value, 3) AS second, round(0.15 + 0.225 + 0.34, 4) AS score
        FROM d WHERE op.value <= mx.value AND mx.value <> 0""",
    "derived_budget": f"""WITH {DERIVED} SELECT doc_id, round(i.value - (CASE WHEN n_out > 0 THEN ma + a * 1000.0 ELSE 0 END), 3) AS value, 'mA' AS unit, round(CASE WHEN n_out > 0 THEN ma + a * 1000.0 END, 3) AS second, 0.68 AS score
        FROM d WHERE i IS NOT NULL""",
    "canonical_quality": f"WITH {UNITS} SELECT fact_ord, 0.8 AS quality FROM units_fx",
    "confidence_tier": """WITH c AS (SELECT o_orderkey, round(0.3 * ((o_orderkey % 11) / 10.0) + 0.3 * ((o_custkey % 11) / 10.0) + 0.4 * 0.7, 4) AS score FROM orders)
        SELECT o_orderkey, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'verified' WHEN score >= 0.5 THEN 'review' ELSE 'refused' END AS tier FROM c""",
    "unit_to_base": f"WITH {BASE} SELECT fact_ord, round(base, 6) AS base_value, base_unit FROM base_fx",
    "contradictions": f"WITH {CONTRADICTIONS} SELECT doc_id, 'contradiction' AS check_type, 'error' AS severity, key, round(ref, 6) AS value_a, round(base, 6) AS value_b FROM contradiction",
    "range_consistency": f"WITH {RANGES} SELECT doc_id, label AS key, count(*) AS n, round(sum(lo), 4) AS sum_min, round(sum(hi), 4) AS sum_max FROM ranges_fx WHERE lo > typ OR typ > hi OR lo > hi GROUP BY ALL",
    "power_constraint": f"""WITH {BASE}, m AS (SELECT doc_id, max(base / 1000) FILTER (base_unit = 'V') AS v, max(base / 1000) FILTER (base_unit = 'A') AS i, max(base / 1000) FILTER (base_unit = 'W') AS p FROM base_fx GROUP BY doc_id)
        SELECT doc_id, 'warning' AS severity, round(p, 6) AS rated, round(v * i, 6) AS needed FROM m WHERE p < v * i""",
    "thermal_viability": f"""WITH {BASE}, m AS (SELECT doc_id, arg_max(value, fact_ord) FILTER (label = 'RthJA') AS th, max(base) FILTER (label = 'PD') AS p, arg_max(value, fact_ord) FILTER (label = 'TJ max') AS tj FROM base_fx GROUP BY doc_id)
        SELECT doc_id, 'error' AS severity, round(25.0 + p * th, 3) AS junction, round(tj, 3) AS "limit" FROM m WHERE 25.0 + p * th > tj""",
    "dropout_margin": f"""WITH {BASE}, m AS (SELECT doc_id, arg_max(base, fact_ord) FILTER (fact_ord % 3 = 0) AS vin, arg_max(base, fact_ord) FILTER (fact_ord % 3 = 1) AS vout, arg_max(base, fact_ord) FILTER (fact_ord % 3 = 2) AS vdo
        FROM base_fx WHERE base_unit = 'V' GROUP BY doc_id) SELECT doc_id, 'warning' AS severity, round(vin - vout, 3) AS margin, round(vdo, 3) AS dropout FROM m WHERE vin - vout < vdo""",
    "issue_rollup": f"""WITH {BASE}, {RANGES},
        named AS (SELECT * REPLACE (CASE WHEN label = 'ICC' THEN 'maximum supply current' WHEN label = 'PD' THEN 'maximum power dissipation'
          WHEN label = 'VCC' THEN ['input voltage minimum', 'output voltage', 'dropout'][fact_ord % 3 + 1] ELSE context END AS context) FROM base_fx),
        keyed AS (SELECT *, lower(label) || '|' || CASE WHEN contains(context, 'minimum') THEN 'min' WHEN contains(context, 'maximum') THEN 'max' ELSE '' END AS key FROM named WHERE base IS NOT NULL),
        first_fx AS (SELECT *, first_value(base) OVER w AS ref, first_value(base_unit) OVER w AS ref_unit, row_number() OVER w AS n FROM keyed WINDOW w AS (PARTITION BY doc_id, key ORDER BY fact_ord)),
        m AS (SELECT doc_id, arg_max(value, fact_ord) FILTER (label = 'RthJA') AS th, max(base) FILTER (label = 'PD') AS p, arg_max(value, fact_ord) FILTER (label = 'TJ max') AS tj,
          max(base) FILTER (label = 'VCC max') AS v_max, max(base) FILTER (label = 'ICC') AS i_max,
          arg_max(base, fact_ord) FILTER (context = 'input voltage minimum') AS vin, arg_max(base, fact_ord) FILTER (context = 'output voltage') AS vout, arg_max(base, fact_ord) FILTER (context = 'dropout') AS vdo
          FROM named GROUP BY doc_id),
        exact AS (SELECT doc_id, base, CASE uom WHEN 'mV' THEN round(value * 100) / 100000.0 WHEN 'mA' THEN round(value * 100) / 100000.0 WHEN 'mW' THEN round(value * 100) / 100000.0
          WHEN 'MHz' THEN round(value * 100) * 10000.0 ELSE value END AS right_base FROM named WHERE base IS NOT NULL),
        i AS (SELECT doc_id, 'error' AS severity FROM first_fx WHERE n > 1 AND base_unit = ref_unit AND abs(base - ref) >= 1e-9
          UNION ALL SELECT doc_id, 'error' FROM ranges_fx WHERE lo > typ OR typ > hi OR lo > hi
          UNION ALL SELECT doc_id, 'error' FROM m WHERE 25.0 + p * th > tj
          UNION ALL SELECT doc_id, 'error' FROM exact WHERE base <> right_base
          UNION ALL SELECT doc_id, 'warning' FROM m WHERE p < v_max * i_max
          UNION ALL SELECT doc_id, 'warning' FROM m WHERE vin - vout < vdo)
        SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, 6 AS checks_run FROM i GROUP BY doc_id""",
    "compare_best": f"WITH {COMPARE} SELECT parameter, doc_id, value, unit, source_id, is_best FROM compared",
    "compare_pivot": f"""WITH {COMPARE} SELECT parameter, {", ".join(f"coalesce(CAST(CAST(round(max(value) FILTER (doc_id = '{i}') * 100) AS BIGINT) AS VARCHAR), 'N/A') AS doc_{i}" for i in range(97))} FROM compared GROUP BY parameter""",
    "param_detect": rule_sql.DETECTED,
    "measurements_of_facts": rule_sql.MEASUREMENT_TABLE,
    "rule_answers_all": rule_sql.RULE_ANSWERS,
    "dispatch_all": rule_sql.DISPATCH,
    "correction_stats": f"WITH {CORRECTIONS} SELECT count(*) AS total, count(*) FILTER (NOT correct) AS confirms, count(*) FILTER (correct) AS corrects, count(*) FILTER (NOT correct) / count(*) AS rate FROM corrections_fx",
    "unit_confusion": f"WITH {PATTERNS} SELECT * FROM patterns WHERE category = 'unit_confusion'",
    "value_scaling": f"WITH {PATTERNS} SELECT * FROM patterns WHERE category = 'value_scaling'",
    "label_misread": f"WITH {PATTERNS} SELECT * FROM patterns WHERE category = 'label_misread'",
    "type_bias": f"WITH {PATTERNS} SELECT * FROM patterns WHERE category = 'type_bias'",
    "auto_rules": f"WITH {PATTERNS} SELECT * FROM patterns WHERE auto_correctable",
    "pattern_stats": f"""WITH {PATTERNS} SELECT category, count(*) AS n_patterns, CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS n_corrections, count(*) FILTER (auto_correctable) AS n_auto, count(*) FILTER (occurrences >= 3) AS n_reliable
        FROM patterns GROUP BY ROLLUP (category)""",
    "patterns_of_days": f"WITH {PATTERNS} SELECT * FROM patterns",
    "top_patterns": f"WITH {PATTERNS} SELECT * FROM patterns ORDER BY occurrences DESC, category, original_pattern, corrected_pattern LIMIT 10",
    "suggest_correction": f"""WITH {CORRECTIONS},
        typed AS (SELECT CASE k WHEN 0 THEN 'mv' WHEN 3 THEN 'ma' END AS unit, CASE k WHEN 1 THEN '10x' WHEN 4 THEN '1000x' END AS factor, ctype FROM corrections_fx WHERE correct AND k <> 2),
        swaps AS (SELECT unit, count(*) AS n FROM typed WHERE unit IS NOT NULL GROUP BY unit HAVING count(*) >= 5),
        scales AS (SELECT factor, count(*) AS n FROM typed WHERE factor IS NOT NULL GROUP BY factor HAVING count(*) >= 5),
        best AS (SELECT t.ctype, arg_max(struct_pack(factor := s.factor, n := s.n), (s.n, s.factor = '1000x')) AS s FROM (SELECT DISTINCT factor, ctype FROM typed) t JOIN scales s USING (factor) GROUP BY t.ctype),
        v AS (SELECT id, ctype, k, CASE k WHEN 2 THEN 'therml resistance' WHEN 1 THEN 10 * n || ' V' WHEN 4 THEN 1000 * n || ' Hz' WHEN 0 THEN n || ' mV' ELSE n || ' mA' END AS value, n,
          CASE k WHEN 0 THEN 'mv' WHEN 3 THEN 'ma' END AS unit, CASE k WHEN 1 THEN 10 * n WHEN 4 THEN 1000 * n WHEN 2 THEN NULL ELSE n END AS x, CASE k WHEN 0 THEN 'mv' WHEN 1 THEN 'v' WHEN 3 THEN 'ma' WHEN 4 THEN 'hz' END AS own FROM corrections_fx),
        j AS (SELECT v.*, w.n AS swap_n, b.s.n AS scale_n, v.x / CASE b.s.factor WHEN '10x' THEN 10.0 ELSE 1000.0 END AS made
          FROM v LEFT JOIN (SELECT DISTINCT t.unit, t.ctype, s.n FROM typed t JOIN swaps s USING (unit)) w ON w.unit = v.unit AND w.ctype = v.ctype LEFT JOIN best b ON b.ctype = v.ctype)
        SELECT id, ctype AS canonical_type, value, CASE WHEN swap_n IS NOT NULL AND (scale_n IS NULL OR swap_n >= scale_n) THEN n || CASE unit WHEN 'mv' THEN ' v' ELSE ' a' END
          WHEN x IS NOT NULL AND scale_n IS NOT NULL THEN CASE WHEN made = floor(made) THEN CAST(CAST(made AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST(made AS DECIMAL(10, 4)) AS VARCHAR), '0') END || ' ' || own END AS suggestion FROM j""",
    "review_queue": f"""WITH {CORRECTIONS} SELECT DISTINCT 'u' || event_id % 200 AS canonical_id, ctype AS canonical_type FROM corrections_fx ORDER BY canonical_id, canonical_type LIMIT 50""",
    "usage_summary": """SELECT CAST(user_id AS VARCHAR) AS user_id, CASE event_type WHEN 'purchase' THEN 'document' ELSE 'query' END AS action, count(*) AS used,
        greatest(0, CASE WHEN any_value(event_type = 'purchase') THEN 5 ELSE 50 END - count(*)) AS remaining FROM events GROUP BY 1, 2""",
    "usage_limit": """SELECT CAST(user_id AS VARCHAR) AS user_id, CASE event_type WHEN 'purchase' THEN 'document' ELSE 'query' END AS action, count(*) AS used FROM events GROUP BY 1, 2
        HAVING count(*) >= CASE WHEN any_value(event_type = 'purchase') THEN 5 ELSE 50 END""",
    "audit_topk": "SELECT event_id AS id, CAST(user_id % 50 AS VARCHAR) AS doc_id, event_type AS action, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "audit_details": """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS "timestamp", CAST(user_id % 50 AS VARCHAR) AS doc_id, event_type AS action, CAST(user_id AS VARCHAR) AS actor,
        coalesce('k=' || json_extract_string(props, '$.k'), '') AS details FROM events""",
    "chat_page": "SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 10",
    "chat_next_page": "SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 40 OFFSET 15",
    "corpus_hash_match": f"""WITH {CORPUS}, m AS (SELECT lower(mpn) AS k, min(content_hash) AS h FROM corpus_fx GROUP BY 1)
        SELECT f.doc_id, CASE WHEN f.doc_id % 3 = 0 AND f.content_hash IS NOT NULL THEN f.content_hash ELSE m.h END AS corpus_hash,
          CASE WHEN f.doc_id % 3 = 0 AND f.content_hash IS NOT NULL THEN 'content' WHEN m.h IS NOT NULL THEN 'mpn' END AS matched_by
        FROM corpus_fx f LEFT JOIN m ON m.k = lower(f.mpn)""",
    "corpus_mpn_fallback": f"""WITH {CORPUS}, m AS (SELECT lower(mpn) AS k, 'x' || min(content_hash) AS h FROM corpus_fx GROUP BY 1)
        SELECT f.doc_id, m.h AS corpus_hash, CASE WHEN m.h IS NOT NULL THEN 'mpn' END AS matched_by FROM corpus_fx f LEFT JOIN m ON m.k = lower(f.mpn)""",
    "corpus_availability": "SELECT c AS chip_name, lower(c) IN (SELECT lower(source) FROM documents) AS available FROM (VALUES ('SRC1'), ('src7'), ('src99')) AS v(c)",
    "permalink_id": "SELECT doc_id, substr(sha256(concat(CAST(doc_id AS VARCHAR), ':', source, ':', text)), 1, 12) AS question_id FROM documents",
    "share_preview": "SELECT doc_id, substr(source || ': ' || text, 1, 100) AS question, substr(text, 1, 200) AS answer FROM documents",
    "share_upsert": """SELECT coalesce(o.c_custkey, n.c_custkey * 2) AS question_id, coalesce(o.c_name, 'new') AS doc_id, CASE WHEN o.c_custkey IS NULL THEN 'new' ELSE 'old' END AS question,
        CASE WHEN o.c_custkey IS NULL THEN 2 ELSE 1 END AS source_page, coalesce(n.c_mktsegment, 'first') AS answer FROM customer o FULL JOIN customer n ON o.c_custkey = n.c_custkey * 2""",
    "doc_id_valid": "SELECT p_partkey, regexp_full_match(p_type, '[a-zA-Z0-9_-]+') AS type_ok, regexp_full_match(p_name, '[a-zA-Z0-9_-]+') AS name_ok FROM part",
    "page_types": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'absolute_max_ratings' WHEN p_size > 10 THEN 'text_description' ELSE 'other' END AS kind, p_size > 25 AS twice FROM part",
    "multipage_candidates": f"WITH {GRIDS} SELECT doc_id, id_a, id_b, round(similarity, 4) AS similarity, similarity < 0.8 AS needs_review FROM pairs_fx",
    "header_jaccard": """WITH w AS (SELECT p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct(list_append(string_split(p_name, ' '), string_split(p_type, ' ')[1])) AS b FROM part)
        SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w""",
    "multipage_merge": f"""WITH RECURSIVE {GRIDS},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, 0.06 * (a_key % 5), a_key, 0.06 * (b_key % 5), b_key) AS n FROM pairs_fx),
        run(doc_id, n, used, merged) AS (
          SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM pairs_fx
          UNION ALL SELECT r.doc_id, r.n + 1, CASE WHEN list_contains(used, a_key) OR list_contains(used, b_key) THEN used ELSE used || [CAST(a_key AS BIGINT), CAST(b_key AS BIGINT)] END, CASE WHEN list_contains(used, a_key) OR list_contains(used, b_key) THEN merged ELSE merged || [p.n] END
          FROM run r JOIN ranked p ON p.doc_id = r.doc_id AND p.n = r.n + 1),
        done AS (SELECT doc_id, arg_max(used, n) AS used, arg_max(merged, n) AS merged FROM run GROUP BY doc_id)
        SELECT g.doc_id, g.id, g.page, CAST(g.n_rows AS INT) AS rows, 2 AS cols, CAST(2 * g.n_rows AS INT) AS n_cells FROM grids_fx g LEFT JOIN done d USING (doc_id) WHERE NOT coalesce(list_contains(d.used, g.s_nationkey), false)
        UNION ALL SELECT p.doc_id, p.id_a || '_merged_' || p.id_b, p.page, CAST(a.n_rows + b.n_rows AS INT), 2, CAST(2 * (a.n_rows + b.n_rows) AS INT)
        FROM ranked p JOIN done d ON d.doc_id = p.doc_id AND list_contains(d.merged, p.n) JOIN grids_fx a ON a.s_nationkey = p.a_key JOIN grids_fx b ON b.s_nationkey = p.b_key""",
    "consensus_agreement": f"""WITH {CONSENSUS},
        others AS (
          SELECT doc_id, page, sum(lo) / sum(hi) AS agreement FROM (
            SELECT CAST(s_nationkey % 5 AS VARCHAR) AS doc_id, CAST(s_nationkey // 5 AS INT) + 5 AS page, count(DISTINCT s_nationkey) AS lo, count(DISTINCT s_nationkey) AS hi FROM supplier GROUP BY 1, 2
            UNION ALL SELECT DISTINCT CAST(n_regionkey AS VARCHAR), 9, 0, 1 FROM nation) GROUP BY ALL)
        SELECT doc_id, page, round(least(1.0::DOUBLE, total / n), 6) AS agreement FROM run WHERE i = n
        UNION ALL SELECT doc_id, page, round(CAST(agreement AS DOUBLE), 6) FROM others o WHERE NOT EXISTS (SELECT 1 FROM sizes z WHERE z.doc_id = o.doc_id AND z.page = o.page)""",
    "benchmark_metrics": f"WITH {RESULTS} SELECT chip, {FIGURES} FROM results_fx GROUP BY chip",
    "benchmark_gate": f"WITH {RESULTS}, f AS (SELECT {FIGURES} FROM results_fx) SELECT *, accuracy >= 70 AND false_refuse_rate <= 30 AND false_accept_rate <= 1 AS passed FROM f",
    "confusion_matrix": f"""WITH {RESULTS} SELECT correct, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'refused') AS refused,
        CAST(0 AS BIGINT) AS error FROM results_fx GROUP BY correct""",
    "answers_match": "SELECT o_orderkey, ends_with('about ' || o_orderkey % 50 || ' mV', o_custkey % 50 || ' mV') AS same FROM orders",
    "values_match": "SELECT o_orderkey, contains(CAST(o_orderkey % 50 AS VARCHAR), CAST(o_custkey % 50 AS VARCHAR)) OR o_custkey % 50 = o_orderkey % 50 OR (o_custkey % 50 <> 0 AND abs(o_custkey % 50 - o_orderkey % 50) <= 0.1 * (o_custkey % 50)) AS same FROM orders",
    "events_by_window": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
for _kind, (_a, _b) in MEASURED.items():
    ORACLE_SQL[f"parse_measurements_{_kind}"] = (
        f"SELECT o_orderkey, 2 AS n, o_orderkey % 1000 + CAST(0.5 AS DOUBLE) AS value_1, '{_a}' AS unit_1, CAST(o_custkey % 77 AS DOUBLE) AS value_2, '{_b}' AS unit_2 FROM orders"
    )
