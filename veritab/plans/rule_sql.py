"""Questions against facts in DuckDB's SQL, written apart from the Spark plans: its own values, its own statements.

The values are those of the rules, the classes of questions, the derivations and the
comparison; they are written down here a second time, so that a slip in the library's
tables shows as a difference.
"""

from __future__ import annotations

from veritab.plans.adapters import QUESTIONS, SPEC_FACTS

# Fixed values: (priority, name, family, kind, units, default unit, most, facts' keywords, groups of the question's keywords).
VOLT, AMP, TIMES = "V mV kV", "A mA µA", "ns µs ps ms"
RULES = [
    (150, "part_number", "first", None, None, "", 4, "part number|ordering|order code|mpn|part no", ["part number|ordering|order code|mpn|part no"]),
    (160, "description", "first", None, None, "", 4, "description|function|overview|general description|features", ["what does this do|what does this component do|description|what is this component|what is this device|overview"]),
    (200, "absolute_max_voltage", "best", "voltage", VOLT, "", 4, "absolute maximum|absolute max|abs max", ["absolute max|absolute maximum", "voltage| v "]),
    (210, "absolute_max_current", "best", "current", AMP, "", 4, "absolute maximum|absolute max|abs max", ["absolute max|absolute maximum", "current| a |amper"]),
    (300, "max_voltage", "best", "voltage", "V VOLT VOLTS MV KV", "", 4, "voltage|vcc|vdd|supply", ["max|maximum", "voltage| v | v"]),
    (310, "max_current", "best", "current", "A MA µA", "", 4, "current|supply current|icc", ["max|maximum", "current| a |amper"]),
    (320, "max_capacity", "best", "capacity", "MAH AH WH", "", 4, "capacity|nominal capacity", ["max|maximum|nominal", "capacity|mah| ah | wh "]),
    (400, "operating_voltage_range", "range", "voltage", VOLT, "V", 4, "operating|supply|vcc|vdd|input voltage", ["operating voltage|supply voltage|vcc range|vdd range|input voltage range"]),
    (405, "storage_temperature", "first", None, None, "", 4, "storage temperature|storage temp|tstg|storage", ["storage temp|storage temperature"]),
    (410, "operating_temperature_range", "range", "temperature", "°C ℃ °F K", "°C", 4, "operating temperature|junction temperature|ambient temperature|operating temp", ["operating temp|junction temp|temperature range|ambient temp"]),
    (430, "soldering_temperature", "first", None, None, "", 4, "solder|reflow|soldering|reflow temperature", ["solder|reflow|soldering temperature|reflow temperature"]),
    (500, "power_dissipation", "best", "power", "W mW", "", 4, "power dissipation|power rating|power consumption|total power", ["power dissipation|max power|power rating|power consumption"]),
    (510, "esd_ratings", "several", None, None, "", 4, "esd|electrostatic|hbm|cdm", ["esd|electrostatic|esd rating"]),
    (520, "leakage_current", "first", None, "A mA µA nA", "", 4, "leakage|ileak|input leakage", ["leakage current|input leakage|ileak"]),
    (530, "threshold_voltage", "several", None, "V mV", "", 4, "threshold|vil|vih|vol|voh|logic level|input low|input high", ["threshold|vil|vih|vol|voh|logic level"]),
    (600, "clock_frequency", "best", "frequency", "Hz kHz MHz GHz", "", 4, "clock|frequency|bandwidth|fmax|speed|data rate|oscillator", ["clock|frequency|bandwidth|fmax|speed|data rate"]),
    (610, "propagation_delay", "first", None, TIMES, "", 4, "propagation delay|propagation|tpd|delay time|tphl|tplh", ["propagation delay|tpd|delay time"]),
    (620, "rise_fall_time", "several", None, "ns µs ps V/µs V/ns", "", 4, "rise time|fall time|slew rate|slew|tr/tf|rise/fall", ["rise time|fall time| tr | tf |slew rate|rise/fall"]),
    (630, "setup_hold_time", "several", None, TIMES, "", 4, "setup time|hold time|tsu|setup/hold|setup and hold", ["setup time|hold time|tsu| th |setup/hold|setup and hold"]),
    (700, "package_type", "first", None, None, "", 4, "package|footprint|case|package type", ["package|footprint|case"]),
    (710, "package_dimensions", "several", None, "mm mil in cm", "", 6, "dimension|package size|length|width|height|body size", ["dimension|package size|length|width|height|package dimension"]),
    (720, "thermal_resistance", "first", None, "°C/W K/W", "", 4, "thermal resistance|θja|theta|junction to ambient|junction-to-ambient|θjc|rθja", ["thermal resistance|θja|theta-ja|rθja|θjc|junction to ambient|junction-to-ambient"]),
    (730, "weight", "first", None, "g mg kg oz", "", 4, "weight|mass", ["weight|mass"]),
    (740, "pin_count", "first", None, None, "", 4, "pin count|number of pins|total pins", ["pin count|how many pins|number of pins|total pins"]),
    (750, "moisture_sensitivity", "first", None, None, "", 4, "moisture sensitivity|msl", ["moisture sensitivity|msl|msl rating"]),
    (800, "recommended_operating", "several", None, None, "", 6, "recommended operating|recommended conditions", ["recommended operating|recommended conditions"]),
]
# Classes of questions in order, their patterns and the rules that they let through.
OUT_OF_SCOPE = r"\b(weather|stock|price|news|who is|where is|when did)\b|\b(recipe|movie|song|book|game)\b"
SPEC = r"\b(what is|what's|what are|how much|how many|value of|rating|spec|specification|limit)\b"
DESIGN = r"\b(design|circuit|schematic|calculate|divider|network|resistor network|how do i|how to|recommend|choose|select|compare|versus|vs\.?|between)\b"
CLASSES = [
    ("pin_lookup", r"\bpin\s+(?:\d+|number|#|no\.?)\b|\bwhat\s+is\s+pin\s+\d+\b|\bpin(?:out|assignment|description|function)\b|\bfunction\s+of\s+pin\b", "pin_lookup pin_count"),
    ("package_query", r"\bpackage\s+(?:type|size|dimensions?|footprint)\b|\b(?:soic|qfp|qfn|bga|dip|sot|tssop|lqfp|dfn)\b|\bpin\s+count\b|\b(?:how\s+many|number\s+of)\s+pins\b|\bfootprint\b|\bdimensions?\b|\bweight\b|\bmsl\b|\bmoisture\s+sensitivity\b", "package_type package_dimensions weight pin_count moisture_sensitivity"),
    ("thermal_query", r"\bthermal\s+(?:resistance|impedance)\b|\b[rθ](?:ja|jc|ca)\b|\bjunction[\s-]to[\s-](?:ambient|case)\b|\bθ(?:ja|jc)\b|\bthermal\s+(?:pad|via|management)\b", "thermal_resistance"),
    ("voltage_spec", r"\b(max(?:imum)?|min(?:imum)?|operating|supply|input|output)\s+voltage\b|\bv(?:cc|dd|in|out|oh|ol|ih|il|bat|bus|ref|ss)\b|\babsolute\s+max(?:imum)?\s+(?:rating)?\s*.*voltage\b|\bvoltage\s+(?:range|limit|rating|spec)\b", "absolute_max_voltage max_voltage operating_voltage_range threshold_voltage"),
    ("current_spec", r"\b(max(?:imum)?|min(?:imum)?|operating|supply|input|output)\s+current\b|\bi(?:cc|dd|oh|ol|in|out|q|leak|standby|sleep)\b|\bcurrent\s+(?:consumption|draw|limit|rating|spec)\b|\bleakage\s+current\b", "absolute_max_current max_current leakage_current"),
    ("power_spec", r"\bpower\s+(?:dissipation|consumption|rating|limit)\b|\b(?:max(?:imum)?|total)\s+power\b|\bp(?:d|tot|max)\b|\b(?:milliwatts?|watts?|mw|w)\s+(?:rating|dissipation)\b", "power_dissipation"),
    ("temperature_spec", r"\b(operating|storage|junction|ambient)\s+temp(?:erature)?\b|\bt(?:j|a|op|stg|amb)(?:_max|_min)?\b|\btemp(?:erature)?\s+(?:range|limit|rating)\b|\bsoldering?\s+temp(?:erature)?\b|\breflow\b", "storage_temperature operating_temperature_range soldering_temperature"),
    ("timing_spec", r"\b(propagation|rise|fall|setup|hold)\s+(?:time|delay)\b|\bt(?:pd|r|f|su|h|phl|plh)\b|\bslew\s+rate\b|\bdelay\s+time\b", "propagation_delay rise_fall_time setup_hold_time"),
    ("frequency_spec", r"\b(clock|operating|max(?:imum)?)\s+frequency\b|\bf(?:max|clk|osc)\b|\bbandwidth\b|\bdata\s+rate\b|\b(?:mhz|ghz|khz)\b", "clock_frequency"),
]
PLAIN = 3  # the first classes need no word of a specification
# Topics of rule 900 (question keywords, units in capitals, kind), stop words, parameters of comparisons.
TOPICS = [
    ("voltage|volt| v |charge voltage|cutoff voltage", "V VOLT VOLTS MV KV", "voltage"),
    ("current|amper| a |discharge current|charge current", "A MA µA", "current"),
    ("capacity|mah| ah | wh |nominal capacity", "MAH AH WH", "capacity"),
    ("power|watt| w ", "W MW", "power"),
    ("temperature|temp|°c|℃", "°C ℃ °F K", "temperature"),
    ("frequency|clock|speed|hz", "HZ KHZ MHZ GHZ", "frequency"),
    ("resistance|ohm|impedance| ω ", "Ω OHM OHMS KΩ MΩ", None),
]
STOP = "what is the of this document a an are for in on at to and or it its how does do that which with from can has have be was many much"
PARAMETERS = [
    ("max_voltage", 1, "maximum voltage|max voltage|absolute max", "vmax|vcc max|absolute max", "v", "max voltage|maximum voltage|absolute max"),
    ("supply_voltage", 0, "supply voltage|operating voltage", "vcc|vdd", "v", "supply voltage|operating voltage|vcc|vdd"),
    ("thermal_resistance", 1, "thermal resistance|theta|θja|junction to ambient", "θja|rthja", "°c/w c/w k/w", "thermal resistance|θja|theta|rthja"),
    ("max_current", 1, "maximum current|max current", "imax|icc max", "a ma", "max current|maximum current"),
    ("operating_temperature", -1, "operating temperature|temperature range", "topr|ta", "°c c", "operating temp|temperature range|85°c|85c"),
    ("power_dissipation", 1, "power dissipation|max power", "pd|ptot", "w mw", "power dissipation|power consumption"),
]
# Facts that derivations need, and what asks for them.
LOOKUPS = {
    "volt": ("supply voltage|operating voltage|vcc|vdd", "vcc|vdd|supply", "v mv"),
    "amp": ("supply current|operating current|icc|idd", "icc|idd|supply current", "a ma ua"),
    "theta": ("thermal resistance|theta|θja|junction to ambient", "θja|theta|rthja|thermal", "°c/w c/w k/w"),
    "watt": ("power dissipation|total power", "pd|power", "w mw"),
    "tj_max": ("maximum junction temperature|junction temp", "tj max|tjmax", "°c c"),
    "volt_near": ("supply voltage|vcc", "vcc|vdd", "v mv"),
    "amp_near": ("supply current|icc", "icc|idd", "a ma"),
    "v_op": ("supply voltage|operating voltage|typical supply", "vcc|vdd|supply", "v"),
    "v_abs": ("absolute maximum voltage|absolute max voltage", "absolute max|vcc max|abs max", "v"),
    "v_top": ("maximum voltage|max voltage", "vcc max|vmax", "v"),
    "supply": ("supply current|total current|icc max|maximum supply", "icc|idd|supply current", "a ma"),
}
OUTPUTS = ("output current|pin current|io", "io|iout|output", "a ma")
TRIGGERS = [
    ("power", r"(power\s+dissipat|calculate.*power|compute.*power|what.*power|p\s*=\s*v\s*[×x*]\s*i)"),
    ("thermal", r"(thermal\s+check|junction\s+temp.*safe|within.*thermal|t_?junction|calculate.*temperature|thermal\s+margin)"),
    ("margin", r"(voltage\s+margin|how\s+close.*abs.*max|margin.*voltage|voltage.*headroom|operating.*vs.*max)"),
    ("budget", r"(current\s+budget|total.*current|sum.*current|current.*sum)"),
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def some(column: str, words: str) -> str:
    """Whether any of the words, divided by bars, is in the column."""
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words.split("|")) + ")"


def listed(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else quoted(v) for v in values) + "]"


def among(column: str, units: str) -> str:
    return f"{column} IN ({', '.join(map(quoted, units.split()))})"


def chosen(at: int) -> str:
    return f"{listed([f[at] for f in SPEC_FACTS])}[k + 1]"


QUESTION_ROWS = f"""raw_questions AS (
  SELECT p_partkey AS q_id, CAST(p_partkey % 97 AS VARCHAR) AS doc_id,
    {listed(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' (' || p_name || ')' END AS question
  FROM part)"""


def intents() -> str:
    match = lambda pattern: f"regexp_matches(question, {quoted('(?i)' + pattern)})"
    cases = [f"WHEN {match(OUT_OF_SCOPE)} THEN 'out_of_scope'"]
    for i, (name, pattern, _) in enumerate(CLASSES):
        also = "" if i < PLAIN else f"({match(SPEC)} OR NOT {match(DESIGN)}) AND "
        cases.append(f"WHEN {also}{match(pattern)} THEN '{name}'")
    return f"{QUESTION_ROWS},\nquestions_fx AS (SELECT q_id, doc_id, question, trim(lower(question)) AS q, CASE {' '.join(cases)} ELSE 'general_question' END AS intent FROM raw_questions)"


def allowed(name: str) -> str:
    own = [c for c, _, rules in CLASSES if name in rules.split()]
    return f"intent IN ({', '.join(map(quoted, [*own, 'general_question']))})" if own else "intent <> 'out_of_scope'"


def gates() -> str:
    """(q_id, doc_id, priority) of the rules that a question may use."""
    parts = [f"SELECT q_id, doc_id, 100 AS priority FROM questions_fx WHERE regexp_matches(q, 'pin\\s+(number\\s+)?[0-9]+') AND {allowed('pin_lookup')}"]
    for priority, name, *_, asked in RULES:
        wants = " AND ".join(some("q", g) for g in asked)
        if name == "description":
            wants = f"({wants} OR (contains(q, 'what is this') AND NOT {some('q', 'pin|voltage|current|temperature')}))"
        parts.append(f"SELECT q_id, doc_id, {priority} FROM questions_fx WHERE {wants} AND {allowed(name)}")
    return "gates_fx AS (" + " UNION ALL ".join(parts) + ")"


#: Facts of every rule; ``readings``: the measurements in a text, which its making tells.
FACTS = f"""spec_raw AS (SELECT o_orderkey % {len(SPEC_FACTS)} AS k, CAST(o_custkey % 50 AS VARCHAR) AS n, o_totalprice AS price, o_orderkey AS fact_ord, o_custkey FROM orders),
spec_fx AS (
  SELECT 's' || fact_ord AS id, CAST(o_custkey % 97 AS VARCHAR) AS doc_id, fact_ord, CAST(fact_ord % 7 AS INT) AS page, (fact_ord % 10) / 10.0 AS x, (fact_ord % 9) / 10.0 AS y, k, n,
    {chosen(0)} AS label, {chosen(1)} AS context, {chosen(2)} AS unit, lower({chosen(0)}) AS lbl, lower({chosen(1)}) AS ctx, upper(coalesce({chosen(2)}, '')) AS uom,
    replace({chosen(3)}, '#', n) AS value_str, CASE WHEN {chosen(3)} IS NULL THEN price END AS value_num,
    coalesce(CASE WHEN {chosen(3)} IS NULL THEN price END, CASE WHEN regexp_matches({chosen(3)}, '^[0-9]+$') THEN CAST({chosen(3)} AS DOUBLE) END) AS value
  FROM spec_raw),
reading_fx AS (
  SELECT fact_ord, r[1] AS cand, r[2] AS kind, CAST(replace(r[3], '#', n) AS DOUBLE) AS v, r[4] AS unit
  FROM (SELECT fact_ord, n, unnest(str_split({listed(['' if f[4] is None else f[4] for f in SPEC_FACTS])}[k + 1], ';')) AS r0 FROM spec_raw), LATERAL (SELECT str_split(r0, ' ') AS r) WHERE r0 <> '')"""


def rule_rows() -> str:
    """The rules, their facts' keywords, and which of both meet: hit and fit."""
    rows = ", ".join(f"({p}, '{family}', {quoted(kind) if kind else 'NULL'}, {'NULL' if units is None else listed([u for u in units.split()])}, {quoted(default)}, {most})" for p, _, family, kind, units, default, most, _, _ in RULES)
    hits = " UNION ALL ".join(f"SELECT {p} AS priority, k FROM names_fx WHERE ({some('ctx', words)} OR {some('lbl', words)})" + (" AND (contains(ctx, 'storage') OR contains(lbl, 'tstg') OR contains(lbl, 'storage'))" if name == "storage_temperature" else "") for p, name, _, _, _, _, _, words, _ in RULES)
    return f"""rules_fx(priority, family, kind, units, default_unit, most) AS (VALUES {rows}),
names_fx AS (SELECT DISTINCT k, ctx, lbl FROM spec_fx),
hits_fx AS ({hits}),
met_fx AS (
  SELECT f.*, r.priority, r.family, r.kind, r.default_unit, r.most, h.k IS NOT NULL AS hit, r.units IS NULL OR list_contains(list_transform(r.units, lambda u: upper(u)), f.uom) AS fit
  FROM spec_fx f CROSS JOIN rules_fx r LEFT JOIN hits_fx h ON h.priority = r.priority AND h.k = f.k)"""


ANSWERS = f"""{rule_rows()},
values_fx AS (
  SELECT doc_id, priority, family, default_unit, fact_ord, 0 AS cand, value AS v, NULL AS unit_read, CASE WHEN fit THEN 1 ELSE 2 END AS stage FROM met_fx m
  WHERE hit AND (family = 'several' OR family = 'first' AND fit OR family = 'range' AND NOT (value IS NULL AND EXISTS (SELECT 1 FROM reading_fx r WHERE r.fact_ord = m.fact_ord AND r.kind = m.kind)))
  UNION ALL SELECT doc_id, priority, family, default_unit, fact_ord, 0, value, NULL, CASE WHEN hit THEN 1 ELSE 2 END FROM met_fx WHERE family = 'best' AND fit AND uom <> '' AND value IS NOT NULL
  UNION ALL SELECT m.doc_id, m.priority, family, default_unit, m.fact_ord, CAST(r.cand AS INT), r.v, r.unit, CASE WHEN hit AND fit THEN 1 ELSE 2 END FROM met_fx m JOIN reading_fx r ON r.fact_ord = m.fact_ord AND r.kind = m.kind WHERE family = 'best'
  UNION ALL SELECT m.doc_id, m.priority, family, default_unit, m.fact_ord, CAST(r.cand AS INT), r.v, r.unit, CASE WHEN fit THEN 1 ELSE 2 END FROM met_fx m JOIN reading_fx r ON r.fact_ord = m.fact_ord AND r.kind = m.kind WHERE family = 'range' AND hit AND value IS NULL),
staged_fx AS (SELECT *, min(stage) OVER (PARTITION BY doc_id, priority) AS best_stage FROM values_fx WHERE family <> 'several'),
single_fx AS (
  SELECT doc_id, priority, family, default_unit, count(v) AS n, min(fact_ord) AS first_ord, max(fact_ord) AS last_ord,
    arg_min(struct_pack(fact_ord := fact_ord, cand := cand, v := v, unit_read := unit_read), (CASE WHEN family = 'best' THEN -v ELSE 0 END, fact_ord, cand)) AS f,
    arg_min(struct_pack(fact_ord := fact_ord, v := v), (v, fact_ord, cand)) FILTER (v IS NOT NULL) AS lo, arg_max(struct_pack(fact_ord := fact_ord, v := v), (v, fact_ord, cand)) FILTER (v IS NOT NULL) AS hi
  FROM staged_fx WHERE stage = best_stage GROUP BY ALL),
placed_fx AS (SELECT *, family = 'range' AND n >= 2 AND first_ord < last_ord AS two FROM single_fx),
single_answers AS (
  SELECT p.doc_id, p.priority, CASE WHEN two THEN 'range' ELSE 'value' END AS shape, a.id AS source_id, a.page,
    CASE WHEN two THEN a.id || ',' || b.id ELSE a.id END AS proof_ids, CASE WHEN two THEN 2 ELSE 1 END AS n_proofs,
    CASE WHEN two THEN lo.v WHEN family = 'best' AND f.cand > 0 THEN f.v ELSE a.value_num END AS first_num, CASE WHEN two THEN hi.v WHEN family = 'best' AND f.cand > 0 THEN f.v ELSE a.value_num END AS last_num,
    CASE WHEN two THEN coalesce(a.unit, b.unit, default_unit) WHEN family = 'best' AND f.cand > 0 THEN f.unit_read ELSE a.unit END AS unit
  FROM placed_fx p JOIN spec_fx a ON a.fact_ord = CASE WHEN two THEN lo.fact_ord ELSE f.fact_ord END JOIN spec_fx b ON b.fact_ord = CASE WHEN two THEN hi.fact_ord ELSE f.fact_ord END),
several_fx AS (
  SELECT v.doc_id, v.priority, r.most, v.stage, f.*, row_number() OVER (PARTITION BY v.doc_id, v.priority ORDER BY v.stage, v.fact_ord) AS nth, min(v.stage) OVER (PARTITION BY v.doc_id, v.priority) AS best_stage
  FROM values_fx v JOIN rules_fx r USING (priority) JOIN (SELECT fact_ord AS ord, id, page, value_num, unit FROM spec_fx) f ON f.ord = v.fact_ord WHERE v.family = 'several'),
several_answers AS (
  SELECT doc_id, priority, CASE WHEN count(*) > 1 OR priority = 800 THEN 'several' ELSE 'value' END AS shape, arg_min(id, nth) AS source_id, arg_min(page, nth) AS page,
    string_agg(id, ',' ORDER BY nth) AS proof_ids, CAST(count(*) AS INT) AS n_proofs, arg_min(struct_pack(x := value_num), nth).x AS first_num, arg_max(struct_pack(x := value_num), nth).x AS last_num, arg_min(struct_pack(x := unit), nth).x AS unit
  FROM several_fx WHERE nth <= most AND stage = best_stage GROUP BY doc_id, priority),
answers_fx AS (SELECT * FROM single_answers UNION ALL SELECT * FROM several_answers)"""

RULE_ANSWERS = f"WITH {FACTS},\n{ANSWERS}\nSELECT doc_id, priority, shape, source_id, page, proof_ids, n_proofs, first_num, last_num, unit FROM answers_fx"
MEASUREMENT_TABLE = f"WITH {FACTS} SELECT doc_id, fact_ord, CAST(cand AS INT) AS cand, kind, v AS value, r.unit FROM reading_fx r JOIN spec_fx USING (fact_ord)"


def lookup(name: str, how: tuple[str, str, str]) -> str:
    hit = f"({some('ctx', how[0])} OR {some('lbl', how[1])}) AND {among('low', how[2])}"
    return f"arg_min(struct_pack(value := value, unit := unit, id := id, page := page), fact_ord) FILTER (WHERE {hit}) AS {name}"


OUTPUT = f"({some('ctx', OUTPUTS[0])} OR {some('lbl', OUTPUTS[1])}) AND {among('low', OUTPUTS[2])}"
DERIVED = f"""looked_fx AS (
  SELECT doc_id, {", ".join(lookup(n, how) for n, how in LOOKUPS.items())}, count(*) FILTER (WHERE {OUTPUT}) AS n_out
  FROM (SELECT *, lower(coalesce(unit, '')) AS low FROM spec_fx WHERE value IS NOT NULL) GROUP BY doc_id),
power_fx AS (
  SELECT *, coalesce(CASE WHEN lower(watt.unit) = 'mw' THEN watt.value / 1000 ELSE watt.value END,
      (CASE lower(volt_near.unit) WHEN 'mv' THEN volt_near.value / 1000 ELSE volt_near.value END) * (CASE lower(amp_near.unit) WHEN 'ma' THEN amp_near.value / 1000 ELSE amp_near.value END)) AS watts,
    coalesce(v_abs, v_top) AS v_max FROM looked_fx),
derived_fx AS (
  SELECT doc_id, 'power' AS derivation, 1 AS nth, concat_ws(',', volt.id, amp.id) AS proof_ids, volt.page AS page FROM power_fx WHERE volt IS NOT NULL AND amp IS NOT NULL
  UNION ALL SELECT doc_id, 'thermal', 2, concat_ws(',', theta.id, watt.id, CASE WHEN watt IS NULL THEN volt_near.id END, CASE WHEN watt IS NULL THEN amp_near.id END, tj_max.id), theta.page FROM power_fx WHERE theta IS NOT NULL AND watts IS NOT NULL
  UNION ALL SELECT doc_id, 'margin', 3, concat_ws(',', v_op.id, v_max.id), v_op.page FROM power_fx WHERE v_op IS NOT NULL AND v_max.value <> 0 AND v_op.value <= v_max.value
  UNION ALL SELECT doc_id, 'budget', 4, supply.id, supply.page FROM power_fx WHERE supply IS NOT NULL)"""


def topic_parts() -> str:
    asked = " UNION ALL ".join(f"SELECT q_id, doc_id, q, {i} AS topic FROM questions_fx WHERE {some('q', words)} AND intent <> 'out_of_scope'" for i, (words, _, _) in enumerate(TOPICS))
    own = " UNION ALL ".join(f"SELECT doc_id, fact_ord, {i} AS topic, 10 AS bonus, 0 AS cand FROM spec_fx WHERE {among('uom', units)}" for i, (_, units, _) in enumerate(TOPICS))
    read = " UNION ALL ".join(f"SELECT f.doc_id, f.fact_ord, {i}, 5, CAST(r.cand AS INT) FROM reading_fx r JOIN spec_fx f USING (fact_ord) WHERE r.kind = '{kind}'" for i, (_, _, kind) in enumerate(TOPICS) if kind)
    return f"""topics_fx AS ({asked}),
topic_facts AS ({own} UNION ALL {read}),
words_fx AS (SELECT q_id, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9.]+')), lambda w: length(w) > 1 AND NOT list_contains({listed(STOP.split())}, w)) AS words FROM questions_fx),
topic_scores AS (
  SELECT t.q_id, f.id, f.page, f.y, f.x, f.fact_ord, t.topic, p.cand, p.bonus + len(list_filter(w.words, lambda word: contains(lower(concat_ws(' ', f.value_str, f.label, f.context)), word))) AS score
  FROM topics_fx t JOIN topic_facts p ON p.doc_id = t.doc_id AND p.topic = t.topic JOIN spec_fx f ON f.fact_ord = p.fact_ord JOIN words_fx w ON w.q_id = t.q_id)"""


DISPATCH = f"""WITH {intents()},
{gates()},
{FACTS},
{ANSWERS},
{DERIVED},
{topic_parts()},
pins_fx AS (SELECT n_nationkey AS n, n_name AS name, CAST(n_regionkey AS VARCHAR) AS doc_id FROM nation),
cells_fx AS (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS doc_id, 'g' || s_nationkey AS id, CAST(s_nationkey // 5 AS INT) AS page, s_nationkey, s_suppkey, regexp_extract_all(lower(s_name), '[a-z0-9.]+') AS header, count(*) OVER (PARTITION BY s_nationkey) AS n_rows FROM supplier),
renamed_fx AS (SELECT *, replace(replace(replace(lbl, 'temp', 'temperature'), 'freq', 'frequency'), 'volt', 'volt') AS long_label FROM spec_fx),
found_fx AS (
  SELECT g.q_id, a.priority, a.shape, a.source_id, 'unit' AS source_type, a.page, a.n_proofs, a.proof_ids, a.first_num AS value FROM gates_fx g JOIN answers_fx a ON a.doc_id = g.doc_id AND a.priority = g.priority
  UNION ALL SELECT q_id, 740, 'value', 'pins' || g.doc_id, 'bijection', 0, 1, 'pins' || g.doc_id, NULL FROM gates_fx g WHERE priority = 740 AND g.doc_id IN (SELECT doc_id FROM pins_fx)
    AND NOT EXISTS (SELECT 1 FROM answers_fx a WHERE a.doc_id = g.doc_id AND a.priority = 740)
  UNION ALL SELECT g.q_id, 100, 'value', 'pins' || p.doc_id, 'bijection', 0, 1, 'pins' || p.doc_id, NULL FROM gates_fx g JOIN questions_fx q USING (q_id) JOIN pins_fx p ON p.doc_id = g.doc_id AND CAST(p.n AS VARCHAR) = regexp_extract(q.q, 'pin\\s+(?:number\\s+)?([0-9]+)', 1) WHERE g.priority = 100
  UNION ALL SELECT q_id, 900, 'value', id, 'unit', page, 1, id, NULL FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, y DESC, x DESC, fact_ord, topic, cand) AS nth FROM topic_scores) WHERE nth = 1
  UNION ALL SELECT q_id, 950, 'row', id, 'grid', page, 1, id, NULL FROM (
    SELECT q.q_id, c.id, c.page, row_number() OVER (PARTITION BY q.q_id ORDER BY len(list_intersect(w.words_all, c.header)) DESC, s_nationkey, s_suppkey) AS nth
    FROM questions_fx q JOIN (SELECT q_id, list_filter(list_distinct(regexp_extract_all(q, '[a-z0-9.]+')), lambda w: NOT list_contains({listed(STOP.split())}, w)) AS words_all FROM questions_fx) w USING (q_id)
      JOIN cells_fx c ON c.doc_id = q.doc_id AND c.n_rows >= 2 WHERE q.intent <> 'out_of_scope' AND len(list_intersect(w.words_all, c.header)) > 0) WHERE nth = 1
  UNION ALL SELECT q_id, 1000, 'value', arg_min(f.id, f.fact_ord), 'unit', arg_min(f.page, f.fact_ord), 1, arg_min(f.id, f.fact_ord), NULL
    FROM (SELECT *, replace(replace(replace(q, 'temp', 'temperature'), 'freq', 'frequency'), 'volt', 'voltage') AS long_q FROM questions_fx) q JOIN renamed_fx f ON f.doc_id = q.doc_id
    WHERE intent <> 'out_of_scope' AND (contains(q, lbl) OR contains(long_q, long_label) OR length(ctx) > 3 AND contains(q, ctx)) GROUP BY q_id
  UNION ALL SELECT q_id, 2000, 'derived_' || derivation, NULL, 'derived', page, CAST(len(str_split(proof_ids, ',')) AS INT), proof_ids, NULL FROM (
    SELECT q.q_id, d.*, row_number() OVER (PARTITION BY q.q_id ORDER BY d.nth) AS choice FROM questions_fx q JOIN derived_fx d ON d.doc_id = q.doc_id
    WHERE {" OR ".join(f"d.derivation = '{n}' AND regexp_matches(q.question, {quoted('(?i)' + p)})" for n, p in TRIGGERS)}) WHERE choice = 1),
best_fx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY priority) AS nth FROM found_fx) WHERE nth = 1)
SELECT q.q_id, q.intent, b.priority, CASE WHEN b.priority IS NOT NULL THEN 'answer' ELSE 'refuse' END AS status, b.shape, b.source_id, b.source_type, b.page, CAST(b.n_proofs AS INT) AS n_proofs, b.proof_ids
FROM questions_fx q LEFT JOIN best_fx b ON b.q_id = q.q_id AND q.intent <> 'out_of_scope'"""

INTENTS = f"WITH {intents()} SELECT q_id, question, intent FROM questions_fx"
GATES = f"WITH {intents()}, {gates()} SELECT q_id, priority FROM gates_fx"
DETECTED = f"""WITH {QUESTION_ROWS}, q AS (SELECT q_id, lower(question) AS q FROM raw_questions),
h AS ({" UNION ALL ".join(f"SELECT q_id, '{n}' AS parameter FROM q WHERE {some('q', words)}" for n, *_, words in PARAMETERS)})
SELECT * FROM h UNION ALL SELECT q_id, p.parameter FROM q CROSS JOIN (VALUES {", ".join(f"('{p[0]}')" for p in PARAMETERS)}) AS p(parameter) WHERE q_id NOT IN (SELECT q_id FROM h)"""
