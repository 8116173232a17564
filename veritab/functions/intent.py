"""Classification of questions, and which rules each class lets through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each class, without regard to case; the order of CLASSES and SPECS counts.
OUT_OF_SCOPE = [
    r"\b(weather|stock|price|news|who is|where is|when did)\b",
    r"\b(recipe|movie|song|book|game)\b",
]
SPEC_INDICATOR = [r"\b(what is|what's|what are|how much|how many|value of|rating|spec|specification|limit)\b"]
DESIGN_CONTEXT = [r"\b(design|circuit|schematic|calculate|divider|network|resistor network|how do i|how to|recommend|choose|select|compare|versus|vs\.?|between)\b"]
CLASSES = {
    "pin_lookup": [
        r"\bpin\s+(?:\d+|number|#|no\.?)\b",
        r"\bwhat\s+is\s+pin\s+\d+\b",
        r"\bpin(?:out|assignment|description|function)\b",
        r"\bfunction\s+of\s+pin\b",
    ],
    "package_query": [
        r"\bpackage\s+(?:type|size|dimensions?|footprint)\b",
        r"\b(?:soic|qfp|qfn|bga|dip|sot|tssop|lqfp|dfn)\b",
        r"\bpin\s+count\b",
        r"\b(?:how\s+many|number\s+of)\s+pins\b",
        r"\bfootprint\b",
        r"\bdimensions?\b",
        r"\bweight\b",
        r"\bmsl\b",
        r"\bmoisture\s+sensitivity\b",
    ],
    "thermal_query": [
        r"\bthermal\s+(?:resistance|impedance)\b",
        r"\b[rθ](?:ja|jc|ca)\b",
        r"\bjunction[\s-]to[\s-](?:ambient|case)\b",
        r"\bθ(?:ja|jc)\b",
        r"\bthermal\s+(?:pad|via|management)\b",
    ],
}
SPECS = {
    "voltage_spec": [
        r"\b(max(?:imum)?|min(?:imum)?|operating|supply|input|output)\s+voltage\b",
        r"\bv(?:cc|dd|in|out|oh|ol|ih|il|bat|bus|ref|ss)\b",
        r"\babsolute\s+max(?:imum)?\s+(?:rating)?\s*.*voltage\b",
        r"\bvoltage\s+(?:range|limit|rating|spec)\b",
    ],
    "current_spec": [
        r"\b(max(?:imum)?|min(?:imum)?|operating|supply|input|output)\s+current\b",
        r"\bi(?:cc|dd|oh|ol|in|out|q|leak|standby|sleep)\b",
        r"\bcurrent\s+(?:consumption|draw|limit|rating|spec)\b",
        r"\bleakage\s+current\b",
    ],
    "power_spec": [
        r"\bpower\s+(?:dissipation|consumption|rating|limit)\b",
        r"\b(?:max(?:imum)?|total)\s+power\b",
        r"\bp(?:d|tot|max)\b",
        r"\b(?:milliwatts?|watts?|mw|w)\s+(?:rating|dissipation)\b",
    ],
    "temperature_spec": [
        r"\b(operating|storage|junction|ambient)\s+temp(?:erature)?\b",
        r"\bt(?:j|a|op|stg|amb)(?:_max|_min)?\b",
        r"\btemp(?:erature)?\s+(?:range|limit|rating)\b",
        r"\bsoldering?\s+temp(?:erature)?\b",
        r"\breflow\b",
    ],
    "timing_spec": [
        r"\b(propagation|rise|fall|setup|hold)\s+(?:time|delay)\b",
        r"\bt(?:pd|r|f|su|h|phl|plh)\b",
        r"\bslew\s+rate\b",
        r"\bdelay\s+time\b",
    ],
    "frequency_spec": [
        r"\b(clock|operating|max(?:imum)?)\s+frequency\b",
        r"\bf(?:max|clk|osc)\b",
        r"\bbandwidth\b",
        r"\bdata\s+rate\b",
        r"\b(?:mhz|ghz|khz)\b",
    ],
}
#: The classes that a rule answers; a rule that is not listed answers all but out-of-scope questions.
RULE_CLASSES = {
    "voltage_spec": ["absolute_max_voltage", "max_voltage", "operating_voltage_range", "threshold_voltage"],
    "current_spec": ["absolute_max_current", "max_current", "leakage_current"],
    "power_spec": ["power_dissipation"],
    "temperature_spec": ["storage_temperature", "operating_temperature_range", "soldering_temperature"],
    "timing_spec": ["propagation_delay", "rise_fall_time", "setup_hold_time"],
    "frequency_spec": ["clock_frequency"],
    "pin_lookup": ["pin_lookup", "pin_count"],
    "package_query": ["package_type", "package_dimensions", "weight", "pin_count", "moisture_sensitivity"],
    "thermal_query": ["thermal_resistance"],
}


def matches(text: Column, *patterns: str) -> Column:
    """Whether any of the patterns occurs in the text."""
    return text.rlike("(?iu)" + "|".join(patterns))


def classify(question: Column) -> Column:
    """The class of a question: out of scope, then the unambiguous ones, then specifications unless it is about design."""
    q = F.coalesce(question, F.lit(""))
    spec = matches(q, *SPEC_INDICATOR) | ~matches(q, *DESIGN_CONTEXT)
    found = F.when(matches(q, *OUT_OF_SCOPE), "out_of_scope")
    for name, patterns in CLASSES.items():
        found = found.when(matches(q, *patterns), name)
    for name, patterns in SPECS.items():
        found = found.when(spec & matches(q, *patterns), name)
    return found.otherwise("general_question")


def allows(intent: Column, rule: str) -> Column:
    """Whether a question of this class may be answered by ``rule``."""
    own = [name for name, rules in RULE_CLASSES.items() if rule in rules]
    if not own:
        return intent != "out_of_scope"
    return intent.isin([*own, "general_question"])
