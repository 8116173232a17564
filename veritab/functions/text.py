"""Questions, keywords, numbers and measurements in text, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.keywords import trie_pattern

# Words that do not count, and how measurements are written.
STOP_WORDS = """what is the of this document a an are for in on at to and or it its how does do that which with from can has have
be was many much""".split()
#: kind: (sign allowed, suffixes as written, suffix in lower case -> unit)
MEASUREMENTS = {
    "voltage": (False, "kV|mV|V|VOLT|VOLTS", {"kv": "kV", "mv": "mV", "v": "V", "volt": "V", "volts": "V"}),
    "current": (False, "µA|uA|mA|A", {"µa": "µA", "ua": "µA", "ma": "mA", "a": "A"}),
    "capacity": (False, "mAh|Ah|Wh", {"mah": "mAh", "ah": "Ah", "wh": "Wh"}),
    "power": (False, "mW|W|WATT|WATTS", {"mw": "mW", "w": "W", "watt": "W", "watts": "W"}),
    "temperature": (True, "°C|℃|°F|K", {"°c": "°C", "℃": "°C", "°f": "°F", "k": "K"}),
    "frequency": (False, "GHz|MHz|kHz|Hz", {"ghz": "GHz", "mhz": "MHz", "khz": "kHz", "hz": "Hz"}),
    "time": (False, "µs|us|ns|ps|ms|s", {"µs": "µs", "us": "µs", "ns": "ns", "ps": "ps", "ms": "ms", "s": "s"}),
    "dimension": (False, "mm|mil|cm|in|inch", {"mm": "mm", "mil": "mil", "cm": "cm", "in": "in", "inch": "in"}),
    "weight": (False, "mg|kg|g|oz", {"mg": "mg", "g": "g", "kg": "kg", "oz": "oz"}),
}

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def normalised(text: Column) -> Column:
    """Lower case, without white space at the ends."""
    return F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")


def has_any(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs in ``text``, as a substring; false for null."""
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


def upper_in(unit: Column, units: list[str] | None) -> Column:
    """Whether the unit, in capitals, is among ``units`` in capitals; no list: true."""
    if units is None:
        return F.lit(True)
    return F.upper(F.coalesce(unit, F.lit(""))).isin([u.upper() for u in units])


def number(text: Column) -> Column:
    """The double that ``text`` writes in plain notation, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def blank_null(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def words_of(text: Column) -> Column:
    """Distinct words of a question that count."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9.]+"), F.lit(0))), F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_overlap(question: Column, text: Column) -> Column:
    """How many words of the question, of two letters or more, occur in ``text`` as substrings."""
    low = F.lower(text)
    return F.size(F.filter(words_of(question), lambda w: (F.char_length(w) > 1) & F.contains(low, w)))


#: Suffix in lower case -> its kind and unit. Suffixes of different kinds never end at the same place of a word, so one search for all finds what one for each kind would.
SUFFIXES = {suffix: {"kind": kind, "unit": unit} for kind, (_, _, units) in MEASUREMENTS.items() for suffix, unit in units.items()}
#: No number is tried from its middle, nor without its last digits: what follows would be a digit, and no suffix.
ANY_MEASUREMENT = rf"(?iu)(?:[+-]|(?<!\d))\d++(?:\.\d++)?+\s*+{trie_pattern(SUFFIXES)}\b"
READINGS = "array<struct<kind:string,value:double,unit:string>>"


def readings(text: Column) -> Column:
    """array<struct<kind, value, unit>> of the measurements of all kinds in ``text``, from left to right, by one search.

    A sign counts where the kind allows one.
    """
    table = F.from_json(F.lit(json.dumps(SUFFIXES)), "map<string,struct<kind:string,unit:string>>")
    signed = [kind for kind, (sign, _, _) in MEASUREMENTS.items() if sign]
    given = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (reckons x once)

    def read(found: Column) -> Column:
        suffix = F.translate(found, "0123456789.+- \t\n\x0b\f\r", "")
        plain = F.substring(found, F.lit(1), F.char_length(found) - F.char_length(suffix))
        what = F.element_at(table, F.replace(F.lower(suffix), F.lit("μ"), F.lit("µ")))
        value = F.translate(plain, " \t\n\x0b\f\r", "").cast("double")
        return given(F.struct(what.alias("w"), value.alias("v")), lambda x: F.struct(x["w"]["kind"].alias("kind"), F.when(x["w"]["kind"].isin(signed), x["v"]).otherwise(F.abs(x["v"])).alias("value"), x["w"]["unit"].alias("unit")))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_MEASUREMENT), F.lit(0)), read)


def of_kind(found: Column, kind: str) -> Column:
    """array<struct<value, unit>> of the readings of one kind."""
    return F.transform(F.filter(found, lambda r: r["kind"] == kind), lambda r: F.struct(r["value"].alias("value"), r["unit"].alias("unit")))


def measurements(kind: str, text: Column) -> Column:
    """array<struct<value, unit>> of the measurements of one kind in ``text``, from left to right."""
    return of_kind(readings(text), kind)
