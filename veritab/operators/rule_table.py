"""The configuration of the question rules: fixed values, as plain tuples, in order of priority."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``family``: best (largest number), first, several or range. ``asked``: groups of keywords, one of each must be in the
    question. ``context``: keywords of the facts' context or label. ``units``: allowed units. ``grid``: keywords of table rows."""

    priority: int
    name: str
    family: str
    asked: tuple[tuple[str, ...], ...]
    context: tuple[str, ...] = ()
    units: tuple[str, ...] | None = None
    kind: str | None = None
    grid: tuple[str, ...] = ()
    default_unit: str = ""
    most: int = 4


# The rules.
RULES = [
    Rule(
        priority=150, name="part_number", family="first",
        asked=(("part number", "ordering", "order code", "mpn", "part no"),),
        context=("part number", "ordering", "order code", "mpn", "part no"),
        grid=("part number", "ordering", "order code", "mpn"),
    ),
    Rule(
        priority=160, name="description", family="first",
        asked=(("what does this do", "what does this component do", "description", "what is this component", "what is this device", "overview"),),
        context=("description", "function", "overview", "general description", "features"),
        grid=("description", "function", "overview"),
    ),
    Rule(
        priority=200, name="absolute_max_voltage", family="best",
        asked=(("absolute max", "absolute maximum"), ("voltage", " v ")),
        context=("absolute maximum", "absolute max", "abs max"),
        units=("V", "mV", "kV"), kind="voltage",
        grid=("absolute max",),
    ),
    Rule(
        priority=210, name="absolute_max_current", family="best",
        asked=(("absolute max", "absolute maximum"), ("current", " a ", "amper")),
        context=("absolute maximum", "absolute max", "abs max"),
        units=("A", "mA", "µA"), kind="current",
    ),
    Rule(
        priority=300, name="max_voltage", family="best",
        asked=(("max", "maximum"), ("voltage", " v ", " v")),
        context=("voltage", "vcc", "vdd", "supply"),
        units=("V", "VOLT", "VOLTS", "MV", "KV"), kind="voltage",
    ),
    Rule(
        priority=310, name="max_current", family="best",
        asked=(("max", "maximum"), ("current", " a ", "amper")),
        context=("current", "supply current", "icc"),
        units=("A", "MA", "µA"), kind="current",
    ),
    Rule(
        priority=320, name="max_capacity", family="best",
        asked=(("max", "maximum", "nominal"), ("capacity", "mah", " ah ", " wh ")),
        context=("capacity", "nominal capacity"),
        units=("MAH", "AH", "WH"), kind="capacity",
    ),
    Rule(
        priority=400, name="operating_voltage_range", family="range",
        asked=(("operating voltage", "supply voltage", "vcc range", "vdd range", "input voltage range"),),
        context=("operating", "supply", "vcc", "vdd", "input voltage"),
        units=("V", "mV", "kV"), kind="voltage", default_unit="V",
        grid=("operating voltage", "supply voltage", "vcc", "vdd"),
    ),
    Rule(
        priority=405, name="storage_temperature", family="first",
        asked=(("storage temp", "storage temperature"),),
        context=("storage temperature", "storage temp", "tstg", "storage"),
        grid=("storage temperature", "storage temp", "tstg"),
    ),
    Rule(
        priority=410, name="operating_temperature_range", family="range",
        asked=(("operating temp", "junction temp", "temperature range", "ambient temp"),),
        context=("operating temperature", "junction temperature", "ambient temperature", "operating temp"),
        units=("°C", "℃", "°F", "K"), kind="temperature", default_unit="°C",
        grid=("operating temperature", "junction temperature", "ambient temperature"),
    ),
    Rule(
        priority=430, name="soldering_temperature", family="first",
        asked=(("solder", "reflow", "soldering temperature", "reflow temperature"),),
        context=("solder", "reflow", "soldering", "reflow temperature"),
        grid=("solder", "reflow"),
    ),
    Rule(
        priority=500, name="power_dissipation", family="best",
        asked=(("power dissipation", "max power", "power rating", "power consumption"),),
        context=("power dissipation", "power rating", "power consumption", "total power"),
        units=("W", "mW"), kind="power",
        grid=("power dissipation", "power rating", "power consumption"),
    ),
    Rule(
        priority=510, name="esd_ratings", family="several",
        asked=(("esd", "electrostatic", "esd rating"),),
        context=("esd", "electrostatic", "hbm", "cdm"),
        grid=("esd", "electrostatic", "hbm", "cdm"),
    ),
    Rule(
        priority=520, name="leakage_current", family="first",
        asked=(("leakage current", "input leakage", "ileak"),),
        context=("leakage", "ileak", "input leakage"),
        units=("A", "mA", "µA", "nA"),
        grid=("leakage current", "input leakage", "ileak"),
    ),
    Rule(
        priority=530, name="threshold_voltage", family="several",
        asked=(("threshold", "vil", "vih", "vol", "voh", "logic level"),),
        context=("threshold", "vil", "vih", "vol", "voh", "logic level", "input low", "input high"),
        units=("V", "mV"),
        grid=("threshold", "vil", "vih", "logic level"),
    ),
    Rule(
        priority=600, name="clock_frequency", family="best",
        asked=(("clock", "frequency", "bandwidth", "fmax", "speed", "data rate"),),
        context=("clock", "frequency", "bandwidth", "fmax", "speed", "data rate", "oscillator"),
        units=("Hz", "kHz", "MHz", "GHz"), kind="frequency",
        grid=("clock", "frequency", "bandwidth", "fmax"),
    ),
    Rule(
        priority=610, name="propagation_delay", family="first",
        asked=(("propagation delay", "tpd", "delay time"),),
        context=("propagation delay", "propagation", "tpd", "delay time", "tphl", "tplh"),
        units=("ns", "µs", "ps", "ms"),
        grid=("propagation delay", "tpd", "tphl", "tplh"),
    ),
    Rule(
        priority=620, name="rise_fall_time", family="several",
        asked=(("rise time", "fall time", " tr ", " tf ", "slew rate", "rise/fall"),),
        context=("rise time", "fall time", "slew rate", "slew", "tr/tf", "rise/fall"),
        units=("ns", "µs", "ps", "V/µs", "V/ns"),
        grid=("rise time", "fall time", "slew", "tr", "tf"),
    ),
    Rule(
        priority=630, name="setup_hold_time", family="several",
        asked=(("setup time", "hold time", "tsu", " th ", "setup/hold", "setup and hold"),),
        context=("setup time", "hold time", "tsu", "setup/hold", "setup and hold"),
        units=("ns", "µs", "ps", "ms"),
        grid=("setup time", "hold time", "tsu"),
    ),
    Rule(
        priority=700, name="package_type", family="first",
        asked=(("package", "footprint", "case"),),
        context=("package", "footprint", "case", "package type"),
        grid=("package", "footprint", "case"),
    ),
    Rule(
        priority=710, name="package_dimensions", family="several",
        asked=(("dimension", "package size", "length", "width", "height", "package dimension"),),
        context=("dimension", "package size", "length", "width", "height", "body size"),
        units=("mm", "mil", "in", "cm"), most=6,
        grid=("dimension", "package size", "body size"),
    ),
    Rule(
        priority=720, name="thermal_resistance", family="first",
        asked=(("thermal resistance", "θja", "theta-ja", "rθja", "θjc", "junction to ambient", "junction-to-ambient"),),
        context=("thermal resistance", "θja", "theta", "junction to ambient", "junction-to-ambient", "θjc", "rθja"),
        units=("°C/W", "K/W"),
        grid=("thermal resistance", "θja", "theta", "junction to ambient"),
    ),
    Rule(
        priority=730, name="weight", family="first",
        asked=(("weight", "mass"),),
        context=("weight", "mass"),
        units=("g", "mg", "kg", "oz"),
        grid=("weight", "mass"),
    ),
    Rule(
        priority=740, name="pin_count", family="first",
        asked=(("pin count", "how many pins", "number of pins", "total pins"),),
        context=("pin count", "number of pins", "total pins"),
    ),
    Rule(
        priority=750, name="moisture_sensitivity", family="first",
        asked=(("moisture sensitivity", "msl", "msl rating"),),
        context=("moisture sensitivity", "msl"),
        grid=("moisture sensitivity", "msl"),
    ),
    Rule(
        priority=800, name="recommended_operating", family="several",
        asked=(("recommended operating", "recommended conditions"),),
        context=("recommended operating", "recommended conditions"),
        most=6,
        grid=("recommended operating", "recommended conditions"),
    ),
]
# Rules that look at the question's own words; their plans are in ``rules.py``.
QUESTION_RULES = {100: "pin_lookup", 900: "unit_by_intent", 950: "grid_cell_lookup", 1000: "unit_lookup"}
# Fixed values of rule 900: (question keywords, units in capitals, kind of measurement).
TOPICS = [
    (("voltage", "volt", " v ", "charge voltage", "cutoff voltage"), ("V", "VOLT", "VOLTS", "MV", "KV"), "voltage"),
    (("current", "amper", " a ", "discharge current", "charge current"), ("A", "MA", "µA"), "current"),
    (("capacity", "mah", " ah ", " wh ", "nominal capacity"), ("MAH", "AH", "WH"), "capacity"),
    (("power", "watt", " w "), ("W", "MW"), "power"),
    (("temperature", "temp", "°c", "℃"), ("°C", "℃", "°F", "K"), "temperature"),
    (("frequency", "clock", "speed", "hz"), ("HZ", "KHZ", "MHZ", "GHZ"), "frequency"),
    (("resistance", "ohm", "impedance", " ω "), ("Ω", "OHM", "OHMS", "KΩ", "MΩ"), None),
]
# The parameters of comparisons: label, direction (which end is best), context keywords, label keywords, units, query triggers.
PARAMETERS: dict[str, tuple[str, str, list[str], list[str], list[str], list[str]]] = {
    "max_voltage": ("Maximum Voltage", "lower", ["maximum voltage", "max voltage", "absolute max"], ["vmax", "vcc max", "absolute max"], ["V"], ["max voltage", "maximum voltage", "absolute max"]),
    "supply_voltage": ("Supply Voltage", "neutral", ["supply voltage", "operating voltage"], ["vcc", "vdd"], ["V"], ["supply voltage", "operating voltage", "vcc", "vdd"]),
    "thermal_resistance": ("Thermal Resistance (θJA)", "lower", ["thermal resistance", "theta", "θja", "junction to ambient"], ["θja", "rthja"], ["°C/W", "C/W", "K/W"], ["thermal resistance", "θja", "theta", "rthja"]),
    "max_current": ("Maximum Current", "lower", ["maximum current", "max current"], ["imax", "icc max"], ["A", "mA"], ["max current", "maximum current"]),
    "operating_temperature": ("Operating Temperature Range", "higher", ["operating temperature", "temperature range"], ["topr", "ta"], ["°C", "C"], ["operating temp", "temperature range", "85°c", "85c"]),
    "power_dissipation": ("Power Dissipation", "lower", ["power dissipation", "max power"], ["pd", "ptot"], ["W", "mW"], ["power dissipation", "power consumption"]),
}
# The facts that derivations need: context | label -> units; and those that are outputs.
LOOKUPS = {
    "volt": (["supply voltage", "operating voltage", "vcc", "vdd"], ["vcc", "vdd", "supply"], ["V", "mV"]),
    "amp": (["supply current", "operating current", "icc", "idd"], ["icc", "idd", "supply current"], ["A", "mA", "uA"]),
    "theta": (["thermal resistance", "theta", "θja", "junction to ambient"], ["θja", "theta", "rthja", "thermal"], ["°C/W", "C/W", "K/W"]),
    "watt": (["power dissipation", "total power"], ["pd", "power"], ["W", "mW"]),
    "tj_max": (["maximum junction temperature", "junction temp"], ["tj max", "tjmax"], ["°C", "C"]),
    "volt_near": (["supply voltage", "vcc"], ["vcc", "vdd"], ["V", "mV"]),
    "amp_near": (["supply current", "icc"], ["icc", "idd"], ["A", "mA"]),
    "v_op": (["supply voltage", "operating voltage", "typical supply"], ["vcc", "vdd", "supply"], ["V"]),
    "v_abs": (["absolute maximum voltage", "absolute max voltage"], ["absolute max", "vcc max", "abs max"], ["V"]),
    "v_top": (["maximum voltage", "max voltage"], ["vcc max", "vmax"], ["V"]),
    "supply": (["supply current", "total current", "icc max", "maximum supply"], ["icc", "idd", "supply current"], ["A", "mA"]),
}
OUTPUTS = (["output current", "pin current", "io"], ["io", "iout", "output"], ["A", "mA"])
