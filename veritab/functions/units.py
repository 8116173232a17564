"""Conversion of units of measure to base units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> (base unit, multiplier); other spellings of units. Case matters.
BASE = {
    "V": ("V", 1.0), "mV": ("V", 1e-3), "uV": ("V", 1e-6), "kV": ("V", 1e3),
    "A": ("A", 1.0), "mA": ("A", 1e-3), "uA": ("A", 1e-6), "nA": ("A", 1e-9),
    "W": ("W", 1.0), "mW": ("W", 1e-3),
    "Hz": ("Hz", 1.0), "kHz": ("Hz", 1e3), "MHz": ("Hz", 1e6), "GHz": ("Hz", 1e9),
    "s": ("s", 1.0), "ms": ("s", 1e-3), "us": ("s", 1e-6), "ns": ("s", 1e-9), "ps": ("s", 1e-12),
    "F": ("F", 1.0), "mF": ("F", 1e-3), "uF": ("F", 1e-6), "nF": ("F", 1e-9), "pF": ("F", 1e-12),
    "Ohm": ("Ohm", 1.0), "kOhm": ("Ohm", 1e3), "MOhm": ("Ohm", 1e6),
    "C": ("C", 1.0),
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "in": ("mm", 25.4), "mil": ("mm", 0.0254),
    "mAh": ("mAh", 1.0), "Ah": ("mAh", 1000.0),
}
ALIASES = {"Ω": "Ohm", "kΩ": "kOhm", "MΩ": "MOhm", "µV": "uV", "µA": "uA", "µF": "uF", "µs": "us", "°C": "C", "degC": "C"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def unit_name(unit: Column) -> Column:
    return F.coalesce(_map(ALIASES)[F.trim(unit)], F.trim(unit))


def base_unit(unit: Column) -> Column:
    """The base unit, null for a unit that is not known."""
    return _map({u: b for u, (b, _) in BASE.items()})[unit_name(unit)]


def base_value(value: Column, unit: Column) -> Column:
    """The value in base units, null for a unit that is not known."""
    return value * _map({u: m for u, (_, m) in BASE.items()})[unit_name(unit)]


def exact_multiplier(unit: Column) -> Column:
    """The multiplier to the base unit as a decimal, null for a unit that is not known."""
    return _map({u: f"{m:.12f}" for u, (_, m) in BASE.items()})[unit_name(unit)].cast("decimal(22,12)")
