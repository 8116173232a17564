"""Answers as text. Numbers are written as Python writes them, which no SQL engine does alike, so this is an Arrow UDF; never compare its result across engines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def answer_text(shape: pd.Series, parts: pd.Series) -> pd.Series:
    def shown(p) -> str:
        value = p["str"] if p["str"] is not None else "" if p["num"] is None or p["num"] != p["num"] else str(float(p["num"]))
        return f"{value} {p['unit'] or ''}".strip()

    def text(kind, ps) -> str | None:
        if kind is None or ps is None or not len(ps):
            return None
        if kind == "range":
            return f"{float(ps[0]['num'])} to {float(ps[1]['num'])} {ps[0]['unit'] or ''}".strip()
        if kind == "several":
            return "; ".join(f"{p['label'] or ''}: {shown(p)}".strip() for p in ps)
        if kind == "row":
            return ", ".join(p["str"] for p in ps)
        if kind == "derived_power":
            milli = ps[0]["num"]
            power = f"{milli:.3f} mW" if milli < 1 else f"{milli:.1f} mW" if milli < 1000 else f"{milli / 1000:.2f} W"
            return f"Power dissipation: {power}"
        if kind.startswith("derived_"):
            return f"{kind[8:]}: {ps[0]['num']:.1f} {ps[0]['unit']}"
        return shown(ps[0])

    return pd.Series([text(k, p) for k, p in zip(shape, parts, strict=True)], dtype=object)


def with_text(answers, name: str = "answer"):
    """Answers of ``dispatch`` with their text."""
    return answers.withColumn(name, answer_text(F.col("shape"), F.col("parts")))


def python_text(value: Column) -> Column:
    return answer_text(F.lit("value"), F.array(F.struct(F.lit(None).cast("string").alias("label"), value.alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("unit"))))
