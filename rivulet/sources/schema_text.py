"""Schemas written as text with statistics:

    CUSTOMER [150000:S] ( CUSTKEY LONG [DISTINCT=150000:S] [MIN=1] [MAX=150000:S], NAME STRING, .. )

A number followed by :S grows with the scale factor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES = {"LONG": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}
TOKENS = re.compile(r"#[^\n]*|'[^']*'|\{[^}]*\}|[\[\](),=:]|[^\s\[\](),=:#]+")


@dataclass
class Table:
    name: str
    schema: T.StructType
    rows: float | None = None
    stats: dict[str, dict[str, float | str]] = field(default_factory=dict)


def parse_schema(text: str, scale: float = 1.0) -> dict[str, Table]:
    """Tables by name, in the order written."""
    toks = [t for t in TOKENS.findall(text) if not t.startswith("#")]
    at = 0

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if not t or (want and t.upper() != want):
            raise ValueError(f"{want or 'a word'} expected, not {t or 'the end'}")
        at += 1
        return t

    def value() -> float | str:
        raw = take()
        try:
            x: float | str = float(raw)
        except ValueError:
            x = raw.strip("'")
        if peek() == ":":
            take(":")
            take("S")
            x = x * scale if isinstance(x, float) else x
        return x

    out: dict[str, Table] = {}
    while at < len(toks):
        if peek().upper() == "TABLE":
            take()
        table = Table(take().upper(), T.StructType())
        if peek() == "[":
            take("[")
            table.rows = value()
            take("]")
        take("(")
        while True:
            name, kind = take().upper(), take().upper()
            if kind not in TYPES:
                raise ValueError(f"unknown type {kind} of {name}")
            table.schema.add(name, TYPES[kind])
            while peek() == "[":
                take("[")
                what = take().upper()
                take("=")
                table.stats.setdefault(name, {})[what] = value()
                take("]")
            if peek() != ",":
                break
            take(",")
        take(")")
        out[table.name] = table
    return out
