"""Building blocks of the checking SQL: shared subqueries and portable output columns.

Both engines return the same plain types: whole numbers as bigint, fractions as double rounded to four
digits, dates as text, moments as microseconds since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.sources import fixtures as fx

CTE: dict[str, str] = {}
_CALL = re.compile(r"\b(FX|OP)\((\w+)\)")


def shared(name: str, sql: str) -> None:
    CTE[name] = sql.strip()


def _gather(sql: str, fixtures: list[str], parts: dict[str, str]) -> None:
    for kind, name in _CALL.findall(sql):
        if kind == "FX":
            if name not in fixtures:
                fixtures.append(name)
        elif name not in parts:
            _gather(CTE[name], fixtures, parts)
            parts[name] = CTE[name]


def compose(sql: str) -> str:
    """One statement: the fixtures it needs, the shared subqueries it needs, then itself."""
    fixtures: list[str] = []
    parts: dict[str, str] = {}
    _gather(sql, fixtures, parts)
    name = lambda m: f"fx_{m[2]}" if m[1] == "FX" else f"op_{m[2]}"
    clauses = fx.with_clause(fixtures, "duckdb") + [
        f"op_{n} as (\n{_CALL.sub(name, text)}\n)" for n, text in parts.items()
    ]
    body = _CALL.sub(name, sql.strip())
    return (f"with {', '.join(clauses)}\n" if clauses else "") + body


def out(source: str, ints="", reals="", strs="", bools="", dates="", times="", tail="") -> str:
    """Final select over ``source`` with portable columns, listed by kind."""
    cols = [f"cast({c} as bigint) as {c}" for c in ints.split()]
    cols += [f"round(cast({c} as double), 4) + 0.0 as {c}" for c in reals.split()]
    cols += [f"cast({c} as varchar) as {c}" for c in strs.split()]
    cols += list(bools.split())
    cols += [f"cast({c} as varchar) as {c}" for c in dates.split()]
    cols += [f"cast(round({c} * 1000000) as bigint) as {c}" for c in times.split()]
    return f"select {', '.join(cols)} from {source} {tail}".strip()


def portable(df: DataFrame) -> DataFrame:
    """The same on the Spark side, from the DataFrame's own types."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("long")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(name))
    return df.select(*cols)


# --- small expressions ---------------------------------------------------------------------

AS_OF = int(fx.AS_OF.timestamp())
LIVE = int(fx.LIVE.timestamp())


def local_day(x: str) -> str:
    return f"(date '1970-01-01' + cast(floor(({x} - {fx.OFFSET}) / 86400) as int))"


def utc_day(x: str) -> str:
    return f"(date '1970-01-01' + cast(floor({x} / 86400) as int))"


def local_hour(x: str) -> str:
    return f"(cast(floor(({x} - {fx.OFFSET}) / 3600) as bigint) % 24)"


def kind_of_day(d: str) -> str:
    return f"(case isodow({d}) when 6 then 'saturday' when 7 then 'sunday' else 'weekday' end)"


def whole(x: str) -> str:
    """Nearest whole number, halves away from zero."""
    return f"(cast(sign({x}) * floor(abs({x}) + 0.5) as bigint))"


def q(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


def share(cond: str, digits: int = 1) -> str:
    return f"round(100.0 * avg(case when {cond} then 1 when not ({cond}) then 0 end), {digits})"


def ratio(part: str, total: str, digits: int = 0) -> str:
    return f"round(100.0 * {part} / nullif({total}, 0), {digits})"
