"""SQL text shared by the feature families.

Every relational family is one SELECT over a table of pixels (slide_id, t, label, x, y, z, inten). The text runs on
Spark, and with the other dialect's quoting and row generators on any engine that checks it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

KEYS = ("slide_id", "t", "label")
K = ", ".join(KEYS)


def on(a: str, b: str, extra: Iterable[str] = ()) -> str:
    """Equality of a region's keys (and of further columns) between two aliases."""
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*KEYS, *extra))


def of(alias: str, extra: Iterable[str] = ()) -> str:
    return ", ".join(f"{alias}.{c}" for c in (*KEYS, *extra))


def quoted(name: str, dialect: str) -> str:
    return f"`{name}`" if dialect == "spark" else f'"{name}"'


def with_rows(table: str, alias: str, rows: Sequence[Sequence[int]], columns: Sequence[str], dialect: str) -> str:
    """FROM clause: each row of table once for each of a few constant rows, without a join on Spark."""
    if dialect == "spark":
        structs = ", ".join("named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, r, strict=True)) + ")" for r in rows)
        return f"{table} {alias} LATERAL VIEW inline(array({structs})) o AS {', '.join(columns)}"
    values = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    return f"{table} {alias} CROSS JOIN (VALUES {values}) AS o({', '.join(columns)})"


def div(a: str, b: str) -> str:
    """a/b as double, null where b is 0."""
    return f"(({a}) / nullif(({b}) * 1e0, 0e0))"


def finished(inner: str, names: Sequence, dialect: str, keys: Sequence[str] = KEYS, noval: float = 0.0) -> str:
    """The outermost SELECT: keys, and doubles in which nulls are noval. names: (column of inner, output name), or names that serve as both."""
    pairs = [n if isinstance(n, tuple) else (n, n) for n in names]
    return f"SELECT {', '.join(keys)}, " + ", ".join(f"coalesce(cast({c} as double), {noval}e0) AS {quoted(n, dialect)}" for c, n in pairs) + f" FROM ({inner}) AS inner_"


def rounded(inner: str, names: Sequence[str], dialect: str, keys: Sequence[str] = KEYS) -> str:
    """For comparing engines: values to single precision, and what is noise about zero as zero."""
    value = lambda x: f"CASE WHEN abs({x}) < 1e-6 THEN 0e0 ELSE cast(cast({x} as float) as double) END"
    return f"SELECT {', '.join(keys)}, " + ", ".join(f"{value(quoted(n, dialect))} AS {quoted(n, dialect)}" for n in names) + f" FROM ({inner}) AS exact_"


def run(pixels: DataFrame, text: str, **tables: DataFrame) -> DataFrame:
    """text over the DataFrame that stands for {pixels}."""
    return pixels.sparkSession.sql(text, pixels=pixels, **tables)
