"""Registry of queries and, side by side, the statements that check them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.plans.fixture import CTES, Fixture


@dataclass
class Entry:
    build: Callable[[Fixture], DataFrame]
    sql: str | None
    num: tuple[str, ...]
    digits: int


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, num: str = "", digits: int = 6):
    """Register ``build(fixture)``. ``num`` lists the floating columns, rounded alike on both sides.

    Means of integer cents often lie exactly half-way between two roundings, where the last bit of a sum would
    decide. Both sides therefore add the same small part of the last digit before rounding.
    """

    def add(build: Callable[[Fixture], DataFrame]):
        assert name not in ENTRIES, name
        ENTRIES[name] = Entry(build, sql, tuple(num.split()), digits)
        return build

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ENTRIES[name]
    df = e.build(Fixture(spark, sf_dir))
    nudge = F.lit(_nudge(e.digits))
    return df.withColumns({c: F.round(F.col(c).cast("double") + nudge, e.digits) for c in e.num}) if e.num else df


def _nudge(digits: int) -> float:
    return 0.0137 * 10.0**-digits


def _needed(text: str) -> list[str]:
    """Names of the views a statement uses, directly or through other views, in order of definition."""
    used: set[str] = set()
    todo = [text]
    while todo:
        body = todo.pop()
        for name, sql in CTES.items():
            if name not in used and re.search(rf"\b{name}\b", body):
                used.add(name)
                todo.append(sql)
    return [n for n in CTES if n in used]


def oracle(name: str) -> str | None:
    e = ENTRIES[name]
    if e.sql is None:
        return None
    views = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in _needed(e.sql))
    fixed = ", ".join(f"round(CAST({c} AS DOUBLE) + {_nudge(e.digits)!r}, {e.digits}) + 0 AS {c}" for c in e.num)
    pick = f"* REPLACE ({fixed})" if fixed else "*"
    return f"WITH {views}\nSELECT {pick} FROM ({e.sql.strip()}) q"
