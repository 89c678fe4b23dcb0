"""The catalogue: one query for each operator of the engine, with SQL to hold it against.

Every entry is one text. For the checking engine it is spelled out in full; for
the engine here, `for_engine` turns it into the dialect, over `read_parquet`,
and leaves out what the engine itself must add: the null order of sort keys,
the width of EXTRACT, integer division, the type of a decimal SUM. `Engine.sql`
runs it, gate and type rules included; texts beyond the dialect (derived tables)
go through it with strict off.

`@ts'…'` stands for a timestamp without zone, `{a // b}` for integer division
that truncates, `{trunc x}` for a cast of a double to BIGINT that truncates.
DOUBLE aggregates are rounded, as their summation order is not fixed: ROUND is
no function of the dialect, so the engine's result is rounded as a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine

TABLES = "region nation customer supplier part orders lineitem events".split()


@dataclass(frozen=True)
class Entry:
    """A query over the tables of a folder, and the same in the checking engine's SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    oracle: str


def for_engine(text: str) -> tuple[str, dict[str, int]]:
    """The dialect's text, tables as `{table}`, and the places that columns are rounded to."""
    text = re.sub(r"@ts'([^']*)'", r"TIMESTAMP_NTZ '\1'", text)
    text = re.sub(r"\{trunc ([^{}]*)\}", r"CAST(\1 AS BIGINT)", text)
    text = re.sub(r"\{([^{}]*?) // ([^{}]*?)\}", r"(\1 / \2)", text)
    text = re.sub(r"\s+(ASC )?NULLS (FIRST|LAST)", "", text)
    text = re.sub(r"CAST\((EXTRACT\((?:[^()]|\([^()]*\))*\)) AS BIGINT\)", r"\1", text)
    text = re.sub(r"CAST\((SUM\(CAST\(\w+ AS (DECIMAL\(\d+,\d+\))\)\)) AS \2\)", r"\1", text)
    places: dict[str, int] = {}
    while (at := text.find("ROUND(")) >= 0:
        level, end = 1, at + len("ROUND(")
        while level:
            level += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner, _, n = text[at + len("ROUND(") : end - 1].rpartition(",")
        alias = re.match(r"\s+AS (\w+)", text[end:])
        assert alias, text
        places[alias[1]] = int(n)
        text = text[:at] + inner + text[end:]
    return text, places


def for_oracle(text: str) -> str:
    text = re.sub(r"@ts'([^']*)'", r"TIMESTAMP '\1'", text)
    text = re.sub(r"\{trunc ([^{}]*)\}", r"CAST(TRUNC(\1) AS BIGINT)", text)
    return re.sub(r"\{([^{}]*?) // ([^{}]*?)\}", r"CAST(\1 // \2 AS BIGINT)", text)


def entry(text: str, repeated_keys: bool = False) -> Entry:
    """An entry from its text; tables are read for the one statement only."""
    said, places = for_engine(text)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", said)]
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 read_parquet('{sf_dir}/\2.parquet')", said)
    strict = not re.search(r"(FROM|JOIN) \(SELECT", said)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(spark).sql(bound.replace("{sf_dir}", sf_dir), strict, repeated_keys)
        return out.withColumns({c: F.round(c, n) for c, n in places.items()}) if places else out

    return Entry(run, for_oracle(text))


def catalogue() -> dict[str, Entry]:
    from . import aggregation, expressions, joins, projection, scans, sorting, subqueries, tpch

    out: dict[str, Entry] = {}
    for module in (projection, expressions, aggregation, sorting, joins, subqueries, tpch, scans):
        for name, item in module.ENTRIES.items():
            out[name] = item if isinstance(item, Entry) else entry(item, name in joins.REPEATED_KEYS)
    return out
