"""Queries given as plain data: a mapping of clauses, run by Spark SQL over named DataFrames.

    run_spec(tables, {
        "select": ["c.CategoryName as Categoría", "SUM(s.Quantity) as Total"],
        "from": "sales s",
        "joins": [("categories c", "s.CategoryID = c.CategoryID")],
        "where": ["s.Quantity > :least"],
        "group_by": ["c.CategoryName"], "having": ["Total > 10 AND COUNT(*) > 1"],
        "order_by": ["Total DESC"], "limit": 10,
    }, {"least": 2})

Spark's parser and analyzer place every clause, so HAVING takes output names, aggregates or
both, and ORDER BY an aggregate too (beside HAVING: its output name); values come as bind parameters.
Each clause must be one complete expression by itself (Spark's parser checks it alone), so that no
clause can add another. An outer join on one equal column of either side deals a hot key of the side that
isn't preserved to many tasks (:func:`mercato.operators.joins.deal_hot_keys`).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from mercato.operators.joins import deal_hot_keys

CLAUSES = ("select", "from", "joins", "where", "group_by", "having", "order_by", "limit")
# no cross join: a specification always says how tables meet
JOINS = ("INNER", "LEFT", "LEFT OUTER", "RIGHT", "RIGHT OUTER", "FULL", "FULL OUTER", "LEFT SEMI", "LEFT ANTI")

_QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""")


# a column of either side, equal
_EQUAL = re.compile(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*")
_COUNT, _STAR = re.compile(r"count\(\s*\*\s*\)", re.IGNORECASE), re.compile(r"(^|[\s,(.])\*\s*($|[),])")
_DIRECTION = re.compile(r"\s+(ASC|DESC)?(\s+NULLS\s+(FIRST|LAST))?\s*$", re.IGNORECASE)


def _sql(spark: SparkSession, text: str, what: str = "expression") -> str:
    """``text`` with names beyond ASCII in backquotes, as Spark wants them, and braces kept as they are.
    Raises ValueError unless it is one expression."""
    parts = _QUOTED.split(text)  # odd places are quoted already
    parts[::2] = [re.sub(r"\w+", lambda m: m[0] if m[0].isascii() else f"`{m[0]}`", p) for p in parts[::2]]
    plain = "".join(parts)
    try:  # the session's parser, without the analysis that needs the whole query's names
        spark._jsparkSession.sessionState().sqlParser().parseExpression(_DIRECTION.sub("", plain) if what == "order" else plain)
    except ParseException as e:
        raise ValueError(f"not one expression: {text!r}") from e
    return plain.replace("{", "{{").replace("}", "}}") + "\n"  # a comment ends here


def run_spec(tables: Mapping[str, DataFrame], spec: Mapping[str, Any], params: Mapping[str, Any] | None = None) -> DataFrame:
    """Run ``spec`` over ``tables`` (``{"sales": df, ...}``; names in any case).

    ``select`` and ``from`` are required. A join is ``(table, condition)`` or ``(table, condition,
    type)``; conditions of a list hold together; ``order_by`` items may end in ASC or DESC. ``params``
    are the values of ``:name`` markers.
    """
    unknown = set(spec) - set(CLAUSES)
    if unknown:
        raise ValueError(f"unknown clauses {sorted(unknown)}; known are {CLAUSES}")
    if not spec.get("select") or not spec.get("from"):
        raise ValueError("a specification needs 'select' and 'from'")
    frames = {f"table_{name.lower()}": df for name, df in tables.items()}
    spark = next(iter(frames.values())).sparkSession
    used: dict[str, DataFrame] = {}  # by alias

    def table(ref: str) -> str:
        name, _, alias = ref.strip().partition(" ")
        alias = re.sub(r"^as\s+", "", alias.strip(), flags=re.IGNORECASE) or name
        if f"table_{name.lower()}" not in frames:
            raise ValueError(f"unknown table {name!r}")
        if not alias.isidentifier() or alias.lower() in used:
            raise ValueError(f"not a new name for a table: {alias!r}")
        used[alias.lower()] = frames[f"table_{name.lower()}"]
        return f"{{{alias.lower()}}} `{alias}`"

    source, kept = ["FROM " + table(spec["from"])], []
    # a star would show the columns that deal hot keys
    whole_rows = any(_STAR.search(_COUNT.sub("", _QUOTED.sub("", x))) for x in spec["select"])
    for at, (ref, condition, *how) in enumerate(spec.get("joins", ())):
        kind = " ".join(how).upper() or "INNER"
        if kind not in JOINS:
            raise ValueError(f"join type {kind!r} is not supported; use one of {JOINS}")
        before = set(used)
        named, on = table(ref), _sql(spark, condition)
        (new,) = set(used) - before
        equal = _EQUAL.fullmatch(condition)
        if kind.startswith(("LEFT", "RIGHT")) and not kind.endswith(("SEMI", "ANTI")) and equal and not whole_rows:
            sides = {equal[1].lower(): equal[2], equal[3].lower(): equal[4]}
            old = next((a for a in sides if a in before), None)
            # a right join preserves the new table; only then may the joined ones hold a single table
            if old and new in sides and (kind.startswith("LEFT") or len(before) == 1):
                kept_side, other = (old, new) if kind.startswith("LEFT") else (new, old)
                used[kept_side], used[other] = deal_hot_keys(used[kept_side], sides[kept_side], used[other], sides[other], f"_{at}")
                on = f"{on} AND `{kept_side}`.__salt_{at} = `{other}`.__salt_{at}"
                kept.append(f"(`{other}`.__there_{at} IS NOT NULL OR NOT coalesce(`{kept_side}`.__hot_{at}, false))")
        source.append(f"{kind} JOIN {named} ON {on}")
    lines = ["SELECT " + ", ".join(_sql(spark, x) for x in spec["select"]), *source]
    for word, clause, between in (("WHERE", "where", " AND "), ("GROUP BY", "group_by", ", "), ("HAVING", "having", " AND "), ("ORDER BY", "order_by", ", ")):
        items = [_sql(spark, x, "order" if clause == "order_by" else clause) for x in spec.get(clause, ())]
        items = [f"({x})" if between == " AND " else x for x in items] + (kept if clause == "where" else [])
        if items:
            lines.append(f"{word} " + between.join(items))
    if spec.get("limit") is not None:
        lines.append(f"LIMIT {int(spec['limit'])}")
    return spark.sql("\n".join(lines), args=dict(params) if params else None, **used)
