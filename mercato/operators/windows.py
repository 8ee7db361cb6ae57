"""Ordered numbering over a whole table without funnelling it through one task.

``rank()`` / ``row_number()`` / ``ntile()`` windows without PARTITION BY make Spark move every row to a
single partition (``Exchange SinglePartition``). The functions here cut the order into ranges instead, and
carry what lies before a range with a prefix scan over one small entry per range:

0. The input is checkpointed once (reliably, in the shared folder): the passes below read the same rows, also
   after a lost executor, and nothing above the input runs twice.
1. *bounds*: a sample of about SAMPLE rows a range, chosen by a hash of the whole row, gives the bounds. They
   are order keys plus that hash, so a value held by a third of all rows is cut into many ranges.
2. *summary*: per range the rows, and those of them before the key of the range's upper bound (two counts,
   combined map-side, for all numberings in one pass); their prefix sums say where each range begins, and
   where a key begins that goes on from an earlier range.
3. *rows* (lazy): numbered inside their range by a window, plus the range's offset. A row whose key is that of
   its range's lower bound takes the rank carried from where the key began: no join on the value.

The driver holds the sample and the summary: SAMPLE and one rows a range, whatever the table holds. The same
path is taken at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType

from mercato.operators.joins import has_at_most
from mercato.session import ensure_checkpoint_dir

_TIE = "__mc_tie"
_RANGE = "__mc_range"
_SAME = "__mc_same"
_AT = "__mc_at"
_BOUNDS = "__mc_bounds"

#: sampled rows for each range
SAMPLE = 32


@dataclass(frozen=True)
class Numbering:
    """A column ``name`` over the order ``order_by`` (asc: nulls first, desc: nulls last, as in Spark): the
    ``rank`` (ties equal, gaps), the ``row_number``, or with ``buckets`` the ``ntile``."""

    name: str
    order_by: Sequence[str] | str
    ascending: bool | Sequence[bool] = True
    kind: str = "rank"
    buckets: int = 0

    @property
    def order(self) -> list[tuple[str, bool]]:
        names, flags = _as_list(self.order_by), _as_list(self.ascending)
        flags = flags * len(names) if len(flags) == 1 else flags
        if len(flags) != len(names):
            raise ValueError("ascending must be one flag or one flag per order column")
        return list(zip(names, flags))


def _tie_break(df: DataFrame) -> Column:
    """A deterministic hash of the whole row: equal sort keys get a fixed, reproducible order."""
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashable]) if hashable else F.lit(0).cast("long")


def _as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def _sort_cols(order_by: Sequence[str], ascending: bool | Sequence[bool]) -> list[Column]:
    return [F.col(c).asc() if a else F.col(c).desc() for c, a in Numbering("", order_by, ascending).order]


def _key_before(x: str, y: str, ascending: list[bool], last: str) -> str:
    """SQL: whether the keys of struct ``x`` come before those of ``y``, nulls as Spark sorts them; ``last``
    decides between equal keys."""
    out = last
    for i in reversed(range(len(ascending))):
        a, b = f"{x}.k{i}", f"{y}.k{i}"
        first, sign = (a, "<") if ascending[i] else (b, ">")
        nulls = f"{first} IS NULL AND {b if ascending[i] else a} IS NOT NULL"
        out = f"({nulls} OR coalesce({a} {sign} {b}, false) OR {a} <=> {b} AND {out})"
    return out


def _same_key(x: str, y: str, ascending: list[bool]) -> str:
    return " AND ".join(f"{x}.k{i} <=> {y}.k{i}" for i in range(len(ascending)))


def _compare(ascending: list[bool]):
    """Order of sampled (keys, hash) on the driver, as Spark's: nulls before all, NaN after all numbers."""

    def level(v) -> tuple:
        return (0,) if v is None else (2,) if isinstance(v, float) and v != v else (1, v)

    def compare(x, y) -> int:
        for a, b, up in zip(x[0], y[0], ascending):
            a, b = level(a), level(b)
            if a != b:
                return (-1 if a < b else 1) * (1 if up else -1)
        return (x[1] > y[1]) - (x[1] < y[1])

    return cmp_to_key(compare)


def _bounds(sample: list, ascending: list[bool], ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` of the sampled (keys, hash), ascending, equally far apart."""
    rows = sorted(sample, key=_compare(ascending))
    return [rows[at] for at in sorted({len(rows) * r // ranges for r in range(1, ranges)}) if 0 < at < len(rows)]


def _same(x: tuple, y: tuple) -> bool:
    return all(a == b or (a != a and b != b) for a, b in zip(x, y))


def _array(keyed: DataFrame, bounds: list[tuple]) -> Column:
    """The bounds as an array of structs k0, k1, ..., hash."""
    kinds = [f.dataType for f in keyed.schema["__mc_key"].dataType.fields]
    kind = StructType([StructField(f"k{i}", k) for i, k in enumerate(kinds)] + [StructField(_TIE, LongType())])
    one = StructType([StructField(_BOUNDS, ArrayType(kind))])
    return keyed.sparkSession.createDataFrame([([(*key, tie) for key, tie in bounds],)], one).scalar()


def _range_of(ascending: list[bool], ranges: int) -> Column:
    """How many of the bounds aren't after the row: its range, by binary search."""
    steps = ", ".join(str(1 << k) for k in reversed(range(max(1, (ranges - 1).bit_length()))))
    bound = f"get({_BOUNDS}, at + size - 1)"
    after = _key_before("__mc_key", bound, ascending, f"{_TIE} < {bound}.{_TIE}")
    return F.expr(f"aggregate(array({steps}), 0, (at, size) -> CASE WHEN {bound} IS NOT NULL AND NOT {after} THEN at + size ELSE at END)")


def _ranged(keyed: DataFrame, array: Column, ascending: list[bool], ranges: int) -> DataFrame:
    """``keyed`` with the bounds and the range of each row."""
    return keyed.withColumn(_BOUNDS, array).withColumn(_RANGE, _range_of(ascending, ranges))


def _prefix(counts: dict[int, tuple[int, int]], bounds: list[tuple]) -> list[tuple[int, int, int]]:
    """Of each range: its number, the rows before it, and the rank of its lower bound's key."""
    out, base, begun = [], 0, 0
    for r in range(len(bounds) + 1):
        out.append((r, base, begun))
        rows, below = counts.get(r, (0, 0))
        if r < len(bounds) and (r == 0 or not _same(bounds[r][0], bounds[r - 1][0])):
            begun = base + below + 1  # the upper bound's key begins in this range, or at its end
        base += rows
    return out


def _ntile(at: Column, rows: Column, buckets: int) -> Column:
    """Row ``at`` of ``rows`` with q = rows div k and m = rows mod k: the first m buckets hold q + 1 rows."""
    k = F.lit(buckets).cast("long")
    q = F.floor(rows / k).cast("long")
    m = rows - q * k
    big = m * (q + 1)  # rows in the larger buckets

    def up(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b).cast("long")

    return F.when(at <= big, up(at, q + 1)).otherwise(m + up(at - big, q))


def numbered(df: DataFrame, *numberings: Numbering, num_partitions: int | None = None) -> DataFrame:
    """``df`` with a LongType column for each of ``numberings``, each over the whole table.

    Rows equal on every order column are numbered in a deterministic (hash) order by row_number and ntile;
    add a unique column for a fully specified one. Rows identical in every column stay in one range.
    ``num_partitions``: how many ranges the order is cut into (default: ``spark.sql.shuffle.partitions``).
    """
    ranges = max(1, int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for n in numberings:
        if n.kind not in ("rank", "row_number", "ntile") or (n.kind == "ntile" and n.buckets <= 0):
            raise ValueError("kind must be rank, row_number or ntile with a positive number of buckets")
    ensure_checkpoint_dir(df.sparkSession)
    base = df.withColumn(_TIE, _tie_break(df)).checkpoint(eager=True)
    rows = base.count()
    keys = [F.struct(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(n.order)]) for n in numberings]
    orders = [[a for _, a in n.order] for n in numberings]
    # about SAMPLE rows a range; rows that are the same in every column count once
    sampled = base.where(F.pmod(F.col(_TIE), F.lit(max(1, rows // (SAMPLE * ranges)))) == 0)
    sample = sampled.select(_TIE, *[k.alias(f"s{i}") for i, k in enumerate(keys)]).distinct().collect()
    bounds = [_bounds([(tuple(r[f"s{i}"]), r[_TIE]) for r in sample], up, ranges) for i, up in enumerate(orders)]
    arrays = [_array(base.select(k.alias("__mc_key")), b) for k, b in zip(keys, bounds)]

    def summary(i: int) -> DataFrame:
        placed = _ranged(base.select(_TIE, keys[i].alias("__mc_key")), arrays[i], orders[i], ranges)
        upper = f"get({_BOUNDS}, {_RANGE})"
        return placed.selectExpr(f"{i} AS i", _RANGE, f"{upper} IS NOT NULL AND {_key_before('__mc_key', upper, orders[i], 'false')} AS below")

    counts: list[dict] = [{} for _ in numberings]
    parts = reduce(DataFrame.unionByName, map(summary, range(len(numberings))))
    for r in parts.groupBy("i", _RANGE).agg(F.count(F.lit(1)).alias("rows"), F.count_if("below").alias("below")).collect():  # a row a range
        counts[r["i"]][r[_RANGE]] = r["rows"], r["below"]

    out = base
    for i, n in enumerate(numberings):
        ranged = _ranged(out.withColumn("__mc_key", keys[i]), arrays[i], orders[i], ranges)
        lower = f"get({_BOUNDS}, {_RANGE} - 1)"
        same = F.expr(f"{lower} IS NOT NULL AND {_same_key('__mc_key', lower, orders[i])}")
        ranged = ranged.withColumn(_SAME, same).drop(_BOUNDS, "__mc_key")
        inside = Window.partitionBy(_RANGE).orderBy(*_sort_cols(n.order_by, n.ascending), *[F.col(_TIE)] * (n.kind != "rank"))
        placed = ranged.withColumn(_AT, (F.rank() if n.kind == "rank" else F.row_number()).over(inside))
        prefix = df.sparkSession.createDataFrame(_prefix(counts[i], bounds[i]), "__mc_r int, __mc_base long, __mc_begun long")
        # a row per range: the broadcast is bounded by the number of ranges
        placed = placed.join(F.broadcast(prefix), F.col(_RANGE) == F.col("__mc_r"))
        number = F.col("__mc_base") + F.col(_AT)
        if n.kind == "rank":
            number = F.when(F.col(_SAME), F.col("__mc_begun")).otherwise(number)
        elif n.kind == "ntile":
            number = _ntile(number, F.lit(rows).cast("long"), n.buckets)
        out = placed.withColumn(n.name, number.cast("long")).drop(_RANGE, _SAME, _AT, "__mc_r", "__mc_base", "__mc_begun")
    return out.drop(_TIE)


def global_row_number(
    df: DataFrame, order_by: Sequence[str] | str, ascending: bool | Sequence[bool] = True, name: str = "row_number", num_partitions: int | None = None
) -> DataFrame:
    """``row_number() OVER (ORDER BY order_by)`` as a LongType column ``name``; see :func:`numbered`."""
    return numbered(df, Numbering(name, order_by, ascending, "row_number"), num_partitions=num_partitions)


def global_ntile(
    df: DataFrame, buckets: int, order_by: Sequence[str] | str, ascending: bool | Sequence[bool] = True, name: str = "ntile", num_partitions: int | None = None
) -> DataFrame:
    """``ntile(buckets) OVER (ORDER BY order_by)`` as a LongType column ``name``; see :func:`numbered`."""
    return numbered(df, Numbering(name, order_by, ascending, "ntile", buckets), num_partitions=num_partitions)


def global_rank(
    df: DataFrame, order_by: Sequence[str] | str, ascending: bool | Sequence[bool] = True, name: str = "rank", num_partitions: int | None = None
) -> DataFrame:
    """``rank() OVER (ORDER BY order_by)`` as a LongType column ``name``; see :func:`numbered`."""
    return numbered(df, Numbering(name, order_by, ascending, "rank"), num_partitions=num_partitions)


def sequence_ids(
    df: DataFrame,
    order_by: Sequence[str] | str,
    name: str,
    ascending: bool | Sequence[bool] = True,
    small_rows: int = 100_000,
) -> DataFrame:
    """Number the rows 1..n in ``order_by`` order (dimension surrogate keys).

    When ``df`` is proven to hold at most ``small_rows`` rows, a plain window does it; the result is
    cached (a lost block recomputes to the same rows: the order is total on distinct keys) and
    carries a broadcast hint (its size is proven). Otherwise :func:`global_row_number`.
    """
    if has_at_most(df, small_rows):
        w = Window.orderBy(*_sort_cols(order_by, ascending))
        return F.broadcast(df.withColumn(name, F.row_number().over(w).cast("long")).cache())
    return global_row_number(df, order_by, ascending, name)


def top_n_per_group(
    df: DataFrame,
    group_by: Sequence[str] | str,
    order_by: Sequence[str] | str,
    n: int,
    ascending: bool | Sequence[bool] = False,
    name: str = "rank",
) -> DataFrame:
    """Rows whose ``rank()`` inside their group is at most ``n`` (ties kept).

    Spark plans this as a partial ``WindowGroupLimit`` before the shuffle and a final one after it,
    so each map task ships at most ``n`` rows (plus ties) per group: few groups do not mean few
    busy tasks.
    """
    w = Window.partitionBy(*_as_list(group_by)).orderBy(*_sort_cols(order_by, ascending))
    return df.withColumn(name, F.rank().over(w)).filter(F.col(name) <= n)
