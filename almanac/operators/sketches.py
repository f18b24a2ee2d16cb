"""A1-A3 approximate: distinct counts of the dashboard from sketches kept per day.

A day's rows become one small row: how many there are and, for each counted
column, a HyperLogLog sketch of its values.  Days are appended as they come (a
day may come in several parts), and any set of days is answered by merging its
rows, without reading a record again.  Both steps are partial aggregates of
sketches of at most some kilobytes, so a hot day or value ships one row a task.

NULL is no value, and with ``blank=False`` neither is an empty text.  A day of
NULL values only counts as no value; rows without a day are one group of their
own.  No rows at all give zero counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: 4,096 of them, some 2 to 4 kB.
REGISTERS = 12


def error_bound(registers: int = REGISTERS, deviations: float = 4.0) -> float:
    """The share by which an estimate may be off: ``deviations`` standard
    errors of a HyperLogLog union (1.04 / sqrt(number of registers))."""
    return deviations * 1.04 / math.sqrt(1 << registers)


def _values(column: str, blank: bool) -> Column:
    text = F.col(f"`{column}`").cast("string")
    # A sketch leaves out empty texts, so each is given a first letter.
    return F.concat(F.lit("="), text if blank else F.nullif(text, F.lit("")))


def day_sketches(records: DataFrame, day: str, names: dict[str, str], blank: bool = True,
                 registers: int = REGISTERS) -> DataFrame:
    """(day, n_rows, one sketch a name): ``names`` maps an output name to the
    column whose different values it counts."""
    on = F.to_date(F.col(f"`{day}`")).alias("day")
    return records.groupBy(on).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.hll_sketch_agg(_values(c, blank), registers).alias(name) for name, c in names.items()])


def merged_counts(sketches: DataFrame, names: list[str], by: dict[str, Column] | None = None) -> DataFrame:
    """``n_rows`` and the estimated distinct counts for each group of days in
    ``by`` (name -> expression over ``day``), or over all days."""
    keys = [c.alias(name) for name, c in (by or {}).items()]
    return sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0).cast("long")).alias("n_rows"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(n, F.lit(True))), F.lit(0).cast("long")).alias(n) for n in names])


def within_bound(estimate, exact, registers: int = REGISTERS) -> Column:
    """Whether an estimate is as near to the exact count as the sketch promises."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * error_bound(registers))
