"""Running sums over sorted values without a task that sees all of them: ranges of values are summed, and their offsets added."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a key's 63 bits, those below a fine range and those between it and a coarse one: a coarse range has 2**20 fine ones at
#: most, there are 2**21 coarse ones at most, and a fine one has 2**24 different doubles at most.
FINE, COARSE = 23, 20


def order_bits(v: Column) -> Column:
    """A whole number that grows with a double: the exponent, then the digits, as the double itself keeps them."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    e = e - (F.pow(F.lit(2.0), e) > a).cast("long") + (F.pow(F.lit(2.0), e) * 2 <= a).cast("long")  # log2 may be off next to a power
    k = (e + 1075) * F.lit(1 << 51) + F.floor((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 51))
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -k).otherwise(k)


def running_sums(rows: DataFrame, order: str, sums: Mapping[str, str | Column], by: Sequence[str] = (), descending: bool = False, totals: Mapping[str, str] | None = None) -> DataFrame:
    """rows with, for each name and column of `sums`, the column's sum over the group's rows up to this one in `order` (each
    value of `order` is in one row of a group), and for each name of `totals` the whole group's sum of that name.

    Values are dealt to fine ranges by the leading bits of their order, whatever their distribution; a window sums within
    a fine range, one over fine ranges within a coarse one, one over coarse ranges within a group. Each has a bounded
    number of rows, so neither many distinct values nor one large group come together in a task. Rows whose order is
    null are not allowed; a null group is a group; an empty table gives an empty result."""
    keys, names = [f"_by{i}" for i in range(len(by))], list(sums)
    direction = F.desc if descending else F.asc
    bits = order_bits(F.col(order).cast("double"))
    parts = rows.withColumns({k: F.col(b) for k, b in zip(keys, by)} | {f"_x{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())}).withColumn("_fine", F.shiftright(bits, FINE))
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    within = upto(Window.partitionBy(*keys, "_fine").orderBy(direction(order)), 0)
    local = parts.withColumns({f"_x{i}": F.sum(f"_x{i}").over(within) for i in range(len(names))})

    fine = parts.groupBy(*keys, "_fine").agg(*(F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(names)))).withColumn("_coarse", F.shiftright("_fine", COARSE))
    coarse = fine.groupBy(*keys, "_coarse").agg(*(F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(names))))
    before = lambda c, w: F.coalesce(F.sum(c).over(upto(w, -1)), F.lit(0))
    fine = fine.withColumns({f"_s{i}": before(f"_s{i}", Window.partitionBy(*keys, "_coarse").orderBy(direction("_fine"))) for i in range(len(names))})
    groups = Window.partitionBy(*keys)  # of coarse ranges, 2**21 at most
    coarse = coarse.withColumns({f"_u{i}": before(f"_t{i}", groups.orderBy(direction("_coarse"))) for i in range(len(names))} | {f"_t{i}": F.sum(f"_t{i}").over(groups) for i in range(len(names))})

    def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"{c}r" for c in on})
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"{c}r")) if c in keys else F.col(c) == F.col(f"{c}r") for c in on]).drop(*(f"{c}r" for c in on))

    offsets = matched(fine, coarse, [*keys, "_coarse"]).drop("_coarse")
    out = matched(local, offsets, [*keys, "_fine"])
    places = {n: i for i, n in enumerate(names)}
    found = {n: F.col(f"_x{i}") + F.col(f"_s{i}") + F.col(f"_u{i}") for n, i in places.items()} | {t: F.col(f"_t{places[n]}") for t, n in (totals or {}).items()}
    return out.select(*(F.col(c) for c in rows.columns if c not in found), *(c.alias(n) for n, c in found.items()))
