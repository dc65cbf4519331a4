"""Data preparation: recode, fill, rank, sort, select, clean, normalise, encode, split, merge, transpose, validate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NOMINAL, ROW, SCALE, blank, measure_of, num, text, unique_name, with_row, table
from ..functions.dist import norm_inv
from ..functions.expr import compile_expression
from .describe import quantiles
from .running import running_sums


def compute(df: DataFrame, name: str, expression: str) -> DataFrame:
    """df with the expression's value as a new column of a free name, to twelve significant digits."""
    c = compile_expression(expression, df.columns)
    digits = F.lit(11) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), digits)
    rounded = F.when((c == 0) | (F.abs(c) < 1e-290) | (F.abs(c) > 1e290), c).otherwise(F.rint(c * scale) / scale)
    return df.withColumn(unique_name(name, df.columns), rounded)


def recode(df: DataFrame, col: str, rules: Sequence[tuple[float | None, float | None, float | None]], other: float | None | str = "keep") -> DataFrame:
    """First rule (low, high, value) whose range holds a value, ends included within 1e-12 and open if None; missing stays
    missing; what no rule holds stays as it is, or becomes `other`."""
    v = num(df, col)
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    for low, high, to in rules:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (v >= low - 1e-12)
        if high is not None:
            ok = ok & (v <= high + 1e-12)
        out = out.when(ok, F.lit(to).cast("double"))
    return df.withColumn(col, out.otherwise(v if other == "keep" else F.lit(other).cast("double")))


def fill(df: DataFrame, col: str, how: str, value: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Missing values by the mean, median, mode, a constant, or by row order: previous, next, linear (ends carried).

    For row order, each block of a thousand rows is filled by itself, and a table of one row per block carries the last and
    first values across blocks, so no task sees all rows."""
    v = num(df, col)
    if how in ("mean", "median"):
        m = df.select(v.alias("v"))
        m = m.agg(F.avg("v").alias("_m")) if how == "mean" else quantiles(m, "v", (0.5,), definition="type7", names=["_m"])
        return df.crossJoin(F.broadcast(m)).withColumn(col, F.coalesce(v, F.col("_m"))).drop("_m")  # one row
    if how == "constant":
        return df.withColumn(col, F.coalesce(v, F.lit(value)))
    if how == "mode":
        m = df.select(text(F.col(col)).alias("t")).dropna().groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("t", F.struct(-F.col("n"), "t")).alias("_m"))
        return df.crossJoin(F.broadcast(m)).withColumn(col, F.coalesce(text(F.col(col)), F.col("_m")).cast(df.schema[col].dataType)).drop("_m")  # one row
    r = with_row(df, list(order)).withColumn("_b", F.floor(F.col(ROW) / 1000)).withColumn("_p", F.when(v.isNotNull(), F.struct(F.col(ROW).alias("r"), v.alias("v"))))
    back = Window.partitionBy("_b").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_b").orderBy(ROW).rowsBetween(0, Window.unboundedFollowing)
    ends = r.groupBy("_b").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col(ROW))).alias("hi"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col(ROW))).alias("lo"))
    all_ = Window.orderBy("_b")  # a row per block
    ends = ends.select("_b", F.last("hi", True).over(all_.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("lo", True).over(all_.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    j = r.join(ends, "_b").withColumns({"_prev": F.coalesce(F.last("_p", True).over(back), F.col("_before")), "_next": F.coalesce(F.first("_p", True).over(ahead), F.col("_after"))})
    p, q = F.col("_prev"), F.col("_next")
    between = p["v"] + (q["v"] - p["v"]) * (F.col(ROW) - p["r"]) / F.nullif(q["r"] - p["r"], F.lit(0))
    new = {"previous": p["v"], "next": q["v"], "linear": F.coalesce(between, p["v"], q["v"])}[how]
    return j.withColumn(col, F.coalesce(v, new)).drop("_b", "_p", "_before", "_after", "_prev", "_next")


def fill_blanks(df: DataFrame, cols: Sequence[str], how: str = "mean", value: str | None = None) -> DataFrame:
    """Mean and median for scale columns only; the mode is the most frequent value, the smallest of several."""
    for c in cols:
        if how in ("mean", "median"):
            df = fill(df, c, how) if measure_of(df, c) == SCALE else df
        elif how == "mode":
            df = fill(df, c, "mode")
        else:
            df = df.withColumn(c, F.when(blank(F.col(c)), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def drop_blank_rows(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    cells = [blank(F.col(c)) for c in cols]
    return df.where(~reduce(lambda a, b: (a | b) if how == "any" else (a & b), cells))


def drop_duplicates(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row, in the given order, of those equal as text in all columns (blank and missing are equal)."""
    cols = [c for c in df.columns if c not in order]
    keys = [F.coalesce(text(F.col(c)), F.lit("")) for c in cols]
    first = df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def count_duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*(F.coalesce(text(F.col(c)), F.lit("")).alias(c) for c in cols)).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def outliers(df: DataFrame, col: str, action: str = "drop") -> DataFrame:
    """Values beyond 1.5 interquartile ranges of the type-7 quartiles: rows dropped, or values clamped. Four values at least."""
    v = num(df, col)
    f = quantiles(df.select(v.alias("v")), "v", (0.25, 0.75), definition="type7", names=("a", "b")).crossJoin(df.agg(F.count(v).alias("n")))  # one row each
    f = f.select(F.when(F.col("n") >= 4, F.col("a") - 1.5 * (F.col("b") - F.col("a"))).alias("_lo"), F.when(F.col("n") >= 4, F.col("b") + 1.5 * (F.col("b") - F.col("a"))).alias("_hi"))
    j = df.crossJoin(F.broadcast(f))  # one row
    if action == "drop":
        return j.where(F.coalesce(v.between(F.col("_lo"), F.col("_hi")), F.lit(True))).drop("_lo", "_hi")
    return j.withColumn(col, F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def normalise(df: DataFrame, col: str, how: str = "zscore", reference: Column | None = None, replace: bool = False) -> DataFrame:
    """Min-max or z-scores by the population deviation, from the reference rows if given; a constant gives 0."""
    v = num(df, col)
    s = (df if reference is None else df.where(reference)).select(v.alias("v")).agg(F.min("v").alias("_a"), F.max("v").alias("_b"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    a, width = (F.col("_a"), F.col("_b") - F.col("_a")) if how == "minmax" else (F.col("_m"), F.col("_s"))
    name = col if replace else unique_name(f"{col}_{'minmax' if how == 'minmax' else 'z'}", df.columns)
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.when(v.isNotNull(), F.when(width > 0, (v - a) / width).otherwise(0.0))).drop("_a", "_b", "_m", "_s")  # one row


def categories(df: DataFrame, col: str, order: Sequence[str], most: int = 1000) -> list[str]:
    """A column's categories by first appearance; more than `most` are an error, as each becomes a column or a code."""
    rows = df.select(text(F.col(col)).alias("t"), F.struct(*order).alias("o")).where("t IS NOT NULL").groupBy("t").agg(F.min("o").alias("o")).orderBy("o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} categories")
    return [r.t for r in rows]


def one_hot(df: DataFrame, col: str, order: Sequence[str], drop: bool = False) -> DataFrame:
    """A column of 0 and 1 per category in the order of first appearance; blank gives 0 everywhere."""
    cats, t = categories(df, col, order), text(F.col(col))
    taken, new = list(df.columns), []
    for c in cats:
        n = unique_name(f"{col}_{c}", taken)
        taken.append(n)
        new.append(F.coalesce((t == c).cast("int"), F.lit(0)).alias(n))
    return df.select(*(c for c in df.columns if not (drop and c == col)), *new)


def label_encode(df: DataFrame, col: str, order: Sequence[str], drop: bool = False) -> DataFrame:
    """Codes 1, 2, ... by first appearance; blank is missing."""
    code, t = F.lit(None).cast("int"), text(F.col(col))
    for i, c in enumerate(categories(df, col, order), 1):
        code = F.when(t == c, i).otherwise(code)
    out = df.withColumn(unique_name(f"{col}_code", df.columns), code)
    return out.drop(col) if drop else out


def split(df: DataFrame, share: float = 0.7, seed: int = 42, name: str = "role", key: Sequence[str] = ()) -> DataFrame:
    """Roles train and test with exact sizes, by the order of a seeded hash of the key (all columns without one). The
    cut is found from counts of hash ranges, not by sorting all rows in one place."""
    share = min(0.99, max(0.01, share))
    h = F.xxhash64(F.lit(seed), *(key or df.columns))
    r = df.withColumn("_h", h)
    n = r.count()
    k = math.floor(share * n + 0.5)
    # buckets of the top 16 bits, then the hashes of one bucket
    counts = r.groupBy(F.shiftright("_h", 48).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.sum("n").over(Window.orderBy("b")))
    at = counts.where(F.col("c") >= k).orderBy("b").limit(1).collect()
    if not at:
        return r.drop("_h").withColumn(name, F.lit("train"))
    need, b = k - (at[0].c - at[0].n), at[0].b
    w = Window.partitionBy(F.shiftright("_h", 48)).orderBy("_h", *df.columns)
    place = F.when(F.shiftright("_h", 48) == b, F.row_number().over(w))
    return r.withColumn(name, F.when((F.shiftright("_h", 48) < b) | (place <= need), "train").otherwise("test")).drop("_h")


def reorder(df: DataFrame, how: str = "name") -> DataFrame:
    """Columns by name, by name descending, by measure then name, or reversed."""
    cols = {"name": sorted(df.columns, key=str.lower), "name_desc": sorted(df.columns, key=str.lower, reverse=True), "measure": sorted(df.columns, key=lambda c: ((SCALE, "ordinal", NOMINAL).index(measure_of(df, c)), c.lower())), "reverse": df.columns[::-1]}[how]
    return df.select(*cols)


def append_rows(df: DataFrame, n: int) -> DataFrame:
    empty = df.sparkSession.range(n).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
    return df.unionByName(empty)


def set_cell(df: DataFrame, row: int, col: str, value) -> DataFrame:
    """One cell by row number; the table needs _rid (with_row)."""
    return df.withColumn(col, F.when(F.col(ROW) == row, F.lit(value).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def add_column(df: DataFrame, name: str, value=None) -> DataFrame:
    return df.withColumn(unique_name(name, df.columns), F.lit(value).cast("string") if value is None else F.lit(value))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """df without the column; the last one stays."""
    return df.drop(name) if len(df.columns) > 1 else df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """df as it is if the new name is taken."""
    clash = new.lower() in (c.lower() for c in df.columns if c.lower() != old.lower())
    return df if clash or not new.strip() else df.withColumnRenamed(old, new.strip())


def empty_dataset(spark, rows: int = 20, cols: int = 3) -> DataFrame:
    return spark.range(rows).select(*(F.lit(None).cast("double").alias(f"V{i + 1}") for i in range(cols)))


def transpose(df: DataFrame, cols: Sequence[str], order: Sequence[str], rows: int = 50) -> DataFrame:
    """The first rows as columns Case1, Case2, ...: a preview of the table on its side."""
    top = df.orderBy(*order).limit(rows).select(*(F.col(c).cast("string").alias(c) for c in cols)).collect()
    kind = "variable string, " + ", ".join(f"Case{i + 1} string" for i in range(len(top)))
    return table(df.sparkSession, [(c, *(r[c] for r in top)) for c in cols], kind.rstrip(", "))


def rank_cases(df: DataFrame, col: str, kind: str = "rank", ties: str = "mean", descending: bool = False, groups: int = 4, name: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """rank, fraction, percent, normal (Blom) or ntile = min(k, ceil(k r / n)); ties mean, low, high or sequential. Missing
    stays missing. Ranks come from distinct values with counts; sequential ones number a value's rows in order."""
    v = num(df, col)
    r = df.withColumn("_v", v)
    c = r.where("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    c = running_sums(c, "_v", {"_hi": "_c"}, descending=descending, totals={"_n": "_hi"})
    low = F.col("_hi") - F.col("_c") + 1
    if ties == "sequential":
        r = r.withColumn("_s", F.row_number().over(Window.partitionBy("_v").orderBy(*(F.desc(o) if descending else F.asc(o) for o in order))))
    base = {"mean": (low + F.col("_hi")) / 2, "low": low, "high": F.col("_hi"), "sequential": low - 1 + F.col("_s") if ties == "sequential" else low}[ties].cast("double")
    n = F.col("_n").cast("double")
    out = {"rank": base, "fraction": base / n, "percent": 100 * base / n, "ntile": F.least(F.lit(groups), F.ceil(groups * base / n)).cast("double")}
    if kind == "normal":
        inv = F.pandas_udf(lambda p: p.map(norm_inv), "double")
        value = inv((base - 0.375) / (n + 0.25))
    else:
        value = out[kind]
    j = r.join(c, "_v", "left")
    return j.withColumn(name or unique_name(f"{col}_{kind}", df.columns), F.when(F.col("_v").isNotNull(), value)).drop("_v", "_c", "_hi", "_n", "_s")


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """By (column, descending) keys: numbers for scale columns, else text in any case; blank ones last in both directions."""
    by: list[Column] = []
    for c, down in keys:
        k = num(df, c) if measure_of(df, c) == SCALE else F.lower(text(F.col(c)))
        by.append(k.desc_nulls_last() if down else k.asc_nulls_last())
    return df.orderBy(*by, *([ROW] if ROW in df.columns else []))


def select_cases(df: DataFrame, conditions: Sequence[tuple[str, str, object]], mode: str = "all", keep_if_empty: bool = True) -> DataFrame:
    """Rows for which all or any of (column, operator, value) hold. A blank cell fails always; text is compared in any
    case; unknown columns are passed over. If no row passes, all stay (keep_if_empty)."""
    known = {c.lower(): c for c in df.columns}
    tests = []
    for c, op, value in conditions:
        if c.lower() not in known:
            continue
        c = known[c.lower()]
        try:
            number = float(value)
        except (TypeError, ValueError):
            number = None
        if measure_of(df, c) == SCALE and number is not None:
            v = num(df, c)
            t = {"==": F.abs(v - number) <= 1e-12, "!=": F.abs(v - number) > 1e-12, ">": v > number, ">=": v >= number, "<": v < number, "<=": v <= number}[op]
        else:
            v, o = F.lower(text(F.col(c))), F.lit(str(value).lower())
            t = {"==": v == o, "!=": v != o, ">": v > o, ">=": v >= o, "<": v < o, "<=": v <= o}[op]
        tests.append(F.coalesce(t, F.lit(False)))
    if not tests:
        return df
    out = df.where(reduce(lambda a, b: (a & b) if mode == "all" else (a | b), tests))
    return df if keep_if_empty and not out.limit(1).count() else out


def merge_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name in any case; missing ones are null."""
    names = {c.lower(): c for c in a.columns}
    b = b.select(*(F.col(c).alias(names.get(c.lower(), c)) for c in b.columns))
    for c in set(a.columns) & set(b.columns):
        if a.schema[c].dataType != b.schema[c].dataType:
            a, b = a.withColumn(c, F.col(c).cast("string")), b.withColumn(c, F.col(c).cast("string"))
    return a.unionByName(b, allowMissingColumns=True)


def merge_variables(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Side by side by row number, to the longer one's length; clashing names get _2."""
    taken, new = list(a.columns), []
    for c in b.columns:
        n = unique_name(c, taken)
        taken.append(n)
        new.append(n)
    right = with_row(b, list(order_b))
    right = right.select(F.col(ROW), *(F.col(c).alias(n) for c, n in zip(b.columns, new)))
    return with_row(a, list(order_a)).join(right, ROW, "full").select(*a.columns, *new)


def validate(df: DataFrame, rules: Sequence[dict], order: Sequence[str]) -> DataFrame:
    """Violations (row from 1, variable, kind, value) of rules {column, min, max}, {column, values} or {column, key: True}.
    Kinds: missing, format, range, level, duplicate."""
    r = with_row(df, list(order))
    found = []
    for rule in rules:
        c = rule["column"]
        t = text(F.col(c))
        kind = F.when(t.isNull(), "missing")
        if rule.get("key"):
            many = r.select(t.alias("_k")).dropna().groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            found.append(r.where(t.isNull()).select((F.col(ROW) + 1).alias("row"), F.lit(c).alias("variable"), F.lit("missing").alias("kind"), t.alias("value")))
            found.append(r.join(many, t == F.col("_k")).select((F.col(ROW) + 1).alias("row"), F.lit(c).alias("variable"), F.lit("duplicate").alias("kind"), t.alias("value")))
            continue
        if "values" in rule:
            kind = kind.when(~t.isin([str(v) for v in rule["values"]]), "level")
        else:
            v = num(df, c)
            kind = kind.when(v.isNull(), "format").when((v < rule.get("min", -math.inf)) | (v > rule.get("max", math.inf)), "range")
        found.append(r.select((F.col(ROW) + 1).alias("row"), F.lit(c).alias("variable"), kind.alias("kind"), t.alias("value")).where("kind IS NOT NULL"))
    return reduce(DataFrame.unionByName, found)
