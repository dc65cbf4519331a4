"""Descriptive statistics, tabulation, quality reports and chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ROW, blank, measure_of, num, numbers, parse_num, text, with_row, table
from ..functions.dist import chi2_upper, hypergeom_two_sided, t_inv
from .running import running_sums

DEFINITIONS = ("type6", "type7", "tukey")


def _by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df without the rows that miss a key; keys as text."""
    for k in keys:
        df = df.where(~blank(F.col(k)))
    return df


def ranked_counts(values: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: its count _c, the count up to it _cum, and the group's size _n."""
    counts = values.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    return running_sums(counts, col, {"_cum": "_c"}, by, totals={"_n": "_cum"})


def quantiles(values: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = (), definition: str = "type6", names: Sequence[str] | None = None) -> DataFrame:
    """Quantiles per group. type6: at place (n + 1) p, clamped; type7: at 1 + (n - 1) p; tukey: medians of the halves,
    the median in both if n is odd (for p of 1/4, 1/2, 3/4)."""
    n, names = F.col("_n"), names or [f"q{int(p * 100)}" for p in ps]

    def place(p: float) -> Column:
        if definition == "type7":
            return 1 + (n - 1) * p
        if definition == "tukey":
            half = (F.floor((n + 1) / 2) + 1) / 2
            return half if p < 0.5 else (n + 1) / 2 if p == 0.5 else n + 1 - half
        return F.least(F.greatest((n + 1) * p, F.lit(1.0)), n.cast("double"))

    c = ranked_counts(values, col, by)
    parts, out = [], []
    for i, p in enumerate(ps):
        h = place(p)
        c = c.withColumn(f"_lo{i}", F.floor(h)).withColumn(f"_fr{i}", h - F.floor(h))
        parts += [F.min(F.when(F.col("_cum") >= F.col(f"_lo{i}"), F.col(col))).alias(f"_a{i}"), F.min(F.when(F.col("_cum") >= F.col(f"_lo{i}") + F.when(F.col(f"_fr{i}") > 0, 1).otherwise(0), F.col(col))).alias(f"_b{i}"), F.max(f"_fr{i}").alias(f"_f{i}")]
        out.append((F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(names[i]))
    return c.groupBy(*by).agg(*parts).select(*by, *out)


def points(values: DataFrame, col: str, ps: Sequence[float]) -> list[float | None]:
    """A column's quantiles (type 7) as numbers, missing where it has no value."""
    return list(quantiles(values, col, ps, definition="type7", names=[f"p{i}" for i in range(len(ps))]).collect()[0])


def moments(c: str) -> list[Column]:
    """Aggregates of one column: n, mean, sd, variance, standard error, G1, G2, their errors, minimum and maximum."""
    n, g1, g2 = F.count(c).cast("double"), F.skewness(c), F.kurtosis(c)
    sk = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    ku = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6))
    se_sk = F.when(n > 2, F.sqrt(6 * n * (n - 1) / F.nullif((n - 2) * (n + 1) * (n + 3), F.lit(0.0))))
    var = F.when(n > 1, F.var_samp(c))
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), (F.sqrt(var) / F.sqrt(n)).alias("sem"), F.sqrt(var).alias("sd"), var.alias("variance"), sk.alias("skewness"), ku.alias("kurtosis"), se_sk.alias("se_skewness"), F.when(n > 3, 2 * se_sk * F.sqrt((n * n - 1) / F.nullif((n - 3) * (n + 5), F.lit(0.0)))).alias("se_kurtosis"), F.min(c).alias("min"), F.max(c).alias("max"), (F.when(n > 3, n / 6 * (g1 * g1 + g2 * g2 / 4))).alias("jarque_bera")]


def describe(df: DataFrame, cols: Sequence[str], definition: str = "type6", level: float = 0.95) -> DataFrame:
    """One row per variable, missing values left out variable by variable, with quartiles, a t interval and Jarque-Bera."""
    long = df.select(*(num(df, c).alias(c) for c in cols)).unpivot([], list(cols), "variable", "v").where("v IS NOT NULL")
    names = table(df.sparkSession, [(c,) for c in cols], "variable string")
    first = names.join(long.groupBy("variable").agg(*moments("v")), "variable", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = first.join(quantiles(long, "v", (0.25, 0.5, 0.75), ["variable"], definition, ("q1", "median", "q3")), "variable", "left")
    out = out.select(*(c for c in out.columns if c != "variable"), "variable")
    t = F.udf(lambda n: t_inv(0.5 + level / 2, n - 1) if n and n > 1 else None, "double")  # a call per variable
    out = out.withColumn("_t", t("n"))
    return out.withColumns({"ci_low": F.col("mean") - F.col("_t") * F.col("sem"), "ci_high": F.col("mean") + F.col("_t") * F.col("sem"), "cv_percent": F.when(F.col("mean") != 0, 100 * F.col("sd") / F.abs("mean")), "jarque_bera_p": F.exp(-F.col("jarque_bera") / 2)}).drop("_t")


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """Category, frequency, percent of all rows, percent of valid ones, cumulative valid percent; a row for missing ones.
    Categories in numeric order if all are numbers, else in text order."""
    counts = df.select(text(F.col(col)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("frequency"))
    all_, valid = Window.partitionBy(), F.when(F.col("category").isNotNull(), F.col("frequency"))
    number = parse_num(F.col("category"))
    numeric = F.min(F.when(F.col("category").isNotNull(), number.isNotNull().cast("int"))).over(all_) == 1
    c = counts.withColumns({"_k": F.when(numeric, number), "_total": F.sum("frequency").over(all_), "_valid": F.sum(valid).over(all_)})
    running = F.sum(valid).over(Window.orderBy(F.col("category").isNull(), "_k", "category").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("category", "frequency", (100 * F.col("frequency") / F.col("_total")).alias("percent"), (100 * valid / F.col("_valid")).alias("valid_percent"), F.when(F.col("category").isNotNull(), 100 * running / F.col("_valid")).alias("cumulative_percent"))


def medians(rows: DataFrame, by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """A row per group with each value's median under its new name, missing where a group has no value."""
    out = rows.select(*by).distinct()
    for v, name in values.items():
        q = quantiles(rows, v, (0.5,), by, "type7", [name]).withColumnsRenamed({b: f"_{b}" for b in by})
        out = out.join(q, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*(f"_{b}" for b in by))
    return out


def aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], stat: str = "mean") -> DataFrame:
    """mean, sum, n, min, max or median of values per group. Rows that miss a key are out; a group without a value
    gives missing, for n as well."""
    rows = _by(df, keys).select(*keys, *(num(df, v).alias(v) for v in values))
    if stat == "median":
        return medians(rows, keys, {v: f"{v}_median" for v in values})
    fn = {"mean": F.avg, "sum": F.sum, "n": F.count, "min": F.min, "max": F.max}[stat]
    return rows.groupBy(*keys).agg(*(F.when(F.count(v) > 0, fn(v)).alias(f"{v}_{stat}") for v in values))


def means(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """n, mean, sd and median of each value per group, and over all ("Total")."""
    rows = _by(df, [key]).select(text(F.col(key)).alias("group"), *(num(df, v).alias(v) for v in values))
    long = rows.unpivot("group", list(values), "variable", "value").where("value IS NOT NULL")
    both = long.withColumn("group", F.explode(F.array("group", F.lit("Total"))))
    first = both.groupBy("variable", "group").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return first.join(quantiles(both, "value", (0.5,), ["variable", "group"], "type7", ["median"]), ["variable", "group"]).select("variable", "group", "n", "mean", "sd", "median")


def explore(df: DataFrame, key: str, value: str, definition: str = "type6", shapiro: bool = True) -> DataFrame:
    """n, mean, median, sd, min, max, Q1, Q3 and a Shapiro-Wilk p per group and over all."""
    from .nonparam import shapiro_wilk

    rows = _by(df, [key]).select(text(F.col(key)).alias("group"), num(df, value).alias("v")).dropna()
    both = rows.withColumn("group", F.explode(F.array(F.col("group"), F.lit("Total"))))
    basic = both.groupBy("group").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = basic.join(quantiles(both, "v", (0.25, 0.5, 0.75), ["group"], definition, ("q1", "median", "q3")), "group")
    return out.join(shapiro_wilk(both, "v", ["group"]).select("group", F.col("p").alias("shapiro_p")), "group", "left") if shapiro else out


def ratio(df: DataFrame, numerator: str, denominator: str, key: str | None = None) -> DataFrame:
    """Statistics of the ratios y/x per group: mean, sd, min, max, median, weighted mean, AAD, COD, PRD, COV about the mean
    and the median. Rows with x of 0 are out."""
    rows = df if key is None else _by(df, [key])
    r = rows.select((text(F.col(key)) if key else F.lit("all")).alias("group"), num(df, numerator).alias("y"), num(df, denominator).alias("x")).dropna().where("abs(x) > 1e-12").withColumn("r", F.col("y") / F.col("x"))
    first = r.groupBy("group").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("r").alias("min"), F.max("r").alias("max"), (F.sum("y") / F.sum("x")).alias("weighted_mean"))
    first = first.join(quantiles(r, "r", (0.5,), ["group"], "type7", ["median"]), "group")
    dev = r.join(F.broadcast(first.select("group", F.col("median").alias("m"))) if key is None else first.select("group", F.col("median").alias("m")), "group").groupBy("group").agg(F.avg(F.abs(F.col("r") - F.col("m"))).alias("aad"), F.sqrt(F.sum(F.pow(F.col("r") - F.col("m"), 2)) / (F.count("r") - 1)).alias("_sm"))
    return first.join(dev, "group").select("group", "n", "mean", "sd", "min", "max", "median", "weighted_mean", "aad", (100 * F.col("aad") / F.col("median")).alias("cod"), (F.col("mean") / F.col("weighted_mean")).alias("prd"), (100 * F.col("sd") / F.col("mean")).alias("cov_mean"), (100 * F.col("_sm") / F.col("median")).alias("cov_median"))


def codebook(df: DataFrame) -> DataFrame:
    """Per variable: type, measure, valid and missing counts, minimum, maximum, mean; for others the number of categories."""
    cols, kinds = [c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct", "binary"))], dict(df.dtypes)
    scale = {c: measure_of(df, c) == "scale" for c in cols}
    aggs = []
    for c in cols:
        v, t = (num(df, c), text(F.col(c))) if scale[c] else (F.lit(None).cast("double"), text(F.col(c)))
        aggs.append(F.struct(F.lit(c).alias("variable"), F.lit(kinds[c]).alias("type"), F.lit(measure_of(df, c)).alias("measure"), F.count(t).alias("valid"), F.sum(t.isNull().cast("long")).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.lit(None).cast("long") if scale[c] else F.count_distinct(t)).alias("categories")).alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*cols)).alias("x")).select("x.*")


def first_categories(df: DataFrame, col: str, k: int = 6) -> DataFrame:
    """The k smallest categories of a column, for the codebook."""
    return df.select(text(F.col(col)).alias("category")).where("category IS NOT NULL").distinct().orderBy("category").limit(k)


def quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per variable: filled, blank, percent filled, distinct values, minimum, maximum, and outliers beyond the type-7 fences."""
    out = None
    for c in cols:
        scale = measure_of(df, c) == "scale"
        v = df.select(text(F.col(c)).alias("t"), (num(df, c) if scale else F.lit(None).cast("double")).alias("v"))
        q = quantiles(v, "v", (0.25, 0.75), definition="type7", names=("a", "b"))
        fence = v.agg(F.count("v").alias("nv")).crossJoin(q).select((F.col("a") - 1.5 * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + 1.5 * (F.col("b") - F.col("a"))).alias("hi"), "nv")  # one row each
        row = v.crossJoin(F.broadcast(fence)).agg(F.count("t").alias("filled"), F.sum(F.col("t").isNull().cast("long")).alias("blank"), F.count_distinct("t").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(((F.col("nv") >= 4) & ((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))).cast("long")).alias("outliers"))
        row = row.select(F.lit(c).alias("variable"), "filled", "blank", (100 * F.col("filled") / (F.col("filled") + F.col("blank"))).alias("percent_filled"), "distinct", "min", "max", F.coalesce("outliers", F.lit(0)).alias("outliers"))
        out = row if out is None else out.unionByName(row)
    return out


def table_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, complete rows, rows that repeat an earlier one, and blank cells."""
    keys = [F.coalesce(text(F.col(c)), F.lit("")).alias(c) for c in cols]
    groups = df.select(*keys).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    blanks = sum((F.when(F.col(c) == "", 1).otherwise(0) for c in cols), F.lit(0))
    return groups.agg(F.sum("_n").alias("rows"), F.sum(F.when(blanks == 0, F.col("_n")).otherwise(0)).alias("complete"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum(blanks * F.col("_n")).alias("blank_cells"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of the combinations with row, column and grand totals and the expected count; blank ones are out."""
    c = df.select(text(F.col(row)).alias("row"), text(F.col(col)).alias("col")).dropna().groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    r, k = c.groupBy("row").agg(F.sum("n").alias("row_total")), c.groupBy("col").agg(F.sum("n").alias("col_total"))
    grid = r.crossJoin(F.broadcast(k)).join(c, ["row", "col"], "left").fillna({"n": 0})  # levels by levels: the table itself
    return grid.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))


def association(df: DataFrame, row: str, col: str) -> DataFrame:
    """Chi-square, G-square, Cramer's V, the contingency coefficient, and Fisher's exact p of a 2 x 2 table."""
    spark, x = df.sparkSession, crosstab(df, row, col)
    s = x.agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("chi2"), F.sum(F.when(F.col("n") > 0, 2 * F.col("n") * F.log(F.col("n") / F.col("expected")))).alias("g2"), F.sum("n").alias("n"), F.count_distinct("row").alias("r"), F.count_distinct("col").alias("c"), F.min("expected").alias("least_expected")).collect()[0]
    kind = "chi2 double, df long, p double, g2 double, g2_p double, cramers_v double, contingency double, fisher_p double, least_expected double, n long"
    if not s.n or s.r < 2 or s.c < 2:
        return table(spark, [], kind)
    d, fisher = (s.r - 1) * (s.c - 1), None
    if s.r == s.c == 2:
        cells = [int(v.n) for v in x.orderBy("row", "col").collect()]
        fisher = hypergeom_two_sided(*cells)
    return table(spark, [(s.chi2, d, chi2_upper(s.chi2, d), s.g2, chi2_upper(s.g2, d), (s.chi2 / (s.n * (min(s.r, s.c) - 1))) ** 0.5, (s.chi2 / (s.chi2 + s.n)) ** 0.5, fisher, s.least_expected, s.n)], kind)


def custom_table(df: DataFrame, row: str, col: str, value: str | None = None) -> DataFrame:
    """Rows by columns: count, row, column and total percent, and statistics of a value; blank is a category ("")."""
    rows = df.select(F.coalesce(text(F.col(row)), F.lit("")).alias("row"), F.coalesce(text(F.col(col)), F.lit("")).alias("col"), (num(df, value) if value else F.lit(None).cast("double")).alias("v"))
    c = rows.groupBy("row", "col").agg(F.count(F.lit(1)).alias("count"), F.count("v").alias("valid"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"))
    c = c.join(quantiles(rows, "v", (0.5,), ["row", "col"], "type7", ["median"]), ["row", "col"], "left") if value else c.withColumn("median", F.lit(None).cast("double"))
    pct = lambda *keys: 100 * F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
    return c.withColumns({"row_percent": pct("row"), "col_percent": pct("col"), "total_percent": pct()})


def chi_gof(df: DataFrame, col: str, proportions: dict[str, float] | None = None) -> DataFrame:
    """Goodness of fit of category counts to given proportions (equal without any): chi2, df, p."""
    c = {r.category: r.n for r in df.select(text(F.col(col)).alias("category")).dropna().groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per category
    n, kind = sum(c.values()), "chi2 double, df long, p double, n long"
    p = proportions or {k: 1 / len(c) for k in c}
    total = sum(p.values())
    if len(c) < 2:
        return table(df.sparkSession, [], kind)
    chi2 = sum((c.get(k, 0) - n * x / total) ** 2 / (n * x / total) for k, x in p.items() if x > 0)
    return table(df.sparkSession, [(chi2, len(p) - 1, chi2_upper(chi2, len(p) - 1), n)], kind)


def pie(df: DataFrame, col: str, top: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Category counts and percent, the largest first; ties by first appearance where an order is given, else by name."""
    t = df.select(text(F.col(col)).alias("category"), *(F.col(o) for o in order)).where("category IS NOT NULL")
    first = F.min(F.struct(*order)) if order else F.min("category")
    c = t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), first.alias("_first")).withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    out = c.orderBy(F.desc("n"), "_first").drop("_first")
    return out.limit(top) if top else out


def error_bar(df: DataFrame, value: str, key: str, kind: str = "ci", k: float = 0.95) -> DataFrame:
    """Mean and range per group: a t interval of level k, or k standard errors ("se") or deviations ("sd")."""
    g = numbers(df, value, keep=(key,)).groupBy(F.col(key).alias("group")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("se", F.col("sd") / F.sqrt("n"))
    t = F.udf(lambda n: t_inv(0.5 + k / 2, n - 1) if n > 1 else None, "double")  # a call per group
    half = {"ci": t("n") * F.col("se"), "se": k * F.col("se"), "sd": k * F.col("sd")}[kind]
    return g.withColumn("_h", half).select("group", "n", "mean", "sd", "se", (F.col("mean") - F.col("_h")).alias("low"), (F.col("mean") + F.col("_h")).alias("high"))


def histogram(df: DataFrame, col: str) -> DataFrame:
    """Bins of equal width, sqrt(n) of them between 5 and 30, the last one closed."""
    v = df.select(num(df, col).alias("v")).dropna()
    s = v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("bins", F.least(F.greatest(F.ceil(F.sqrt("n")), F.lit(5)), F.lit(30))).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0))
    b = v.crossJoin(F.broadcast(s)).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("bins") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = s.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("bins").cast("int") - 1)).alias("bin"))
    return full.join(b, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, col: str, key: str | None = None) -> DataFrame:
    """Box plot figures per group: quartiles, whiskers within the type-7 fences, and how many lie beyond."""
    v = df.select((text(F.col(key)) if key else F.lit("all")).alias("group"), num(df, col).alias("v")).dropna()
    q = quantiles(v, "v", (0.25, 0.5, 0.75), ["group"], "type7", ("q1", "median", "q3"))
    j = v.join(q, "group").withColumn("inside", F.col("v").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return j.groupBy("group", "q1", "median", "q3").agg(F.count("v").alias("n"), F.min(F.when(F.col("inside"), F.col("v"))).alias("low"), F.max(F.when(F.col("inside"), F.col("v"))).alias("high"), F.sum((~F.col("inside")).cast("long")).alias("outliers"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points that have both values."""
    return numbers(df, x, y)


def scatter_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return numbers(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def line(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """(position, value) of a column's values in row order."""
    v = df.select(num(df, col).alias("value"), *(c for c in order if c != col)).where("value IS NOT NULL")
    return with_row(v, order).select((F.col(ROW) + 1).alias("position"), "value")


def count_values(df: DataFrame, cols: Sequence[str], target: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Per variable: how many cells equal the target (within 1e-12) or lie between low and high."""
    hits = [_hit(num(df, c), target, low, high).cast("long") for c in cols]
    one = df.agg(*(F.struct(F.lit(c).alias("variable"), F.coalesce(F.sum(h), F.lit(0)).alias("n"), (100 * F.sum(h) / F.count(F.lit(1))).alias("percent")).alias(f"x{i}") for i, (c, h) in enumerate(zip(cols, hits))))
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


def _hit(v: Column, target, low, high) -> Column:
    return F.coalesce(F.abs(v - F.lit(target)) <= 1e-12 if target is not None else v.between(low, high), F.lit(False))


def count_in_rows(df: DataFrame, cols: Sequence[str], target: float | None = None, low: float | None = None, high: float | None = None, name: str = "hits") -> DataFrame:
    """df with the number of the variables that match in each row."""
    return df.withColumn(name, sum((_hit(num(df, c), target, low, high).cast("int") for c in cols), F.lit(0)))
