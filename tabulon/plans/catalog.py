"""Queries on the test tables, one or more for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, describe, multivar, nonparam, prep, regress, space, survival, timeseries, trees
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, by the same rule as SQL's round."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _holes(df: DataFrame) -> DataFrame:
    """lineitem with missing quantities, by the same rule as in SQL."""
    return df.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


def _simple(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, digits: int = 6):
    query(name, sql)(lambda s, d: _rounded(f(_t(s, d, table)), digits))


HOLES = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity) FROM lineitem)"

# aggregation and tabulation

for _stat, _fn in {"mean": "avg", "sum": "sum", "n": "count", "min": "min", "max": "max", "median": "median"}.items():
    _cols = ", ".join(f"{'' if _stat == 'n' else 'round('}{_fn}({c}){'' if _stat == 'n' else ', 4)'} AS {c}_{_stat}" for c in ("l_quantity", "l_extendedprice"))
    _simple(f"agregat_{_stat}", "lineitem", lambda t, s=_stat: describe.aggregate(_holes(t), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], s), f"SELECT l_returnflag, l_linestatus, {_cols} FROM {HOLES} GROUP BY ALL", 4)

_simple("deskriptif_moments", "lineitem", lambda t: describe.describe(_holes(t), ["l_quantity", "l_discount"]).select("variable", "n", "mean", "sem", "sd", "variance", "skewness", "kurtosis", "min", "max", "median"), "SELECT 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS variance, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median FROM " + HOLES + " UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount) / sqrt(count(l_discount)), 6), round(stddev_samp(l_discount), 6), round(var_samp(l_discount), 6), round(skewness(l_discount), 6), round(kurtosis(l_discount), 6), min(l_discount), max(l_discount), round(median(l_discount), 6) FROM lineitem")
_simple("deskriptif", "lineitem", lambda t: describe.describe(t, ["l_quantity", "l_extendedprice"]))
_AT = "a[floor({h})::INT] + ({h} - floor({h})) * (a[ceil({h})::INT] - a[floor({h})::INT])"
_H6 = "least(greatest((n + 1) * {p}, 1), n)::DOUBLE"
_Q6 = ", ".join(f"round({_AT.format(h=_H6.format(p=p))}, 6) AS {c}" for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
_simple("kuantil_type6", "lineitem", lambda t: describe.quantiles(t.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x")), "x", (0.25, 0.5, 0.75), ["grp"], names=("q1", "median", "q3")), f"SELECT grp, {_Q6} FROM (SELECT l_returnflag AS grp, list_sort(list(l_extendedprice)) AS a, count(*) AS n FROM lineitem GROUP BY 1)")
_simple("kuantil_type7", "lineitem", lambda t: describe.quantiles(t.select(F.col("l_extendedprice").alias("x")), "x", (0.25, 0.5, 0.75), definition="type7", names=("q1", "median", "q3")), "SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem")
_simple("kuantil_tukey", "supplier", lambda t: describe.quantiles(t.select(F.col("s_acctbal").alias("x")), "x", (0.25, 0.5, 0.75), definition="tukey", names=("q1", "median", "q3")), "WITH v AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal) AS r, count(*) OVER () AS n FROM supplier) SELECT round(median(x) FILTER (r <= (n + 1) // 2), 6) AS q1, round(median(x), 6) AS median, round(median(x) FILTER (r > n // 2), 6) AS q3 FROM v")
_simple("frekuensi", "orders", lambda t: describe.frequencies(t, "o_orderpriority"), "WITH c AS (SELECT o_orderpriority AS category, count(*) AS frequency FROM orders GROUP BY 1) SELECT category, frequency, round(100.0 * frequency / sum(frequency) OVER (), 6) AS percent, round(100.0 * frequency / sum(frequency) OVER (), 6) AS valid_percent, round(100.0 * sum(frequency) OVER (ORDER BY category) / sum(frequency) OVER (), 6) AS cumulative_percent FROM c")
_simple("means", "lineitem", lambda t: describe.means(t, "l_returnflag", ["l_quantity"]).withColumnRenamed("group", "grp"), "SELECT 'l_quantity' AS variable, CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS grp, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, median(l_quantity) AS median FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
_simple("explore", "customer", lambda t: describe.explore(t, "c_mktsegment", "c_acctbal"))
_simple("rasio", "lineitem", lambda t: describe.ratio(t, "l_extendedprice", "l_quantity", "l_returnflag").select(F.col("group").alias("grp"), "n", "mean", "median", "weighted_mean", "aad", "cod", "prd"), "WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS x, l_extendedprice / l_quantity AS r FROM lineitem WHERE abs(l_quantity) > 1e-12), m AS (SELECT g, median(r) AS m FROM r GROUP BY g) SELECT r.g AS grp, count(*) AS n, round(avg(r), 6) AS mean, round(max(m), 6) AS median, round(sum(y) / sum(x), 6) AS weighted_mean, round(avg(abs(r - m)), 6) AS aad, round(100 * avg(abs(r - m)) / max(m), 6) AS cod, round(avg(r) / (sum(y) / sum(x)), 6) AS prd FROM r JOIN m ON m.g = r.g GROUP BY r.g")
_simple("codebook", "part", lambda t: describe.codebook(t).select("variable", "valid", "missing", "min", "max", "mean", "categories").where("variable IN ('p_size', 'p_brand')"), "SELECT 'p_size' AS variable, count(p_size) AS valid, 0::BIGINT AS missing, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size), 6) AS mean, NULL::BIGINT AS categories FROM part UNION ALL SELECT 'p_brand', count(p_brand), 0, NULL, NULL, NULL, count(DISTINCT p_brand) FROM part")
_simple("kualitas_data", "lineitem", lambda t: describe.quality(_holes(t), ["l_quantity"]), "WITH f AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM " + HOLES + ") SELECT 'l_quantity' AS variable, count(l_quantity) AS filled, count(*) - count(l_quantity) AS blank, round(100.0 * count(l_quantity) / count(*), 6) AS percent_filled, count(DISTINCT l_quantity) AS distinct, min(l_quantity) AS min, max(l_quantity) AS max, (count(*) FILTER (l_quantity < a - 1.5 * (b - a) OR l_quantity > b + 1.5 * (b - a)))::BIGINT AS outliers FROM " + HOLES + ", f")
_simple("kualitas_tabel", "orders", lambda t: describe.table_quality(t, ["o_orderstatus", "o_orderpriority"]), "SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS complete, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)))::BIGINT AS duplicates, 0::BIGINT AS blank_cells FROM orders")
_simple("silang", "orders", lambda t: describe.crosstab(t, "o_orderstatus", "o_orderpriority"), "WITH c AS (SELECT o_orderstatus AS row, o_orderpriority AS col, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT row, sum(n)::BIGINT AS row_total FROM c GROUP BY 1), k AS (SELECT col, sum(n)::BIGINT AS col_total FROM c GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM c) SELECT r.row, k.col, coalesce(n, 0) AS n, row_total, col_total, total, round(row_total * col_total / total::DOUBLE, 6) AS expected FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.row = r.row AND c.col = k.col")
_simple("silang_chi2", "orders", lambda t: describe.association(t, "o_orderstatus", "o_orderpriority").select("chi2", "df", "g2", "cramers_v", "contingency", "n"), "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY k) / sum(n) OVER () AS e FROM c), d AS (SELECT count(DISTINCT r) AS a, count(DISTINCT k) AS b FROM c), s AS (SELECT sum((n - e) ^ 2 / e) AS x, sum(2 * n * ln(n / e)) AS g, sum(n) AS t FROM e) SELECT round(x, 6) AS chi2, ((a - 1) * (b - 1))::BIGINT AS df, round(g, 6) AS g2, round(sqrt(x / (t * (least(a, b) - 1))), 6) AS cramers_v, round(sqrt(x / (x + t)), 6) AS contingency, t::BIGINT AS n FROM s, d")
_simple("custom_tables", "orders", lambda t: describe.custom_table(t, "o_orderstatus", "o_orderpriority", "o_totalprice").select("row", "col", "count", "mean", "row_percent", "total_percent"), "WITH c AS (SELECT o_orderstatus AS row, o_orderpriority AS col, count(*) AS count, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2) SELECT row, col, count, round(mean, 6) AS mean, round(100.0 * count / sum(count) OVER (PARTITION BY row), 6) AS row_percent, round(100.0 * count / sum(count) OVER (), 6) AS total_percent FROM c")
_simple("chi_gof", "orders", lambda t: describe.chi_gof(t, "o_orderpriority").select("chi2", "df", "n"), "WITH c AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_orderpriority), s AS (SELECT sum(n) AS t, count(*) AS k FROM c) SELECT round(sum((n - t / k) ^ 2 / (t / k)), 6) AS chi2, (max(k) - 1)::BIGINT AS df, max(t)::BIGINT AS n FROM c, s")
_simple("pie", "orders", lambda t: describe.pie(t, "o_orderstatus"), "SELECT o_orderstatus AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1")
_simple("error_bar", "customer", lambda t: describe.error_bar(t, "c_acctbal", "c_mktsegment", "se", 2).withColumnRenamed("group", "grp"), "SELECT c_mktsegment AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS se, round(avg(c_acctbal) - 2 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS low, round(avg(c_acctbal) + 2 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS high FROM customer GROUP BY 1")
_simple("distribusi_histogram", "part", lambda t: describe.histogram(t, "p_retailprice").select("bin", "n"), "WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, least(greatest(ceil(sqrt(count(*))), 5), 30) AS k FROM part), b AS (SELECT least(floor((p_retailprice - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS n FROM part, s GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0) AS n FROM s, range(0, 30) AS r(i) LEFT JOIN b ON b.bin = i WHERE i < k")
_simple("distribusi_box", "lineitem", lambda t: describe.box(t, "l_extendedprice", "l_returnflag").withColumnRenamed("group", "grp"), "WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS a, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1) SELECT g AS grp, round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, count(*) AS n, min(l_extendedprice) FILTER (l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS high, (count(*) FILTER (NOT (l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))))::BIGINT AS outliers FROM lineitem JOIN q ON q.g = l_returnflag GROUP BY g, a, m, b")
_simple("grafik_sebar", "lineitem", lambda t: describe.scatter_line(t, "l_quantity", "l_extendedprice"), "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
_simple("grafik_garis", "events", lambda t: describe.line(t, "value", ["event_id"]), "SELECT row_number() OVER (ORDER BY event_id) AS position, round(value, 6) AS value FROM events WHERE value IS NOT NULL")
_simple("count_values", "lineitem", lambda t: describe.count_values(t, ["l_quantity", "l_linenumber"], low=2, high=4), "SELECT 'l_quantity' AS variable, (count(*) FILTER (l_quantity BETWEEN 2 AND 4))::BIGINT AS n, round(100.0 * (count(*) FILTER (l_quantity BETWEEN 2 AND 4)) / count(*), 6) AS percent FROM lineitem UNION ALL SELECT 'l_linenumber', (count(*) FILTER (l_linenumber BETWEEN 2 AND 4))::BIGINT, round(100.0 * (count(*) FILTER (l_linenumber BETWEEN 2 AND 4)) / count(*), 6) FROM lineitem")

# preparation

_simple("hitung_variabel", "lineitem", lambda t: prep.compute(t.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "net", "l_extendedprice * (1 - l_discount)").groupBy("l_linenumber").agg(F.round(F.sum("net"), 2).alias("net")), "SELECT l_linenumber, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1", 2)
_simple("recode", "part", lambda t: prep.recode(t.select("p_partkey", "p_size"), "p_size", [(None, 10, 1), (11, 30, 2)], other=3), "SELECT p_partkey, (CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 AND p_size >= 11 THEN 2 ELSE 3 END)::DOUBLE AS p_size FROM part")
_EV = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
_gap = lambda t: t.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
_simple("isi_mean", "events", lambda t: prep.fill(_gap(t), "value", "mean"), f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {_EV}")
_simple("isi_median", "events", lambda t: prep.fill(_gap(t), "value", "median"), f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {_EV})), 6) AS value FROM {_EV}")
_simple("isi_previous", "events", lambda t: prep.fill(_gap(t), "value", "previous", order=["event_id"]).select("event_id", "value"), f"SELECT event_id, round(coalesce(value, last_value(value IGNORE NULLS) OVER (ORDER BY event_id)), 6) AS value FROM {_EV}")
_simple("isi_next", "events", lambda t: prep.fill(_gap(t), "value", "next", order=["event_id"]).select("event_id", "value"), f"SELECT event_id, round(coalesce(value, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM {_EV}")
_simple("isi_linear", "events", lambda t: prep.fill(_gap(t), "value", "linear", order=["event_id"]).select("event_id", "value"), f"WITH v AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM {_EV}), w AS (SELECT *, last_value(value IGNORE NULLS) OVER (ORDER BY r) AS p, last_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER (ORDER BY r) AS pr, first_value(value IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q, first_value(CASE WHEN value IS NOT NULL THEN r END IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qr FROM v) SELECT event_id, round(coalesce(value, p + (q - p) * (r - pr) / nullif(qr - pr, 0), p, q), 6) AS value FROM w")
_simple("isi_modus", "orders", lambda t: prep.fill(t.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority")), "o_orderpriority", "mode"), "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders), m AS (SELECT p FROM v WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS o_orderpriority FROM v")
_simple("buang_kosong", "lineitem", lambda t: prep.drop_blank_rows(_holes(t), ["l_quantity"]).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_linenumber <> 3")
_simple("buang_ganda", "lineitem", lambda t: prep.count_duplicates(t, ["l_returnflag", "l_linestatus", "l_quantity"]), "SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)))::BIGINT AS duplicates FROM lineitem")
_simple("buang_ganda_baris", "orders", lambda t: prep.drop_duplicates(t.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"]), "SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders GROUP BY 2, 3")
_FENCE = "(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"
_simple("pencilan_buang", "events", lambda t: prep.outliers(t.select("event_id", "value"), "value"), f"SELECT event_id, round(value, 6) AS value FROM events, {_FENCE} WHERE value BETWEEN lo AND hi OR value IS NULL")
_simple("pencilan_jepit", "events", lambda t: prep.outliers(t.select("event_id", "value"), "value", "clamp"), f"SELECT event_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END, 6) AS value FROM events, {_FENCE}")
_simple("normalisasi_z", "customer", lambda t: prep.normalise(t.select("c_custkey", "c_acctbal"), "c_acctbal", replace=True), "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
_simple("normalisasi_minmax", "customer", lambda t: prep.normalise(t.select("c_custkey", "c_acctbal"), "c_acctbal", "minmax", replace=True), "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
_simple("pengkodean_label", "orders", lambda t: prep.label_encode(t.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"]), "WITH f AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY min(o_orderkey))::INT AS c FROM orders GROUP BY 1) SELECT o_orderkey, o_orderstatus, c AS o_orderstatus_code FROM orders JOIN f ON s = o_orderstatus")
_simple("pengkodean_onehot", "orders", lambda t: prep.one_hot(t.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"), "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
_simple("bagi_data", "orders", lambda t: prep.split(t.select("o_orderkey"), 0.7).groupBy("role").agg(F.count(F.lit(1)).alias("n")), "SELECT 'train' AS role, floor(0.7 * count(*) + 0.5)::BIGINT AS n FROM orders UNION ALL SELECT 'test', count(*) - floor(0.7 * count(*) + 0.5)::BIGINT FROM orders")
for _ties, _base in {"mean": "(2 * rank() OVER (ORDER BY p_size) + c - 1) / 2.0", "low": "rank() OVER (ORDER BY p_size)", "high": "rank() OVER (ORDER BY p_size) + c - 1", "sequential": "row_number() OVER (ORDER BY p_size, p_partkey)"}.items():
    _simple(f"peringkat_{_ties}", "part", lambda t, k=_ties: prep.rank_cases(t.select("p_partkey", "p_size"), "p_size", ties=k, name="r", order=["p_partkey"]), f"SELECT p_partkey, p_size, ({_base})::DOUBLE AS r FROM (SELECT *, count(*) OVER (PARTITION BY p_size) AS c FROM part)")
_MID = "(2 * rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1) / 2.0"
_simple("peringkat_fraction", "part", lambda t: prep.rank_cases(t.select("p_partkey", "p_size"), "p_size", "fraction", name="r"), f"SELECT p_partkey, p_size, round({_MID} / count(*) OVER (), 6) AS r FROM part")
_simple("peringkat_ntile", "part", lambda t: prep.rank_cases(t.select("p_partkey", "p_size"), "p_size", "ntile", name="r"), f"SELECT p_partkey, p_size, least(4, ceil(4 * {_MID} / count(*) OVER ()))::DOUBLE AS r FROM part")
_simple("peringkat_normal", "part", lambda t: prep.rank_cases(t.select("p_partkey", "p_size"), "p_size", "normal", name="r"))
_simple("urut_baris", "customer", lambda t: prep.sort_rows(t, [("c_mktsegment", False), ("c_acctbal", True)]), "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
_simple("urut_variabel", "nation", lambda t: prep.reorder(t), "SELECT * FROM nation")
_simple("pilih_kasus", "lineitem", lambda t: prep.select_cases(_holes(t), [("l_quantity", "!=", 10), ("l_returnflag", "==", "a")]).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n")), f"SELECT l_linestatus, count(*) AS n FROM {HOLES} WHERE l_quantity <> 10 AND lower(l_returnflag) = 'a' GROUP BY 1")
query("merge_cases", "SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier")(lambda s, d: prep.merge_cases(_t(s, d, "customer").selectExpr("c_nationkey AS nationkey", "c_acctbal AS acctbal", "c_mktsegment AS mktsegment"), _t(s, d, "supplier").selectExpr("s_nationkey AS NATIONKEY", "s_acctbal AS acctbal")))
query("merge_variables", "SELECT n_nationkey, n_name, r_regionkey, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) FULL JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")(lambda s, d: prep.merge_variables(_t(s, d, "nation").select("n_nationkey", "n_name"), _t(s, d, "region"), ["n_nationkey"], ["r_regionkey"]))
_simple("transpose", "region", lambda t: prep.transpose(t, ["r_regionkey", "r_name"], ["r_regionkey"], 3), "SELECT 'r_regionkey' AS variable, '0' AS \"Case1\", '1' AS \"Case2\", '2' AS \"Case3\" UNION ALL SELECT 'r_name', max(r_name) FILTER (r_regionkey = 0), max(r_name) FILTER (r_regionkey = 1), max(r_name) FILTER (r_regionkey = 2) FROM region")
_simple("validasi", "part", lambda t: prep.validate(t, [{"column": "p_size", "min": 5, "max": 45}, {"column": "p_brand", "values": ["Brand#11", "Brand#12"]}], ["p_partkey"]).groupBy("variable", "kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'p_size' AS variable, 'range' AS kind, count(*) AS n FROM part WHERE p_size < 5 OR p_size > 45 UNION ALL SELECT 'p_brand', 'level', count(*) FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
_simple("validasi_kunci", "lineitem", lambda t: prep.validate(t, [{"column": "l_orderkey", "key": True}], ["l_orderkey", "l_linenumber"]).groupBy("variable", "kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'l_orderkey' AS variable, 'duplicate' AS kind, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c > 1")

# tests

_two = lambda t: t.where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
_SEG = "(SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"
_simple("t_satu", "customer", lambda t: compare.t_one(t, "c_acctbal", 4500).select("n", "mean", "sd", "t", "df", "d"), "SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 6) AS t, (count(*) - 1)::BIGINT AS df, round((avg(c_acctbal) - 4500) / stddev_samp(c_acctbal), 6) AS d FROM customer")
_simple("t_bebas", "customer", lambda t: compare.t_independent(_two(t), "c_acctbal", "c_mktsegment").select("test", "t", "df", "difference", "se"), f"WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM {_SEG} GROUP BY 1), s AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS d, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS p, a.v / a.n AS va, b.v / b.n AS vb FROM g a, g b WHERE a.g < b.g) SELECT 'pooled' AS test, round(d / sqrt(p * (1.0 / n1 + 1.0 / n2)), 6) AS t, (n1 + n2 - 2)::DOUBLE AS df, round(d, 6) AS difference, round(sqrt(p * (1.0 / n1 + 1.0 / n2)), 6) AS se FROM s UNION ALL SELECT 'welch', round(d / sqrt(va + vb), 6), round((va + vb) ^ 2 / (va ^ 2 / (n1 - 1) + vb ^ 2 / (n2 - 1)), 6), round(d, 6), round(sqrt(va + vb), 6) FROM s")
_simple("t_pasangan", "lineitem", lambda t: compare.t_paired(t, "l_discount", "l_tax").select("n", "mean_difference", "t", "dz", "r"), "SELECT count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean_difference, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, round(avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 6) AS dz, round(corr(l_discount, l_tax), 6) AS r FROM lineitem")
_RANK = "WITH r AS (SELECT {k} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}), s AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS r FROM r GROUP BY g), q AS (SELECT sum(c ^ 3 - c) AS t, sum(c)::DOUBLE AS n FROM (SELECT count(*)::DOUBLE AS c FROM {t} GROUP BY {v})) "
_simple("mannwhitney", "customer", lambda t: nonparam.mann_whitney(_two(t), "c_acctbal", "c_mktsegment").select("u", "z"), _RANK.format(k="c_mktsegment", v="c_acctbal", t=_SEG) + ", u AS (SELECT least(a.r - a.n * (a.n + 1) / 2, a.n * b.n - (a.r - a.n * (a.n + 1) / 2)) AS u, a.n * b.n / 2 AS mu, sqrt(a.n * b.n / 12 * ((q.n + 1) - q.t / (q.n * (q.n - 1)))) AS sd FROM s a, s b, q WHERE a.g < b.g) SELECT round(u, 6) AS u, round((u - mu + CASE WHEN u < mu THEN 0.5 ELSE 0 END) / sd, 6) AS z FROM u")
_simple("wilcoxon", "lineitem", lambda t: nonparam.wilcoxon(t, "l_discount", "l_tax").select("n", "w_plus", "w_minus"), "WITH d AS (SELECT l_tax - l_discount AS d FROM lineitem WHERE abs(l_tax - l_discount) >= 1e-12), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d) SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus FROM r")
_simple("kruskal", "customer", lambda t: nonparam.kruskal(t, "c_acctbal", "c_mktsegment").select("h", "df", "n"), _RANK.format(k="c_mktsegment", v="c_acctbal", t="customer") + "SELECT round((12 / (max(q.n) * (max(q.n) + 1)) * sum(r ^ 2 / s.n) - 3 * (max(q.n) + 1)) / (1 - max(q.t) / (max(q.n) ^ 3 - max(q.n))), 6) AS h, (count(*) - 1)::BIGINT AS df, max(q.n)::BIGINT AS n FROM s, q")
_simple("anova", "lineitem", lambda t: compare.anova(t, "l_extendedprice", "l_returnflag").where("source = 'between'").select("df", "f", "df2", "eta2"), "WITH g AS (SELECT count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag), a AS (SELECT avg(l_extendedprice) AS m FROM lineitem), s AS (SELECT sum(n * (g.m - a.m) ^ 2) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM g, a) SELECT d1::DOUBLE AS df, round((b / d1) / (w / d2), 6) AS f, d2::DOUBLE AS df2, round(b / (b + w), 6) AS eta2 FROM s")
_simple("anova_kelompok", "customer", lambda t: compare.group_table(t, "c_acctbal", "c_mktsegment").select(F.col("group").alias("grp"), "n", "mean", "sd", "se"), "SELECT c_mktsegment AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS se FROM customer GROUP BY 1")
_simple("anova_tukey", "customer", lambda t: compare.tukey_hsd(t, "c_acctbal", "c_mktsegment"))
_simple("levene", "customer", lambda t: compare.levene(t, "c_acctbal", "c_mktsegment").where("center IN ('mean', 'median')").select("center", "f", "df1", "df2"), "WITH c AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS a, median(c_acctbal) AS m FROM customer GROUP BY 1), d AS (SELECT 'mean' AS center, g, abs(c_acctbal - a) AS d FROM customer JOIN c ON g = c_mktsegment UNION ALL SELECT 'median', g, abs(c_acctbal - m) FROM customer JOIN c ON g = c_mktsegment), k AS (SELECT center, g, count(*)::DOUBLE AS n, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY 1, 2), t AS (SELECT center, avg(d) AS m FROM d GROUP BY 1), s AS (SELECT k.center, sum(n * (k.m - t.m) ^ 2) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM k JOIN t ON t.center = k.center GROUP BY 1) SELECT center, round((b / d1) / (w / d2), 6) AS f, d1::DOUBLE AS df1, d2::DOUBLE AS df2 FROM s")
_simple("anova_dua_faktor", "lineitem", lambda t: compare.anova_two_way(t.where("l_returnflag <> 'N'").withColumn("half", F.when(F.col("l_linenumber") > 3, "b").otherwise("a")), "l_extendedprice", "l_returnflag", "half"))
_simple("anova_dua_faktor_sel", "orders", lambda t: compare.cell_means(t, "o_totalprice", "o_orderstatus", "o_orderpriority"), "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2) SELECT a, b, n, round(mean, 6) AS mean, round(mean, 6) AS unweighted_mean FROM c UNION ALL SELECT a, NULL, sum(n)::BIGINT, round(sum(n * mean) / sum(n), 6), round(avg(mean), 6) FROM c GROUP BY a UNION ALL SELECT NULL, b, sum(n)::BIGINT, round(sum(n * mean) / sum(n), 6), round(avg(mean), 6) FROM c GROUP BY b")
_simple("ancova", "lineitem", lambda t: compare.ancova(t, "l_extendedprice", "l_returnflag", "l_quantity"))
_simple("anova_berulang", "lineitem", lambda t: compare.anova_repeated(t.where("l_linenumber <= 3").withColumn("l_linenumber", F.col("l_linenumber").cast("string")).withColumn("l_orderkey", F.col("l_orderkey").cast("string")), "l_extendedprice", "l_orderkey", "l_linenumber"))
_simple("manova", "lineitem", lambda t: compare.manova(t, ["l_quantity", "l_discount", "l_tax"], "l_returnflag"))
_R3 = ", ".join(f"1 + ({b} < {a})::INT + ({c} < {a})::INT + (({b} = {a})::INT + ({c} = {a})::INT) / 2.0 AS r{k}" for k, (a, b, c) in enumerate([("l_discount", "l_tax", "l_quantity"), ("l_tax", "l_discount", "l_quantity"), ("l_quantity", "l_discount", "l_tax")]))
_FRIEDMAN = f"WITH r AS (SELECT {_R3}, CASE WHEN l_discount = l_tax AND l_tax = l_quantity THEN 24 WHEN l_discount = l_tax OR l_tax = l_quantity OR l_discount = l_quantity THEN 6 ELSE 0 END AS ties FROM lineitem), g AS (SELECT sum(r0) AS a, sum(r1) AS b, sum(r2) AS c, sum(ties) AS t, count(*)::DOUBLE AS n FROM r), f AS (SELECT (12 / (12 * n) * (a * a + b * b + c * c) - 12 * n) / (1 - t / (24 * n)) AS chi, n FROM g) "
_simple("friedman", "lineitem", lambda t: nonparam.friedman(t, ["l_discount", "l_tax", "l_quantity"]).select("chi2", "df", "n", "kendall_w"), _FRIEDMAN + "SELECT round(chi, 6) AS chi2, 2::BIGINT AS df, n::BIGINT AS n, round(chi / (2 * n), 6) AS kendall_w FROM f")
_simple("kendall_w", "lineitem", lambda t: nonparam.kendall_w(t, ["l_discount", "l_tax", "l_quantity"]), _FRIEDMAN + "SELECT round(chi / (2 * n), 6) AS w, round(chi, 6) AS chi2, 2::BIGINT AS df, round(exp(-chi / 2), 6) AS p, n::BIGINT AS n FROM f")
_LAB = "labels"
_simple("cochran_q", _LAB, lambda t: nonparam.cochran_q(t.withColumn("even", (F.col("doc_id") % 2).cast("int")), ["quality", "toxic", "even"]).select("q", "df", "n"), "WITH v AS (SELECT quality AS a, toxic AS b, doc_id % 2 AS c FROM labels), s AS (SELECT count(*) AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(c)::DOUBLE AS c, sum(a + b + c)::DOUBLE AS g, sum((a + b + c) ^ 2)::DOUBLE AS r FROM v) SELECT round(2 * (3 * (a ^ 2 + b ^ 2 + c ^ 2) - g ^ 2) / (3 * g - r), 6) AS q, 2::BIGINT AS df, n FROM s")
for _name in ("tanda", "tanda_semua"):
    _simple(_name, "lineitem", lambda t: nonparam.sign_test(t, "l_discount", "l_tax").select("plus", "minus", "ties"), "SELECT (count(*) FILTER (l_tax > l_discount))::BIGINT AS plus, (count(*) FILTER (l_tax < l_discount))::BIGINT AS minus, (count(*) FILTER (l_tax = l_discount))::BIGINT AS ties FROM lineitem")
_simple("mcnemar", _LAB, lambda t: nonparam.mcnemar(t, "quality", "toxic").select("n11", "n10", "n01", "n00", "chi2"), "WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels) SELECT a::BIGINT AS n11, b::BIGINT AS n10, c::BIGINT AS n01, d::BIGINT AS n00, round((abs(b - c) - 1) ^ 2 / (b + c)::DOUBLE, 6) AS chi2 FROM s")
_simple("runs", "events", lambda t: nonparam.runs_test(t, "value", ["event_id"]).select("n1", "n0", "runs"), "WITH v AS (SELECT event_id, (value >= (SELECT median(value) FROM events))::INT AS x FROM events), w AS (SELECT x, lag(x) OVER (ORDER BY event_id) AS p FROM v) SELECT (count(*) FILTER (x = 1))::BIGINT AS n1, (count(*) FILTER (x = 0))::BIGINT AS n0, (count(*) FILTER (p IS NULL OR p <> x))::BIGINT AS runs FROM w")
for _name in ("binomial", "binomial_semua"):
    _simple(_name, "orders", lambda t: nonparam.binomial(t, "o_orderstatus", "F").select("k", "n", "share"), "SELECT (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS k, count(*) AS n, round((count(*) FILTER (o_orderstatus = 'F')) / count(*)::DOUBLE, 6) AS share FROM orders")
_simple("prop_satu", _LAB, lambda t: nonparam.proportion(t.withColumn("toxic", F.col("toxic").cast("string")), "toxic", "1", 0.1).select("k", "n", "share", "z"), "SELECT sum(toxic)::BIGINT AS k, count(*) AS n, round(avg(toxic), 6) AS share, round((avg(toxic) - 0.1) / sqrt(0.09 / count(*)), 6) AS z FROM labels")
_simple("prop_dua", _LAB, lambda t: nonparam.two_proportions(t.selectExpr("cast(toxic AS string) AS toxic", "cast(doc_id % 2 AS string) AS half"), "toxic", "half", "1").select("share1", "share2", "odds_ratio", "risk_ratio"), "WITH g AS (SELECT doc_id % 2 AS h, sum(toxic)::DOUBLE AS k, count(*) AS n FROM labels GROUP BY 1) SELECT round(a.k / a.n, 6) AS share1, round(b.k / b.n, 6) AS share2, round((a.k * (b.n - b.k)) / ((a.n - a.k) * b.k), 6) AS odds_ratio, round((a.k / a.n) / (b.k / b.n), 6) AS risk_ratio FROM g a, g b WHERE a.h < b.h")
_simple("moses", "customer", lambda t: nonparam.moses(_two(t), "c_acctbal", "c_mktsegment"))
_simple("ks_satu", "customer", lambda t: nonparam.ks_normal(t, "c_acctbal", 1000))
_simple("ks_dua", "customer", lambda t: nonparam.ks_two(_two(t), "c_acctbal", "c_mktsegment").select("d", "n1", "n2"), f"WITH v AS (SELECT c_acctbal AS x, count(*) FILTER (c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_mktsegment = 'MACHINERY') AS b FROM {_SEG} GROUP BY 1), w AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER ()::DOUBLE AS fb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v) SELECT round(max(abs(fa - fb)), 6) AS d, max(na)::BIGINT AS n1, max(nb)::BIGINT AS n2 FROM w")
_simple("median_test", "customer", lambda t: nonparam.median_test(t, "c_acctbal", "c_mktsegment").select("chi2", "df", "n"), "WITH m AS (SELECT median(c_acctbal) AS m FROM customer), c AS (SELECT c_mktsegment AS g, (c_acctbal > m) AS h, count(*)::DOUBLE AS n FROM customer, m GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY h) / sum(n) OVER () AS e FROM c) SELECT round(sum((n - e) ^ 2 / e), 6) AS chi2, (SELECT count(DISTINCT c_mktsegment) - 1 FROM customer)::BIGINT AS df, sum(n)::BIGINT AS n FROM e")
_simple("eksak", "nation", lambda t: nonparam.exact_table(t.withColumn("r", F.col("n_regionkey").cast("string")).withColumn("k", (F.col("n_nationkey") % 2).cast("string")), "r", "k", 2000))
_simple("shapiro", "supplier", lambda t: nonparam.shapiro_wilk(t.select(F.col("s_acctbal").alias("v")), "v"))
_simple("plot_sebaran", "supplier", lambda t: nonparam.qq_points(t, "s_acctbal"))
_simple("bootstrap", "supplier", lambda t: compare.bootstrap(t, ["s_acctbal"], replications=500))
_simple("bootstrap_permutasi", "customer", lambda t: compare.permutation_test(_two(t), "c_acctbal", "c_mktsegment", 500))

# correlation and regression

_X = ["l_quantity", "l_discount", "l_tax"]
_simple("korelasi_pearson", "lineitem", lambda t: regress.pearson(t, ["l_extendedprice", "l_quantity"]).select("x", "y", "r", "n"), "SELECT 'l_extendedprice' AS x, 'l_quantity' AS y, round(corr(l_extendedprice, l_quantity), 6) AS r, count(*) AS n FROM lineitem")
_simple("korelasi_spearman", "part", lambda t: regress.spearman(t, ["p_size", "p_retailprice"]).select("x", "y", "r", "n"), "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_size' AS x, 'p_retailprice' AS y, round(corr(a, b), 6) AS r, count(*) AS n FROM r")
_simple("korelasi_kendall", "part", lambda t: regress.kendall(t, "p_size", "p_retailprice").select("tau_b", "n"), "WITH p AS (SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice))::DOUBLE AS s, count(*) FILTER (a.p_size <> b.p_size)::DOUBLE AS x, count(*) FILTER (a.p_retailprice <> b.p_retailprice)::DOUBLE AS y FROM part a JOIN part b ON a.p_partkey < b.p_partkey) SELECT round(s / sqrt(x * y), 6) AS tau_b, (SELECT count(*) FROM part) AS n FROM p")
_simple("korelasi_parsial", "lineitem", lambda t: regress.partial_correlation(t, ["l_extendedprice", "l_quantity"], ["l_discount"]).select("r", "partial_r", "df"), "WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS c, count(*) AS n FROM lineitem) SELECT round(a, 6) AS r, round((a - b * c) / sqrt((1 - b ^ 2) * (1 - c ^ 2)), 6) AS partial_r, (n - 3)::BIGINT AS df FROM c")
_simple("regresi_sederhana", "lineitem", lambda t: regress.ols(t, "l_extendedprice", ["l_quantity"]).select("term", "estimate"), "SELECT '(intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem", 4)
_simple("regresi", "lineitem", lambda t: regress.ols(t, "l_extendedprice", _X))
_simple("regresi_ringkasan", "part", lambda t: regress.ols_summary(t, "p_retailprice", ["p_size"], ["p_partkey"]).select("n", "r2", "durbin_watson"), "WITH b AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i, regr_r2(p_retailprice, p_size) AS r2 FROM part), e AS (SELECT p_partkey, p_retailprice - i - s * p_size AS e FROM part, b), w AS (SELECT e, lag(e) OVER (ORDER BY p_partkey) AS q FROM e) SELECT (SELECT count(*) FROM part) AS n, round((SELECT r2 FROM b), 6) AS r2, round(sum((e - q) ^ 2) / sum(e ^ 2), 6) AS durbin_watson FROM w")
_simple("ridge", "lineitem", lambda t: regress.ridge(t, "l_extendedprice", _X, 10.0))
_simple("wls", "lineitem", lambda t: regress.wls(t, "l_extendedprice", ["l_quantity"], "l_linenumber").select("term", "estimate"), "WITH s AS (SELECT sum(l_linenumber)::DOUBLE AS w, sum(l_linenumber * l_quantity) AS x, sum(l_linenumber * l_extendedprice) AS y, sum(l_linenumber * l_quantity ^ 2) AS xx, sum(l_linenumber * l_quantity * l_extendedprice) AS xy FROM lineitem), b AS (SELECT (w * xy - x * y) / (w * xx - x ^ 2) AS b, * FROM s) SELECT '(intercept)' AS term, round((y - b * x) / w, 4) AS estimate FROM b UNION ALL SELECT 'l_quantity', round(b, 4) FROM b", 4)
_simple("sls2", "lineitem", lambda t: regress.two_stage(t, "l_extendedprice", ["l_quantity"], ["l_discount"], ["l_tax", "l_linenumber"])[0])
_simple("robust", "part", lambda t: regress.robust(t, "p_retailprice", ["p_size"]), None, 4)
_simple("quantile", "supplier", lambda t: regress.quantile_regression(t.withColumn("k", F.col("s_suppkey") % 7), "s_acctbal", ["k"], (0.5,), most=30), None, 2)
_simple("regresi_nonlinear", "part", lambda t: regress.nonlinear(t, "p_retailprice", "p_size"), None, 4)
_quality = lambda s, d: _t(s, d, "labels").join(_t(s, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("kchars", F.col("n_chars") / 1000)
query("logistik")(lambda s, d: _rounded(regress.logistic(_quality(s, d), "quality", ["kchars"]), 4))
query("probit")(lambda s, d: _rounded(regress.probit(_quality(s, d), "quality", ["kchars"]), 4))
_simple("multinomial", "orders", lambda t: regress.multinomial(t.selectExpr("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y", "o_totalprice / 100000 AS x"), "y", ["x"]), None, 3)
_simple("ordinal", "orders", lambda t: regress.ordinal(t.selectExpr("cast(substring(o_orderpriority, 1, 1) AS int) AS y", "o_totalprice / 100000 AS x"), "y", ["x"]), None, 3)
_simple("poisson", "lineitem", lambda t: regress.poisson(t, "l_linenumber", ["l_discount"]).select("term", "estimate", "se"), None, 5)
_simple("glm_multi_gamma", "part", lambda t: regress.glm_gamma(t, "p_retailprice", ["p_size"]), None, 5)
_simple("glm_multi_binomial", "lineitem", lambda t: regress.glm_binomial(t.withColumn("m", F.lit(50.0)), "l_quantity", "m", ["l_discount"]), None, 5)
_simple("cacah_nb", "events", lambda t: regress.negative_binomial(t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")), "n", ["v"]), None, 2)
_simple("cacah_zip", "events", lambda t: regress.zero_inflated(t.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"), F.avg("value").alias("v")), "n", ["v"]), None, 2)
_simple("campur", "customer", lambda t: regress.mixed(t.withColumn("k", F.col("c_custkey") % 10), "c_acctbal", ["k"], "c_nationkey")[0], None, 3)
_simple("glmm", "customer", lambda t: regress.glmm(t.withColumn("y", (F.col("c_acctbal") > 0).cast("int")).withColumn("k", F.col("c_custkey") % 10), "y", ["k"], "c_nationkey", most=10)[0], None, 3)
_simple("gee", "customer", lambda t: regress.gee(t.withColumn("k", F.col("c_custkey") % 10), "c_acctbal", ["k"], "c_nationkey"), None, 3)
_simple("korelasi_kanonik", "lineitem", lambda t: regress.canonical_correlation(t, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])[0])

# multivariate, trees, survival, series, imputation

_simple("reliabilitas", "lineitem", lambda t: multivar.reliability(t, ["l_quantity", "l_linenumber"])[0].select("alpha", "items", "n"), "SELECT round(2 * (1 - (var_samp(l_quantity) + var_samp(l_linenumber)) / var_samp(l_quantity + l_linenumber)), 6) AS alpha, 2 AS items, count(*) AS n FROM lineitem")
_simple("faktor", "lineitem", lambda t: multivar.factor(t, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])["loadings"], None, 5)
_simple("korespondensi", "orders", lambda t: multivar.correspondence(t, "o_orderstatus", "o_orderpriority"))
_simple("princals", "orders", lambda t: multivar.princals(t, ["o_orderstatus", "o_orderpriority"])["fit"], None, 5)
_simple("kmeans", "part", lambda t: multivar.kmeans(t, ["p_size", "p_retailprice"], 3, most=15)[0], None, 4)
_simple("hierarki", "nation", lambda t: multivar.hierarchical(t, ["n_nationkey", "n_regionkey"])["merges"])
_simple("dbscan", "supplier", lambda t: space.dbscan(t.withColumn("b", F.col("s_acctbal") / 1000), ["b"], 0.2, 3, "s_suppkey"), "WITH v AS (SELECT s_suppkey::VARCHAR AS id, s_acctbal::DOUBLE / 1000 AS b FROM supplier WHERE s_suppkey IS NOT NULL AND s_acctbal IS NOT NULL), p AS (SELECT x.id, x.b, y.id AS o FROM v x JOIN v y ON (x.b - y.b) * (x.b - y.b) <= 0.2::DOUBLE * 0.2::DOUBLE), c AS (SELECT id, b FROM p GROUP BY 1, 2 HAVING count(*) >= 3), g AS (SELECT id, b, CASE WHEN (b - lag(b) OVER (ORDER BY b)) ^ 2 <= 0.2::DOUBLE * 0.2::DOUBLE THEN 0 ELSE 1 END AS jump FROM c), r AS (SELECT id, sum(jump) OVER (ORDER BY b, id ROWS UNBOUNDED PRECEDING) AS r FROM g), k AS (SELECT r, row_number() OVER (ORDER BY min(id)) AS n FROM r GROUP BY r), n AS (SELECT id, n FROM r JOIN k USING (r)), m AS (SELECT p.id, min(n.n) AS n FROM p JOIN n ON n.id = p.o GROUP BY 1) SELECT v.id AS s_suppkey, coalesce(m.n, -1)::INTEGER AS cluster, v.id IN (SELECT id FROM c) AS core FROM v LEFT JOIN m ON m.id = v.id")
_simple("twostep", "supplier", lambda t: multivar.twostep(t.withColumn("k", (F.col("s_nationkey") % 3).cast("string")), ["s_acctbal"], ["k"])["bic"], None, 4)
_simple("twostep_lineitem", "lineitem", lambda t: multivar.twostep(t, ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"])["bic"].where("k = 1").select("k", "bic"), "WITH c AS (SELECT l_returnflag AS a, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), d AS (SELECT l_linestatus AS a, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n FROM c), e AS (SELECT (SELECT sum(-c.n / t.n * ln(c.n / t.n)) FROM c, t) + (SELECT sum(-d.n / t.n * ln(d.n / t.n)) FROM d, t) AS h, n, (SELECT count(*) - 1 FROM c) + (SELECT count(*) - 1 FROM d) + 4 AS free FROM t) SELECT 1 AS k, round(2 * n * (2 * 0.5 * ln(2) + h) + free * ln(n), 3) AS bic FROM e", 3)
_simple("klasifikasi_lda", "lineitem", lambda t: multivar.confusion(multivar.discriminant(t, ["l_quantity", "l_extendedprice"], "l_returnflag"), "l_returnflag"))
_simple("klasifikasi_knn", "supplier", lambda t: multivar.confusion(multivar.knn(t.withColumn("k", (F.col("s_nationkey") % 2).cast("string")), ["s_acctbal"], "k"), "k"))
_simple("pohon", "part", lambda t: trees.cart(t, "p_brand", ["p_size", "p_retailprice"], depth=3)[0])
_ROOT = "WITH c AS (SELECT x, f, v, y, count(*)::DOUBLE AS n FROM {long} GROUP BY ALL), t AS (SELECT p_brand AS y, count(*)::DOUBLE AS t FROM part GROUP BY 1), d AS (SELECT DISTINCT x, f, v FROM c), g AS (SELECT d.x, d.f, d.v, t.t, sum(coalesce(c.n, 0)) OVER (PARTITION BY d.x, t.y ORDER BY d.v) AS l FROM d CROSS JOIN t LEFT JOIN c ON c.x = d.x AND c.v = d.v AND c.y = t.y), s AS (SELECT x, f, v, lead(v) OVER (PARTITION BY x ORDER BY v) AS u, sum(l * l) / sum(l) + sum((t - l) * (t - l)) / nullif(sum(t - l), 0) - sum(t * t) / sum(t) AS gain FROM g GROUP BY x, f, v)"
_simple("pohon_akar", "part", lambda t: trees.root_split(t, "p_brand", ["p_size", "p_retailprice"]), _ROOT.format(long="(SELECT p_brand AS y, 'p_size' AS x, 0 AS f, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_brand, 'p_retailprice', 1, p_retailprice FROM part)") + " SELECT x AS variable, round((v + u) / 2, 6) AS threshold, round(gain, 6) AS gain FROM s WHERE u IS NOT NULL ORDER BY s.gain DESC, f, v LIMIT 1")
_simple("pohon_akar_regresi", "supplier", lambda t: trees.root_split(t, "s_acctbal", ["s_nationkey", "s_suppkey"], False), "WITH m AS (SELECT avg(s_acctbal) AS m FROM supplier), l AS (SELECT 's_nationkey' AS x, 0 AS f, s_nationkey::DOUBLE AS v, s_acctbal - m AS y FROM supplier, m UNION ALL SELECT 's_suppkey', 1, s_suppkey::DOUBLE, s_acctbal - m FROM supplier, m), c AS (SELECT x, f, v, count(*)::DOUBLE AS n, sum(y) AS y FROM l GROUP BY ALL), r AS (SELECT x, f, v, lead(v) OVER w AS u, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(n) OVER (PARTITION BY x) AS tn, sum(y) OVER (PARTITION BY x) AS ty FROM c WINDOW w AS (PARTITION BY x ORDER BY v)), s AS (SELECT *, y * y / n + (ty - y) * (ty - y) / (tn - n) - ty * ty / tn AS gain FROM r WHERE u IS NOT NULL) SELECT x AS variable, round((v + u) / 2, 6) AS threshold, round(gain, 3) AS gain FROM s ORDER BY s.gain DESC, f, v LIMIT 1", 3)
_simple("hutan", "supplier", lambda t: trees.random_forest(t.withColumn("k", (F.col("s_nationkey") % 2).cast("string")), "k", ["s_acctbal", "s_suppkey"], trees=20)[0])
_simple("boosting", "supplier", lambda t: trees.boosting(t, "s_acctbal", ["s_suppkey", "s_nationkey"], rounds=20)[0])
_simple("chaid", "orders", lambda t: trees.chaid(t, "o_orderstatus", ["o_orderpriority", "o_totalprice"]))
_simple("c45", "orders", lambda t: trees.c45(t, "o_orderstatus", ["o_orderpriority", "o_totalprice"], depth=2))
query("roc", "WITH v AS (SELECT n_chars AS s, count(*) FILTER (toxic = 1)::DOUBLE AS p, count(*) FILTER (toxic <> 1)::DOUBLE AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v) SELECT round(sum(p * (b + q / 2)) / (sum(p) * sum(q)), 6) AS auc, round(sum(p * (b + q / 2)), 6) AS u, sum(p)::BIGINT AS n_positive, sum(q)::BIGINT AS n_negative FROM w")(lambda s, d: _rounded(survival.roc(_quality(s, d).withColumn("toxic", F.col("toxic").cast("string")), "n_chars", "toxic", "1").select("auc", "u", "n_positive", "n_negative")))
_life = lambda t: t.groupBy("user_id").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("life"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.avg("value").alias("v"), F.when(F.first("user_id") % 2 == 0, "even").otherwise("odd").alias("half"))
_LIFE = "(SELECT user_id, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS life, max((event_type = 'purchase')::INT) AS bought, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM events GROUP BY user_id)"
_simple("kaplan_meier", "events", lambda t: survival.kaplan_meier(_life(t), "life", "bought", "half").select(F.col("group").alias("grp"), "time", "n", "d", "survival"), f"WITH t AS (SELECT half AS grp, life::DOUBLE AS time, sum(bought)::BIGINT AS d, count(*) AS c FROM {_LIFE} GROUP BY 1, 2), r AS (SELECT *, (sum(c) OVER (PARTITION BY grp ORDER BY time DESC))::BIGINT AS n FROM t) SELECT grp, time, n, d, round(CASE WHEN max((n = d)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN n > d THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER w) END, 6) AS survival FROM r WHERE d > 0 WINDOW w AS (PARTITION BY grp ORDER BY time)")
# the upper tail of chi-square with one degree of freedom, by the series of the error function
_ERF = "exp(-z * z) * list_sum(list_transform(range(0, 80), lambda k: pow(z, 2 * k + 1) / gamma(k + 1.5)))"
_LOGRANK = f"WITH t AS (SELECT life::DOUBLE AS time, sum(bought)::DOUBLE AS d, coalesce(sum(bought) FILTER (half = 'even'), 0)::DOUBLE AS d0, count(*) AS c, count(*) FILTER (half = 'even') AS c0 FROM {_LIFE} GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY time DESC)::DOUBLE AS n, sum(c0) OVER (ORDER BY time DESC)::DOUBLE AS n0 FROM t), u AS (SELECT sum(d0 - d * n0 / n) AS u, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n0 / n * (1 - n0 / n) ELSE 0 END) AS v FROM r WHERE d > 0), z AS (SELECT u * u / v AS chi, sqrt(u * u / v / 2) AS z FROM u) SELECT round(chi, 4) AS chi2, 1::BIGINT AS df, round(1 - {_ERF}, 4) AS p FROM z"
_simple("kaplan_meier_logrank", "events", lambda t: survival.log_rank(_life(t), "life", "bought", "half"), _LOGRANK, 4)
_simple("cox", "events", lambda t: survival.cox(_life(t), "life", "bought", ["v"])[0], None, 4)
_simple("cox_nelson_aalen", "events", lambda t: survival.nelson_aalen(_life(t), "life", "bought"), f"WITH t AS (SELECT life::DOUBLE AS time, sum(bought)::BIGINT AS d, count(*) AS c FROM {_LIFE} GROUP BY 1), r AS (SELECT time, d, (sum(c) OVER (ORDER BY time DESC))::BIGINT AS n FROM t) SELECT time, n, d, round(sum(d / n) OVER (ORDER BY time), 6) AS hazard FROM r WHERE d > 0")
_hourly = lambda t: t.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
_simple("acf_pacf", "events", lambda t: timeseries.acf_pacf(_hourly(t), "v", ["h"], 5).select("lag", "acf"), "WITH v AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT v - avg(v) OVER () AS d, row_number() OVER (ORDER BY h) AS r FROM v) SELECT k::INT AS lag, round((SELECT sum(a.d * b.d) FROM w a JOIN w b ON b.r = a.r + k) / (SELECT sum(d ^ 2) FROM w), 6) AS acf FROM range(1, 6) AS t(k)")
_simple("musiman", "events", lambda t: timeseries.decompose(_hourly(t), "v", ["h"], 24), "WITH v AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT row_number() OVER (ORDER BY h) - 1 AS r, v, count(*) OVER () AS n FROM v), t AS (SELECT r, v, CASE WHEN r >= 12 AND r + 12 < n THEN (sum(v) OVER (ORDER BY r ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) + (lag(v, 12) OVER (ORDER BY r) + lead(v, 12) OVER (ORDER BY r)) / 2) / 24 END AS trend FROM w), s AS (SELECT r % 24 AS phase, avg(v - trend) AS s FROM t GROUP BY 1), c AS (SELECT phase, s - avg(s) OVER () AS seasonal FROM s) SELECT r + 1 AS position, round(v, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(v - trend - seasonal, 6) AS remainder FROM t JOIN c ON r % 24 = phase")
_simple("musiman_holt_winters", "events", lambda t: timeseries.holt_winters(_hourly(t), "v", ["h"], 24))
_simple("arima", "events", lambda t: timeseries.arima(t.groupBy(F.to_date("ts").alias("h")).agg(F.avg("value").alias("v")), "v", ["h"], (1, 0, 1)), None, 3)
_simple("pakar", "events", lambda t: timeseries.tournament(t.groupBy(F.to_date("ts").alias("h")).agg(F.avg("value").alias("v")), "v", ["h"], 5), None, 3)
_simple("imputasi", "supplier", lambda t: trees.pool(trees.impute(t.select(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("s_acctbal"), F.col("s_nationkey").cast("double").alias("s_nationkey")), ["s_acctbal", "s_nationkey"]), "s_acctbal"), None, 3)
_simple("aliran_jendela", "events", lambda t: incremental.windowed(t, "ts", "event_type", "value", "1 day").select("event_type", "n", "mean", "min", "max"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type, date_trunc('day', ts)")
