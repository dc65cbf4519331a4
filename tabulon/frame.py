"""Typed columns with measurement levels over DataFrames, number parsing, and missing-value policies."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, ORDINAL, NOMINAL = "scale", "ordinal", "nominal"
ROW = "_rid"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_num(c: Column) -> Column:
    """Text as a number: white space around it goes; a comma without a point is a decimal comma; of both, the last is the
    decimal mark and the other groups thousands; what isn't a finite number is missing."""
    t = F.trim(c.cast("string"))
    comma, point = F.instr(t, ",") > 0, F.instr(t, ".") > 0
    last_comma = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    t = F.when(comma & point & last_comma, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma & point, F.replace(t, F.lit(","), F.lit(""))).when(comma, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(" "), F.lit("")))
    number = F.when(t.rlike(_NUMBER), t).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def num(df: DataFrame, name: str) -> Column:
    """A column as a number: numbers as they are (without NaN and infinities), text parsed."""
    kind = dict(df.dtypes)[name]
    if kind in ("string",):
        return parse_num(F.col(name))
    c = F.col(name).cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def text(c: Column) -> Column:
    """A column as text, blank ones missing."""
    return F.when(~blank(c), c.cast("string"))


def numbers(df: DataFrame, *names: str, listwise: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The named columns as doubles (and `keep` as text), without the rows that miss one of them if listwise."""
    out = df.select(*(num(df, n).alias(n) for n in names), *(text(F.col(k)).alias(k) for k in keep))
    return out.dropna() if listwise else out


def _shared(spark) -> str:
    """The session's folder for work that is kept: that of spark.checkpoint.dir; where it is unset, a temporary one, which only a
    session on one machine may have."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tabulon-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame as computed once, by a checkpoint in the session's shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame as computed once, as a table in the session's shared folder. For rounds of joins: a checkpoint keeps the size that
    its plan was estimated at, which joins multiply, and after some rounds planning is busy with these numbers alone."""
    place = f"{_shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def with_row(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row number _rid from 0 in the given order (all columns after it, so that it is total). Numbers are dealt per sorted
    range of rows and offset by the ranges before, so no task holds all rows. The ranges are checkpointed, as another
    evaluation, or a lost executor, could draw them elsewhere."""
    if ROW in df.columns:
        return df
    keys = [F.col(c) for c in (order or [])] + [F.col(c) for c, k in df.dtypes if not k.startswith(("map", "struct")) and c not in (order or [])]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = settled(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    # a row per partition: their running sum is a bounded window
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn(ROW, F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_before")


def measure_of(df: DataFrame, name: str) -> str:
    """The measurement level in the column's metadata; without one, numbers are scale and others nominal."""
    field = df.schema[name]
    return field.metadata.get("measure") or (NOMINAL if field.dataType.simpleString() in ("string", "boolean", "date", "timestamp") else SCALE)


def with_metadata(df: DataFrame, name: str, **values) -> DataFrame:
    """df with measure=, label=, decimals= or value_labels= set in a column's metadata."""
    return df.withColumn(name, F.col(name).alias(name, metadata=df.schema[name].metadata | values))


def infer_measures(df: DataFrame) -> DataFrame:
    """Text columns whose non-blank cells are all numbers become double (all-blank ones too); others stay text."""
    cols = [c for c, k in df.dtypes if k == "string"]
    if not cols:
        return df
    bad = df.agg(*(F.sum((~blank(F.col(c)) & parse_num(F.col(c)).isNull()).cast("long")).alias(c) for c in cols)).collect()[0]
    out = df.select(*((parse_num(F.col(c)).alias(c, metadata={"measure": SCALE}) if not bad[c] else F.col(c).alias(c, metadata={"measure": NOMINAL})) if c in cols else F.col(c) for c in df.columns))
    return out


def unique_name(name: str, taken: list[str]) -> str:
    """The name, or it with _2, _3 and so on where it is taken (whatever its case)."""
    low, k, out = {t.lower() for t in taken}, 1, name
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


def any_blank(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (blank(F.col(n)) for n in names))


def table(spark, rows: list[tuple], kind: str) -> DataFrame:
    """A small result table; NumPy's numbers become Python's."""
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], kind)
