"""Column typing and encoding. Dictionaries are fitted on train rows and applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ranks import number_rows

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def finite_or_null(c: Column) -> Column:
    """NaN and infinities count as missing."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_number(col: str) -> Column:
    """Per-value coercion: unparseable, NaN and infinite values become null."""
    return finite_or_null(F.col(col).try_cast("double"))


def epoch_seconds(col: str, dtype: T.DataType | None = None) -> Column:
    """Whole seconds since 1970-01-01 as double; a zone-less timestamp is read as UTC whatever the session zone."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{col}`) as double)")
    return F.unix_seconds(F.col(col).cast("timestamp")).cast("double")


@dataclass(frozen=True)
class ColumnKinds:
    """Resolved kinds: ``numeric`` columns become doubles, ``categorical`` ones strings; order is the frame's."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    order: tuple[str, ...]

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = []
        for c in self.order:
            dtype = df.schema[c].dataType
            if c in self.categorical:
                out.append(F.col(c).cast("string").alias(c))
            elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out.append(epoch_seconds(c, dtype).alias(c))
            else:
                out.append(to_number(c).alias(c))
        return df.select(*keep, *out)


def resolve_kinds(df: DataFrame, cols: Sequence[str], categorical: Sequence[str] = ()) -> ColumnKinds:
    """Named columns stay categorical; a text column is numeric only if every present value parses (one pass)."""
    text = [c for c in cols if c not in categorical and isinstance(df.schema[c].dataType, T.StringType)]
    failed = {}
    if text:
        failed = df.agg(*[F.max(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
                          for c in text]).first().asDict()
    cat = [c for c in cols if c in categorical or failed.get(c)]
    return ColumnKinds(tuple(c for c in cols if c not in cat), tuple(cat), tuple(cols))


def cast_failures(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(column, present, failed)`` behind :func:`resolve_kinds`."""
    structs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("present"),
                        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias("failed"))
               for c in cols]
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def fit_first_seen_codes(train: DataFrame, col: str, row_id: str, code: str = "code") -> DataFrame:
    """``(col, code)``: code 0, 1, … by first appearance in ``row_id`` order."""
    seen = train.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(row_id).alias("_first"))
    return number_rows(seen, ["_first", col], code).drop("_first")


def apply_codes(df: DataFrame, codes: DataFrame, col: str, code: str = "code", out: str | None = None) -> DataFrame:
    """Left join of the dictionary; missing and unseen values get -1."""
    res = df.join(codes.withColumnRenamed(code, "_code"), col, "left")
    return res.withColumn(out or code, F.coalesce("_code", F.lit(-1)).cast("bigint")).drop("_code")


def fit_label_codes(train: DataFrame, label: str, by: Sequence[str] = (), code: str = "code") -> DataFrame:
    """``(*by, label, code)``: classes numbered in sorted order, per dataset when ``by`` is given."""
    classes = train.filter(F.col(label).isNotNull()).select(*by, label).distinct()
    return number_rows(classes, [label], code, by)


def apply_label_codes(df: DataFrame, codes: DataFrame, label: str, by: Sequence[str] = (), code: str = "code",
                      check: bool = True) -> DataFrame:
    """Join the class codes; an unseen label is an error (checked by an anti-join)."""
    keys = [*by, label]
    if check:
        unseen = df.join(codes, keys, "left_anti").select(*keys).distinct().limit(5).collect()
        if unseen:
            raise ValueError(f"labels not seen in training: {[tuple(r) for r in unseen]}")
    return df.join(codes, keys, "left")


def one_hot(code: str, num_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: (i == F.col(code)).cast("int"))


def infer_categorical(df: DataFrame, cols: Sequence[str], provided: Sequence[str] | None = None, *,
                      min_samples: int = 100, max_unique: int = 30, min_unique: int = 4) -> DataFrame:
    """Rows ``(column, distinct_values, is_categorical)`` from cardinality alone.

    Declared columns stay categorical up to ``max_unique`` values; without a declaration a column is categorical when
    there are more than ``min_samples`` rows and fewer than ``min_unique`` values. Values are counted exactly: equal ones
    collapse in the tasks that read them, the rest in one shuffle.
    """
    found = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    table = found.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("distinct_values")) for i, c in enumerate(cols)])))
    rule = F.when(F.col("column").isin(list(provided or [])), F.col("distinct_values") <= max_unique)
    default = F.lit(False) if provided is not None else (
        (F.col("_rows") > min_samples) & (F.col("distinct_values") < min_unique))
    return table.withColumn("is_categorical", rule.otherwise(default)).drop("_rows")


def join_ids(ids: str, sep: str = "_") -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), sep)
