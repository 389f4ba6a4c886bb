"""Column roles, tasks, row cleaning and feature expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import name_tokens

# Fixed values.
ID_TOKENS = {"id", "uuid", "guid", "index", "key", "identifier"}
ID_RATIO, ID_ROWS, PARSE_RATE, TEXT_DISTINCT, TEXT_RATIO, SAMPLE_ROWS = 0.95, 20, 0.95, 100, 0.5, 2000
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
LEADING_ZERO = r"^[+-]?0[0-9]"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy"]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_values(x: Column, kind: T.DataType) -> Column:
    """Doubles, with text such as "1,234" parsed; anything else, NaN included, is null."""
    if is_numeric(kind):
        return F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    text = F.replace(F.trim(x.cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parsed_times(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return x.cast("timestamp")
    text = F.trim(x.cast("string"))
    text = F.when(text.rlike("^[0-9A-Za-z+-]") & text.rlike("[0-9]"), text)  # any other text has no date; a failed parse is dear
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def datetime_days(x: Column, kind: T.DataType) -> Column:
    return F.datediff(parsed_times(x, kind).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def category_text(x: Column, kind: T.DataType) -> Column:
    """3, 3.0 and "3" are one category; text is trimmed; null stays."""
    if isinstance(kind, T.FractionalType):
        y = x.cast("double")
        return F.when(F.isnan(y), None).when(y % 1 == 0, y.cast("long").cast("string")).otherwise(y.cast("string"))
    return F.trim(x.cast("string"))


@dataclass(frozen=True)
class FeaturePlan:
    roles: dict[str, str] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)


def column_roles(df: DataFrame, label: str | None = None, exclude: tuple[str, ...] = (), sample_rows: int | None = None) -> DataFrame:
    """column, role (null if dropped), reason: one pass over the table, one row for each column."""
    columns = [f for f in df.schema.fields if f.name != label and f.name not in exclude]
    if sample_rows:
        df = df.orderBy(F.xxhash64(*[f.name for f in columns])).limit(sample_rows)
    stats = []
    for i, f in enumerate(columns):
        x = F.col(f"`{f.name}`")
        x = F.nanvl(x, F.lit(None)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else x
        text = F.trim(x.cast("string"))
        named = bool(name_tokens(f.name) & ID_TOKENS) or f.name.startswith("Unnamed:")
        # an exact count of distinct values shuffles them all; where only a constant matters the extremes show it
        exact = named or isinstance(f.dataType, T.StringType) or not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        distinct = F.count_distinct(x) if exact else F.when(F.min(x) == F.max(x), 1).otherwise(2)
        number = numeric_values(x, f.dataType) if not isinstance(f.dataType, T.BooleanType) else F.lit(None).cast("double")
        stats += [F.count(x).alias(f"n{i}"), distinct.alias(f"u{i}"), F.count(number).alias(f"num{i}"), F.count(parsed_times(x, f.dataType) if isinstance(f.dataType, T.StringType) else F.lit(None)).alias(f"d{i}")]
        stats += [F.coalesce(F.bool_or(text.rlike(LEADING_ZERO)), F.lit(False)).alias(f"z{i}"), F.coalesce(F.bool_and(text.rlike("^[0-9]+$")), F.lit(False)).alias(f"b{i}")]
    wide = df.agg(*stats)
    rows = []
    for i, f in enumerate(columns):
        n, u = F.col(f"n{i}"), F.col(f"u{i}")
        named = bool(name_tokens(f.name) & ID_TOKENS) or f.name.startswith("Unnamed:")
        reason = F.when(n == 0, "all values missing").when(u == 1, "constant")
        if named:
            reason = reason.when((n >= ID_ROWS) & (u / n >= ID_RATIO), "row identifier")
        if isinstance(f.dataType, T.BooleanType):
            role = F.lit("categorical")
        elif is_numeric(f.dataType):
            role = F.lit("numeric")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = F.lit("datetime")
        else:
            numeric = ~F.col(f"z{i}") & (F.col(f"num{i}") / n >= PARSE_RATE)
            dated = ~F.col(f"b{i}") & (F.col(f"d{i}") / n >= PARSE_RATE)
            free = (u >= TEXT_DISTINCT) & (u / n >= TEXT_RATIO)
            role = F.when(numeric, "numeric").when(dated, "datetime").when(free, F.lit(None).cast("string")).otherwise("categorical")
            reason = F.coalesce(reason, F.when(~numeric & ~dated & free, "high-cardinality text (identifier or free text)"))
        rows.append(F.struct(F.lit(f.name).alias("column"), F.when(reason.isNull(), role).alias("role"), reason.alias("reason")))
    return wide.select(F.inline(F.array(*rows)))


def infer_plan(df: DataFrame, label: str | None = None, exclude: tuple[str, ...] = ()) -> FeaturePlan:
    rows = column_roles(df, label, exclude, SAMPLE_ROWS).collect()  # one row a column
    return FeaturePlan({r.column: r.role for r in rows if r.role}, {r.column: r.reason for r in rows if not r.role})


def apply_plan(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """The planned features of any table: missing columns are null, others are ignored, dates become four parts (Monday is 0)."""
    out = []
    for name, role in plan.roles.items():
        present = name in df.columns
        kind = df.schema[name].dataType if present else T.StringType()
        x = F.col(f"`{name}`") if present else F.lit(None).cast("string")
        if role == "numeric":
            out.append(numeric_values(x, kind).alias(name))
        elif role == "categorical":
            out.append(category_text(x, kind).alias(name))
        else:
            t = parsed_times(x, kind)
            out += [F.year(t).alias(f"{name}_year"), F.month(t).alias(f"{name}_month"), F.weekday(t).alias(f"{name}_dayofweek"), datetime_days(x, kind).alias(f"{name}_days")]
    return df.select(*out)


def infer_task(df: DataFrame, label: str) -> DataFrame:
    """One row: task, n_classes. Numbers with a fraction, or integers of more than ten values, make a regression."""
    kind = df.schema[label].dataType
    x = F.col(label)
    whole = F.bool_and(x.cast("double") % 1 == 0) if is_numeric(kind) else F.lit(True)
    n = df.agg(F.count_distinct(x).alias("n_classes"), whole.alias("whole"))
    regression = (~F.col("whole") | (F.col("n_classes") > 10)) if is_numeric(kind) else F.lit(False)
    return n.select(F.when(F.col("n_classes") < 2, "undefined").when(regression, "regression").when(F.col("n_classes") == 2, "binary").otherwise("multiclass").alias("task"), "n_classes")


def clean_rows(df: DataFrame, label: str, min_class_rows: int = 3, regression: bool = False) -> DataFrame:
    """Rows with a label, each once, of classes with at least min_class_rows rows."""
    known = df.where(F.col(label).isNotNull()).dropDuplicates()
    if regression:
        return known
    large = known.groupBy(label).count().where(F.col("count") >= min_class_rows).select(label)
    return known.join(large, label, "left_semi")


def restore_types(df: DataFrame) -> DataFrame:
    """All-number text columns become long (whole and complete) or double; columns with a leading-zero code stay text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    stats = []
    for i, c in enumerate(texts):
        x = F.trim(F.col(f"`{c}`"))
        blank = x.isNull() | (x == "")
        number = F.when(x.rlike(NUMBER), x.try_cast("double"))
        stats += [F.count_if(~blank & number.isNull()).alias(f"bad{i}"), F.count_if(~blank & x.rlike(LEADING_ZERO)).alias(f"zero{i}"), F.count_if(blank).alias(f"blank{i}"), F.count_if(~blank).alias(f"n{i}"), F.coalesce(F.bool_and(number % 1 == 0), F.lit(False)).alias(f"whole{i}")]
    found = df.agg(*stats).first()
    out = []
    for c in df.columns:
        if c not in texts or found[f"bad{(i := texts.index(c))}"] or found[f"zero{i}"] or not found[f"n{i}"]:
            out.append(F.col(f"`{c}`"))
            continue
        number = F.trim(F.col(f"`{c}`")).try_cast("double")
        out.append((number.cast("long") if found[f"whole{i}"] and not found[f"blank{i}"] else number).alias(c))
    return df.select(*out)
