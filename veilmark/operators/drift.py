"""Schema and distribution drift of a batch against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import significance as sig
from ..plans.running import count_quantiles, quantiles, running_totals
from . import profile

# Fixed values.
ALPHA, PSI_LIMIT, PSI_BINS, NULL_TOLERANCE, EPS, MAX_CATEGORIES, OTHER = 0.01, 0.1, 10, 0.1, 1e-6, 20, "__other__"


def tagged(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """value and is_ref (1 or 0) of both sides, nulls dropped."""
    side = lambda df, tag: df.select(F.col(f"`{column}`").alias("value"), F.lit(tag).alias("is_ref"))
    return side(reference, 1).union(side(batch, 0)).where("value is not null")


def value_counts(values: DataFrame) -> DataFrame:
    """value, r, b: rows of each distinct value on either side (partial aggregation before the shuffle)."""
    return values.groupBy("value").agg(F.sum("is_ref").alias("r"), F.sum(1 - F.col("is_ref")).alias("b"))


def psi(counts: DataFrame) -> DataFrame:
    """One row: psi over rows (r, b) of bins or categories."""
    total = counts.agg(F.sum("r").alias("n"), F.sum("b").alias("m"))
    ref, cur = F.greatest(F.col("r") / F.col("n"), F.lit(EPS)), F.greatest(F.col("b") / F.col("m"), F.lit(EPS))
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum((cur - ref) * F.log(cur / ref)), F.lit(0.0)).alias("psi"))  # one row of totals


def _bin_counts(rows: DataFrame, edges: list[float]) -> DataFrame:
    """value, r, b: rows (value, r, b) summed by bin, empty bins included."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    bin_of = F.size(F.filter(inner, lambda e: F.col("value").cast("double") >= e))
    counts = rows.groupBy(bin_of.alias("value")).agg(F.sum("r").alias("r"), F.sum("b").alias("b"))
    return rows.sparkSession.range(len(edges) - 1).withColumnRenamed("id", "value").join(counts, "value", "left").na.fill(0, ["r", "b"])


def psi_numeric(reference: DataFrame, batch: DataFrame, column: str, bins: int = PSI_BINS) -> DataFrame:
    """One row: psi over the reference's quantile bins (repeated edges once, outer bins open)."""
    edges = sorted(set(quantiles(reference, F.col(f"`{column}`"), [i / bins for i in range(bins + 1)])))
    if len(edges) < 2:
        return reference.sparkSession.sql("SELECT 0.0D AS psi")
    return psi(_bin_counts(tagged(reference, batch, column).select("value", F.col("is_ref").alias("r"), (1 - F.col("is_ref")).alias("b")), edges))


def psi_of_counts(values: DataFrame, bins: int = PSI_BINS) -> float:
    """psi_numeric() of rows (value double, r, b)."""
    held = values.where("r > 0").select(F.col("value").alias("x"), F.col("r").alias("n"))
    edges = sorted(set(count_quantiles(held, [i / bins for i in range(bins + 1)])))
    return float(psi(_bin_counts(values, edges)).first().psi) if len(edges) > 1 else 0.0


def psi_categorical(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    return psi(value_counts(tagged(reference, batch, column)))


def two_sample(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """One row: n, m, ks, u, cvm, tie_sum of the two samples.

    Works on distinct values; running counts go through range parts, so no task holds all values.
    """
    values = tagged(reference, batch, column).select(F.col("value").cast("double").alias("value"), "is_ref").where(~F.isnan("value"))
    return two_sample_of_counts(value_counts(values))


def two_sample_of_counts(values: DataFrame) -> DataFrame:
    """two_sample() of rows (value double, r, b), which are read several times."""
    counts = running_totals(values, "value", {"cr": "r", "cb": "b"})
    total = values.agg(F.sum("r").alias("n"), F.sum("b").alias("m"))
    rows = counts.crossJoin(F.broadcast(total))  # one row of totals
    d = lambda c: F.col(c).cast("double")
    t = d("r") + d("b")
    rank = d("cr") + d("cb") - (t - 1) / 2  # average rank of a tie

    def squares(k, c):  # sum of (rank - i)^2 over the places i that ties of one side take
        before = c - k
        s1 = k * (2 * c - k + 1) / 2
        s2 = c * (c + 1) * (2 * c + 1) / 6 - before * (before + 1) * (2 * before + 1) / 6
        return k * rank * rank - 2 * rank * s1 + s2

    out = rows.agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.abs(d("cr") / d("n") - d("cb") / d("m"))).alias("ks"),
        F.sum(d("r") * rank).alias("ranks"), F.sum(squares(d("r"), d("cr"))).alias("sr"), F.sum(squares(d("b"), d("cb"))).alias("sb"), F.sum(t * t * t - t).alias("tie_sum"),
    )
    n, m = d("n"), d("m")
    cvm = (n * F.col("sr") + m * F.col("sb")) / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m))
    return out.select("n", "m", "ks", (F.col("ranks") - n * (n + 1) / 2).alias("u"), cvm.alias("cvm"), "tie_sum")


def p_values(row) -> list[float]:
    """Of a row of two_sample: Kolmogorov-Smirnov, Mann-Whitney, Cramér-von Mises; exact laws for small samples."""
    n, m = int(row.n), int(row.m)
    return [sig.kolmogorov_p(row.ks, n, m), sig.mann_whitney_two_sided(row.u, n, m, row.tie_sum), sig.cramer_von_mises_two_sided(row.cvm, n, m)]


def chi_square(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """One row: chi2 (Yates-corrected at one degree of freedom) and dof of homogeneity over the categories."""
    return chi_square_of_counts(value_counts(tagged(reference, batch, column)))


def chi_square_of_counts(counts: DataFrame) -> DataFrame:
    """chi_square() of rows (r, b), one a category."""
    total = counts.agg(F.sum("r").alias("n"), F.sum("b").alias("m"), F.count("*").alias("k"))
    rows = counts.crossJoin(F.broadcast(total))  # one row of totals
    col = F.col("r") + F.col("b")

    def cell(seen: str, own: str):
        expected = col * F.col(own) / (F.col("n") + F.col("m"))
        gap = F.abs(F.col(seen) - expected)
        gap = F.when(F.col("k") == 2, F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
        return gap * gap / expected

    out = rows.agg(F.sum(cell("r", "n") + cell("b", "m")).alias("s"), F.coalesce(F.first("k"), F.lit(0)).alias("k"))
    return out.select(F.when(F.col("k") < 2, 0.0).otherwise(F.col("s")).alias("chi2"), F.greatest(F.col("k") - 1, F.lit(0)).alias("dof"))


def pooled(reference: DataFrame, batch: DataFrame, column: str, keep: int = MAX_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Both sides with categories outside the reference's most frequent ones as one; ties go by name."""
    x = F.col(f"`{column}`").cast("string").alias(column)
    ref, cur = reference.select(x), batch.select(x)
    top = [r[0] for r in ref.dropna().groupBy(column).count().orderBy(F.desc("count"), column).limit(keep).collect()]
    fold = F.when(F.col(column).isin(top), F.col(column)).when(F.col(column).isNotNull(), OTHER)
    return ref.withColumn(column, fold), cur.withColumn(column, fold)


def unseen_categories(reference: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    return batch.select(column).dropna().subtract(reference.select(column).dropna())


def check_schema(reference: DataFrame, batch: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, problem, detail: missing and unexpected columns, type mismatches, null rates that grew by over 0.1."""
    columns = columns or reference.columns
    roles = {r.column: r.role for r in profile.column_roles(reference.select(*[c for c in columns if c in batch.columns])).collect()}  # one row a column
    return reference.sparkSession.createDataFrame(_schema_rows(reference, batch, columns, roles), "column string, problem string, detail double")


def _schema_rows(reference: DataFrame, batch: DataFrame, columns: list[str], roles: dict[str, str | None]) -> list[tuple]:
    rows = [(c, "missing", None) for c in columns if c not in batch.columns] + [(c, "unexpected", None) for c in batch.columns if c not in reference.columns]
    both = [c for c in columns if c in batch.columns]
    if both:
        rate = [F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"rate{i}") for i, c in enumerate(both)]
        parsed = lambda c: F.count(profile.numeric_values(F.col(f"`{c}`"), batch.schema[c].dataType))
        share = [F.try_divide(parsed(c), F.count(F.col(f"`{c}`"))).alias(f"share{i}") for i, c in enumerate(both) if roles.get(c) == "numeric"]
        before, after = reference.agg(*rate).first(), batch.agg(*rate, *share).first()
        for i, c in enumerate(both):
            if roles.get(c) == "numeric" and after[f"share{i}"] is not None and after[f"share{i}"] < 0.95:
                rows.append((c, "type mismatch", float(after[f"share{i}"])))
            if (after[f"rate{i}"] or 0) - (before[f"rate{i}"] or 0) > NULL_TOLERANCE:
                rows.append((c, "null rate", float(after[f"rate{i}"] - before[f"rate{i}"])))
    return rows


def check_drift(reference: DataFrame, batch: DataFrame, features: list[str] | None = None, exclude: tuple[str, ...] = (), alpha: float = ALPHA, psi_limit: float = PSI_LIMIT) -> DataFrame:
    """column, kind, psi, rejected, tests, drifted, unseen: a feature drifted when most of its tests reject at
    alpha / features and its PSI reaches the limit."""
    return drift_and_problems(reference, batch, features, exclude, alpha, psi_limit)[0]


def drift_and_problems(
    reference: DataFrame, batch: DataFrame, features: list[str] | None = None, exclude: tuple[str, ...] = (), alpha: float = ALPHA, psi_limit: float = PSI_LIMIT
) -> tuple[DataFrame, int]:
    """check_drift and the number of problems of check_schema, with the roles found once."""
    spark = reference.sparkSession
    found = profile.column_roles(reference.select(*[c for c in reference.columns if c in batch.columns])).collect()  # one row a column
    problems = _schema_rows(reference, batch, reference.columns, {r.column: r.role for r in found})
    mismatched = {c for c, problem, _ in problems if problem == "type mismatch"}
    columns = [c for c in features or reference.columns if c not in exclude and c in batch.columns and c not in mismatched]
    known = {r.column: r for r in found}
    rows = [row for c in columns if (row := _feature(reference, batch, c, known[c].role, known[c].reason))]
    level = alpha / max(1, len(rows))
    out = [(c, role, value, sum(p < level for p in ps), len(ps), 2 * sum(p < level for p in ps) > len(ps) and value >= psi_limit, unseen) for c, role, value, ps, unseen in rows]
    return spark.createDataFrame(out, "column string, kind string, psi double, rejected int, tests int, drifted boolean, unseen long"), len(problems)


def _feature(reference: DataFrame, batch: DataFrame, c: str, role: str | None, reason: str | None) -> tuple | None:
    """column, role, psi, p-values, unseen categories of one feature: its distinct values are counted once for all tests."""
    if not role and reason != "constant":
        return None
    role = role or ("numeric" if profile.is_numeric(reference.schema[c].dataType) else "categorical")
    parse = {"categorical": lambda x, _: x.cast("string"), "datetime": profile.datetime_days}.get(role, profile.numeric_values)
    ref, cur = (df.select(parse(F.col(f"`{c}`"), df.schema[c].dataType).alias(c)) for df in (reference, batch))
    counts = value_counts(tagged(ref, cur, c)).persist()
    try:
        size = counts.agg(F.sum("r").alias("n"), F.sum("b").alias("m"), F.count_if(F.col("r") == 0).alias("unseen")).first()
        if not size.n or not size.m:
            return None
        if role != "categorical":
            return c, role, psi_of_counts(counts), p_values(two_sample_of_counts(counts).first()), 0
        top = [r[0] for r in counts.where("r > 0").orderBy(F.desc("r"), "value").limit(MAX_CATEGORIES).collect()]
        fold = F.when(F.col("value").isin(top), F.col("value")).otherwise(OTHER)
        folded = counts.groupBy(fold.alias("value")).agg(F.sum("r").alias("r"), F.sum("b").alias("b"))
        x = chi_square_of_counts(folded).first()
        return c, role, float(psi(folded).first().psi), [sig.chi2_sf(x.chi2, x.dof) if x.dof else 1.0], size.unseen
    finally:
        counts.unpersist()
