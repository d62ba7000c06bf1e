"""Audits and summaries: profiles, concentration, crosstabs, stability, confusion, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import durable


def counted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each column has each value (as text), null included.

    Columns are stacked and summed where the rows lie, so that what is shuffled is different values, not rows.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("_x")).groupBy(F.col("_x.column").alias("column"), F.col("_x.value").alias("value")).agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, null_share, values): one pass over the table, whose columns are profiled together."""
    counts = counted_values(df, columns)
    one = counts.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("values"))
    return one.withColumn("null_share", F.when(F.col("n") > 0, F.col("nulls") / F.col("n")))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column for each name of shares): exact quantiles with linear interpolation, nulls left out.

    From counted values with running sums: a group's different values are range-partitioned, each range counts on from the
    totals of the ranges before it, and only the values on either side of a quantile meet.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranged = durable(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    whole = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).withColumn("_n", F.sum("_t").over(Window.partitionBy(*by)))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    placed = ranged.withColumn("_in", upto).join(whole, [*by, "_part"]).withColumn("_last", F.col("_before") + F.col("_in"))  # places _last - _c + 1 .. _last
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1) + 1
        here = lambda place: F.max(F.when((F.col("_last") >= place) & (F.col("_last") - F.col("_c") < place), F.col("_v")))
        low, high = here(F.floor(at)), here(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*by).agg(*out)


def distinct_maps(df: DataFrame, by: str, fields: dict[str, Column]) -> DataFrame:
    """(by, items): the different maps of fields that occur in each group, in order; rows are made different before they meet."""
    once = df.select(by, *[c.alias(k) for k, c in fields.items()]).distinct()
    return once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of non-null keys."""
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(present).groupBy(*keys).agg(F.count("*").alias("n"))


def gini(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, gini): from sums over equal values, so that a group's rows never meet in one place.

    With values ascending, the ranks of c equal values that follow r smaller ones sum to c r + c (c + 1) / 2.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    sums = ranked.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col(value)).alias("total"), F.sum(F.col("ranks") * F.col(value)).alias("weighted"))
    return sums.select(group, F.when((F.col("n") > 0) & (F.col("total") != 0), (2 * F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))).alias("gini"))


def concentration(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, hhi): sum of squared percentage shares of a group's members."""
    counts = df.groupBy(group, member).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s")).select(group, (10000.0 * F.col("s") / (F.col("t") * F.col("t"))).alias("hhi"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with margins named All."""
    cube = df.groupBy(row, column).agg(F.count("*").alias("n")).cube(row, column).agg(F.sum("n").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    named = cube.select(F.when(F.col("_r") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("_c") == 1, "All").otherwise(F.col(column)).alias("_col"), "n")
    return named.groupBy(row).pivot("_col", [*values, "All"]).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0)


def top_crosstab(df: DataFrame, row: str, column: str, rows: int, values: list[str]) -> DataFrame:
    """Counts for the most frequent rows and the given columns, 0 where there is none."""
    best = df.groupBy(row).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), row).limit(rows).select(row)
    return df.join(best, row, "left_semi").groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def orphans(edges: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """(relation, n, missing_source, missing_target) of edges (src, dst) against their node keys (id)."""
    out = None
    for name, (links, sources, targets) in edges.items():
        s, t = sources.select(F.col("id").alias("src"), F.lit(1).alias("_s")).distinct(), targets.select(F.col("id").alias("dst"), F.lit(1).alias("_t")).distinct()
        one = links.select("src", "dst").join(s, "src", "left").join(t, "dst", "left").agg(
            F.lit(name).alias("relation"), F.count("*").alias("n"), F.count_if(F.col("_s").isNull()).alias("missing_source"), F.count_if(F.col("_t").isNull()).alias("missing_target")
        )
        out = one if out is None else out.unionByName(one)
    return out


def stability(df: DataFrame, case: str, values: list[str]) -> DataFrame:
    """(field, stable_share): share of cases whose runs all agree."""
    per = df.groupBy(case).agg(*[(F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit(""))) == 1).cast("int").alias(v) for v in values])
    means = per.agg(*[F.avg(v).alias(v) for v in values])
    return means.select(F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).alias("stable_share")) for v in values])).alias("r")).select("r.*")


def confusion(df: DataFrame, true: str, predicted: str, delta: Column) -> DataFrame:
    return df.groupBy(true, predicted).agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta")).withColumn("correct", F.col(true) == F.col(predicted))


def ratio_of_sums(part: Column, whole: Column) -> Column:
    return F.when(F.sum(whole) != 0, F.sum(part) / F.sum(whole))


def best_per_key(df: DataFrame, key: str, order: list[Column], most: int, by: Column) -> DataFrame:
    """The best row of each key, and of these the first `most` by `by`."""
    one = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")
    return one.orderBy(by).limit(most)


def strata(df: DataFrame, flags: dict[str, Column], measures: list[Column]) -> DataFrame:
    """The same measures over several, perhaps overlapping, strata: each row is sent to the strata that it is in."""
    where = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))
    return df.withColumn("stratum", where).groupBy("stratum").agg(*measures)
