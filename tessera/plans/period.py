"""Profiles of ordered periods (here: order years) and how they move."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.storage import table


def year_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy("year").agg(
        F.avg("o_totalprice").alias("mean_price"),
        F.stddev_pop("o_totalprice").alias("std_price"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share_f"),
    )


def z(col: str):
    """Population z-score over all rows of a small, already grouped table; a constant column gives 0."""
    w = Window.partitionBy()
    sd = F.stddev_pop(col).over(w)
    return (F.col(col) - F.avg(col).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)


FEATURES = ("mean_price", "std_price", "share_f")


def transition_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    zed = year_profile(spark, sf_dir).select("year", *(z(c).alias(c) for c in FEATURES))
    w = Window.orderBy("year")  # one row a period
    moved = zed.select(
        F.lag("year").over(w).alias("from_year"), F.col("year").alias("to_year"),
        F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in FEATURES)).alias("d"),
    ).where(F.col("from_year").isNotNull())
    years = F.col("to_year") - F.col("from_year")
    return moved.select(
        F.col("from_year").cast("long"), F.col("to_year").cast("long"), F.round("d", 6).alias("distance"),
        F.round(F.try_divide(F.col("d"), years), 6).alias("velocity"),
    )


QUERIES = {"period_transition_velocity": transition_velocity}
SQL = {
    "period_transition_velocity": """
with p as (select year(o_orderdate) as year, avg(o_totalprice) a, stddev_pop(o_totalprice) b,
                  avg(case when o_orderstatus = 'F' then 1.0::double else 0.0::double end) c from orders group by 1),
s as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from p),
z as (select year, (a - ma) / case when sa = 0 then 1 else sa end a, (b - mb) / case when sb = 0 then 1 else sb end b,
             (c - mc) / case when sc = 0 then 1 else sc end c from p, s),
l as (select lag(year) over (order by year) f, year t, a - lag(a) over (order by year) da,
             b - lag(b) over (order by year) db, c - lag(c) over (order by year) dc from z)
select f::bigint from_year, t::bigint to_year, round(sqrt(da*da + db*db + dc*dc), 6) distance,
       round(sqrt(da*da + db*db + dc*dc) / nullif(t - f, 0), 6) velocity from l where f is not null"""
}
