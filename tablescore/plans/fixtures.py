"""Table pairs made from the star schema: each order is a grid, and its prediction is that grid with
one of eight changes, by l_orderkey mod 8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: The cells of a line item, as text.
CELLS = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def order_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, truth): rows in order of the whole line, numbers before text. One shuffle, by order."""
    line = F.struct("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("l_quantity"), "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"))
    cells = lambda x: F.array(*(x[c].cast("string") for c in CELLS))
    return rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("line")), cells).alias("truth"))


def changed(key: Column, grid: Column) -> Column:
    """Same; first row gone; last row gone; middle row gone; second and third column swapped; a character
    less in the first cells; one more column; first row twice."""
    n = F.size(grid)
    kind = key % 8
    return (
        F.when((kind == 1) & (n > 1), F.slice(grid, 2, n - 1))
        .when((kind == 2) & (n > 1), F.slice(grid, 1, n - 1))
        .when((kind == 3) & (n > 2), F.concat(F.slice(grid, F.lit(1), F.floor(n / 2).cast("int")), F.slice(grid, F.floor(n / 2).cast("int") + 2, n)))
        .when(kind == 4, F.transform(grid, lambda r: F.array(r[0], r[2], r[1], r[3], r[4])))
        .when(kind == 5, F.transform(grid, lambda r: F.concat(F.array(F.substring(r[0], F.lit(2), F.lit(100))), F.slice(r, 2, 4))))
        .when(kind == 6, F.transform(grid, lambda r: F.concat(r, F.array(F.lit("x")))))
        .when(kind == 7, F.concat(F.slice(grid, 1, 1), grid))
        .otherwise(grid)
    )


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, truth, prediction)."""
    return order_grids(spark, sf_dir).withColumn("prediction", changed(F.col("l_orderkey"), F.col("truth")))
