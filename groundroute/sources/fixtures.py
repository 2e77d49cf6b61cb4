"""Synthetic images, labels, markers and sweep records from the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .images import pack_bands

SIDE = 30


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, o=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x, r, g, b, lab: 30 x 30 images, an incomplete last one dropped."""
    return _sql(spark, sf_dir, """
        with b as (select o_orderkey div 900 as image, (o_orderkey % 900) div 30 as y, o_orderkey % 30 as x,
                          cast(floor(o_totalprice) as bigint) as p, o_custkey as cu, o_orderkey as k from {o}),
             n as (select count(*) div 900 as images from {o}),
             q as (select *, ((x div 6) * (y div 6) + image) % 3 as rough, (image % 4 = 3 and x between 12 and 17) as wall
                   from b where image < (select images from n)),
             a as (select *, case when wall then 120 when rough = 0 then 2 when rough = 1 then 12 else 90 end as amp from q)
        select image, y, x, 100 + p % amp as r, 90 + cu % amp as g, 80 + (k * 31) % amp as b,
               case when wall or rough = 2 then 0 else 255 end as lab from a""")


def bands(rows: DataFrame, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """The images (or labels: channel lab) as bands; all have the same sides."""
    return pack_bands(rows, (SIDE, SIDE), channels)


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, kind, y, x, gray: four bright squares an image."""
    return pixels(spark, sf_dir).selectExpr(
        "image", "if(image % 4 = 3, 'unreachable', 'reachable') as kind", "y", "x",
        "if((abs(y - 4) <= 2 or abs(y - 25) <= 2) and (abs(x - 4) <= 2 or abs(x - 25) <= 2), 255, 0) as gray",
    )


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, kind, ord, y, x: the squares' centres."""
    return pixels(spark, sf_dir).where("(y = 4 or y = 25) and (x = 4 or x = 25)").selectExpr("image", "if(image % 4 = 3, 'unreachable', 'reachable') as kind", "cast((y div 20) * 2 + x div 20 as int) as ord", "y", "x")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep records of the results schema."""
    return _sql(spark, sf_dir, """
        select *, case when path_existence then (case when path_found then raw_score else 0.0D end)
                       else (case when path_found then 0.0D else 1.0D end) end as path_score
        from (select 'aerial0' || cast(1 + o_orderkey % 8 as string) as image, 'tf_grayhist' as traversability_function,
                     cast(6 + 2 * (o_custkey % 10) as int) as region_size, (1 + (o_orderkey div 7) % 10) / 10.0D as cut_threshold,
                     o_orderkey % 3 <> 0 as path_existence, o_custkey % 5 <> 0 as path_found,
                     cast(o_totalprice as double) / 1000000 as matrix_build_time, cast(o_totalprice as double) / 2000000 as graph_build_time,
                     cast(o_totalprice as double) / 4000000 as path_build_time, (o_orderkey % 101) / 100.0D as raw_score,
                     cast(10 + o_orderkey % 90 as int) as path_length, o_orderkey as id from {o})""")


PIXELS_SQL = """
px_b as (select o_orderkey // 900 as image, (o_orderkey % 900) // 30 as y, o_orderkey % 30 as x,
                cast(floor(o_totalprice) as bigint) as p, o_custkey as cu, o_orderkey as k from orders),
px_q as (select *, ((x // 6) * (y // 6) + image) % 3 as rough, (image % 4 = 3 and x between 12 and 17) as wall
         from px_b where image < (select count(*) // 900 from orders)),
px_a as (select *, case when wall then 120 when rough = 0 then 2 when rough = 1 then 12 else 90 end as amp from px_q),
pixels as (select image, y, x, 100 + p % amp as r, 90 + cu % amp as g, 80 + (k * 31) % amp as b,
                  case when wall or rough = 2 then 0 else 255 end as lab from px_a)"""

KEYPOINTS_SQL = """
keypoints as (select image, case when image % 4 = 3 then 'unreachable' else 'reachable' end as kind,
                     cast((y // 20) * 2 + x // 20 as int) as ord, y, x from pixels where (y = 4 or y = 25) and (x = 4 or x = 25))"""

RESULTS_SQL = """
results as (
  select *, case when path_existence then (case when path_found then raw_score else 0.0::double end)
                 else (case when path_found then 0.0::double else 1.0::double end) end as path_score
  from (select 'aerial0' || cast(1 + o_orderkey % 8 as varchar) as image, 'tf_grayhist' as traversability_function,
               cast(6 + 2 * (o_custkey % 10) as int) as region_size, (1 + (o_orderkey // 7) % 10) / 10.0::double as cut_threshold,
               o_orderkey % 3 <> 0 as path_existence, o_custkey % 5 <> 0 as path_found,
               o_totalprice::double / 1000000 as matrix_build_time, o_totalprice::double / 2000000 as graph_build_time,
               o_totalprice::double / 4000000 as path_build_time, (o_orderkey % 101) / 100.0::double as raw_score,
               cast(10 + o_orderkey % 90 as int) as path_length, o_orderkey as id from orders))"""
