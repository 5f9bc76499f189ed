"""Warps through a mesh, and triangles of all sizes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilespark.functions.tilemath import Grid
from tilespark.operators import raster
from tilespark.operators.meshwarp import mesh_warp
from tilespark.plans.inputs import Inputs
from tilespark.plans.raster_plans import POINTS, cells_of, dem_points
from tilespark.plans.registry import plan

# the raster on a plane of its own, and a grid that is turned against it
PLANE = Grid("plane", "local", (0.0, -1e6, 160.0, 0.0), (1.0,), tile_size=8, origin="nw")
TURNED = Grid("turned", "turned", (-1e5, -1e5, 1e5, 1e5), (0.75,), tile_size=8, origin="nw")
COS, SIN = math.cos(0.5), math.sin(0.5)


def turn(x, y):
    return x * COS - y * SIN + 80.25, x * SIN + y * COS - 60.5


@plan("mesh_warp", "A21 J6", f"""
WITH m AS (SELECT x*8e0+4e0-80.25e0 AS a, 60.5e0-(y*8e0+4e0) AS b FROM raster_tiles),
c AS (SELECT cast(floor(((a*{COS!r}e0+b*{SIN!r}e0)+1e5)/6e0) AS bigint) AS u, cast(floor((1e5-(b*{COS!r}e0-a*{SIN!r}e0))/6e0) AS bigint) AS v FROM m),
t AS (SELECT DISTINCT u+i-1 AS tx, v+j-1 AS ty FROM c, range(3) p(i), range(3) q(j)),
d AS (SELECT tx, ty, i, tx*6e0-1e5+(i%8+0.5e0)*0.75e0 AS a, 1e5-ty*6e0-(i//8+0.5e0)*0.75e0 AS b FROM t, range(64) r(i)),
s AS (SELECT tx, ty, i, cast(floor(a*{COS!r}e0-b*{SIN!r}e0+80.25e0) AS bigint) AS gc, cast(floor(60.5e0-(a*{SIN!r}e0+b*{COS!r}e0)) AS bigint) AS gr FROM d),
k AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells)
SELECT tx AS x, ty AS y, cast(i AS int) AS i, v FROM s JOIN k USING (gc, gr)""")
def mesh_warp_query(t: Inputs):
    # the target tiles around the middle of each source tile
    a, b = F.col("x") * 8.0 + 4.0 - 80.25, F.lit(60.5) - (F.col("y") * 8.0 + 4.0)
    u, v = F.floor((a * COS + b * SIN + 1e5) / 6.0), F.floor((F.lit(1e5) - (b * COS - a * SIN)) / 6.0)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = t.raster_tiles.select(u.alias("u"), v.alias("v")).withColumn("i", step).withColumn("j", step)
    targets = around.select(F.lit(0).alias("z"), (F.col("u") + F.col("i")).cast("long").alias("x"), (F.col("v") + F.col("j")).cast("long").alias("y")).distinct()
    return cells_of(mesh_warp(targets, t.raster_tiles, TURNED, PLANE, 0, turn), "x", "y").filter("v IS NOT NULL")


# a triangle per order: most below a cell, some a few cells and some half of the raster wide
TRIANGLES = """tri AS (SELECT o_orderkey*7.3e0%160e0 AS ax, o_orderkey*3.1e0%200e0 AS ay, o_orderkey*7.3e0%160e0+s AS bx, o_orderkey*3.1e0%200e0+s/4e0 AS "by",
  o_orderkey*7.3e0%160e0+s/3e0 AS cx, o_orderkey*3.1e0%200e0+s AS cy, cast(o_custkey%1000 AS double) AS az, cast(o_custkey%700 AS double) AS bz, cast(o_orderkey%500 AS double) AS cz
  FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey%256=0 THEN 70e0 WHEN o_orderkey%16=0 THEN 6e0 ELSE 0.6e0 END AS s FROM orders) o)"""


@plan("mesh_sample_sizes", "J13 L3", f"""
WITH {POINTS}, {TRIANGLES},
d AS (SELECT *, ("by"-cy)*(ax-cx)+(cx-bx)*(ay-cy) AS det FROM tri),
h AS (SELECT id, az, bz, cz, (("by"-cy)*(px-cx)+(cx-bx)*(py-cy))/det AS u, ((cy-ay)*(px-cx)+(ax-cx)*(py-cy))/det AS v FROM pts JOIN d
  ON px >= least(ax, bx, cx)-1e-6 AND px <= greatest(ax, bx, cx)+1e-6 AND py >= least(ay, "by", cy)-1e-6 AND py <= greatest(ay, "by", cy)+1e-6)
SELECT id, round(max(u*az+v*bz+(1e0-u-v)*cz), 4) AS value FROM h WHERE u >= -1e-9 AND v >= -1e-9 AND 1e0-u-v >= -1e-9 GROUP BY 1""")
def mesh_sample_sizes(t: Inputs):
    k = F.col("o_orderkey")
    x, y = k * F.lit(7.3) % 160.0, k * F.lit(3.1) % 200.0
    s = F.when(k % 256 == 0, 70.0).when(k % 16 == 0, 6.0).otherwise(0.6)
    triangles = t.orders.select(
        x.alias("ax"), y.alias("ay"), (x + s).alias("bx"), (y + s / 4).alias("by"), (x + s / 3).alias("cx"), (y + s).alias("cy"),
        (F.col("o_custkey") % 1000).cast("double").alias("az"), (F.col("o_custkey") % 700).cast("double").alias("bz"), (k % 500).cast("double").alias("cz"))
    hit = raster.mesh_sample_sizes(dem_points(t).select("id", "px", "py"), triangles, "id", "px", "py", base=0.5)
    return hit.select("id", F.round("value", 4).alias("value"))
