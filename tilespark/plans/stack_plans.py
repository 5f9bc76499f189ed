"""Stacked imagery: opacity folds and band merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import stack
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@plan("stacked_merge", "A11", """
WITH RECURSIVE s AS (SELECT tile_id, value*1e0 AS v, opacity AS a, row_number() OVER (PARTITION BY tile_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord FROM layer_stack),
f AS (SELECT tile_id, 0e0 AS acc, 0 AS ord FROM (SELECT DISTINCT tile_id FROM s)
  UNION ALL SELECT s.tile_id, CASE WHEN a >= 1 THEN v WHEN a = 0 THEN acc ELSE trunc(least(greatest(acc+a*(v-acc), 0e0), 255e0)) END, f.ord+1
  FROM f JOIN s ON s.tile_id = f.tile_id AND s.ord = f.ord+1)
SELECT tile_id, arg_max(acc, ord) AS value, cast(max(ord) AS int) AS n_layers FROM f GROUP BY 1""")
def stacked_merge(t: Inputs):
    return stack.fold_stack(t.layer_stack, ["tile_id"], ORDER, "value", "opacity")


OPS = (("red", 1, "A", 0.5), ("red", 2, "N", 0.25), ("green", 1, "N", 1.0), ("green", 3, "R", -0.5), ("blue", 4, "A", 2.0),
       ("blue", 5, "A", 0.125), ("alpha", 9, "A", 1.0))


@plan("band_merge", "A12", """
SELECT tile_id, round(sum(CASE WHEN l_linenumber=1 AND l_returnflag='A' THEN value*0.5e0 WHEN l_linenumber=2 AND l_returnflag='N' THEN value*0.25e0 ELSE 0e0 END), 4) AS red,
  round(sum(CASE WHEN l_linenumber=1 AND l_returnflag='N' THEN value*1e0 WHEN l_linenumber=3 AND l_returnflag='R' THEN value*-0.5e0 ELSE 0e0 END), 4) AS green,
  round(sum(CASE WHEN l_linenumber=4 AND l_returnflag='A' THEN value*2e0 WHEN l_linenumber=5 AND l_returnflag='A' THEN value*0.125e0 ELSE 0e0 END), 4) AS blue,
  0e0 AS alpha FROM layer_stack GROUP BY 1""")
def band_merge(t: Inputs):
    merged = stack.merge_bands(t.layer_stack, ["tile_id"], "l_linenumber", "l_returnflag", "value", OPS)
    return merged.select("tile_id", *[F.round(c, 4).alias(c) for c in ("red", "green", "blue", "alpha")])
