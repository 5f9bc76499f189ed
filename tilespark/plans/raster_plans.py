"""Raster algebra over tiles of 8 x 8 cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import elevation, geometry as geo
from tilespark.functions.tilemath import MERC_LIMIT, Grid, tile_bounds
from tilespark.operators import coverage as cov, raster
from tilespark.plans.coverage_plans import cut_coverages
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan

N = 8
NODATA = -9999.0
DEM_SQL = """dem AS (SELECT x, y, vec_id, x*8+col AS gc, y*8+row_no AS gr, col, row_no,
  CASE WHEN cast(v AS bigint)%17 = 0 THEN -9999e0 ELSE v END AS v FROM cells)"""


def dem_tiles(t: Inputs):
    """Raster tiles with nodata where the value is a multiple of 17."""
    return t.raster_tiles.withColumn("vals", F.transform(
        "vals", lambda v: F.when(v.cast("long") % 17 == 0, NODATA).otherwise(v)))


def cells_of(df, *keys):
    return df.select(*keys, F.posexplode("vals").alias("i", "v"))


def blocks(t: Inputs):
    x, y = F.col("x"), F.col("y")
    placed = t.raster_tiles.withColumn("mx", x - x % 4).withColumn("my", y - y % 4)
    return raster.mosaic(placed, ["mx", "my"], (y % 4) * 4 + x % 4, 4, 4, N, N, fill=-1.0)


@plan("mosaic", "A8", """
WITH b AS (SELECT DISTINCT x - x%4 AS mx, y - y%4 AS my FROM raster_tiles),
c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells)
SELECT mx, my, cast(i AS int) AS i, coalesce(v, -1e0) AS v
FROM (SELECT * FROM b, range(1024) r(i)) LEFT JOIN c ON gc = mx*8+i%32 AND gr = my*8+i//32""")
def mosaic(t: Inputs):
    return cells_of(blocks(t), "mx", "my")


@plan("meta_split", "A9", """
WITH b AS (SELECT DISTINCT x - x%4 AS mx, y - y%4 AS my FROM raster_tiles),
c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells),
m AS (SELECT mx, my, mx//2+dx AS x, my//2+dy AS y, dx*16-3 AS ox, dy*16-5 AS oy FROM b, range(-1, 2) a(dx), range(2) e(dy)),
w AS (SELECT mx, my, x, y, i, ox+i%16 AS px, oy+i//16 AS py FROM m, range(256) r(i) WHERE x >= 0 AND y >= 0)
SELECT mx, my, x, y, cast(i AS int) AS i, CASE WHEN px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31 THEN coalesce(v, -1e0) ELSE -2e0 END AS v
FROM w LEFT JOIN c ON gc = mx*8+px AND gr = my*8+py AND px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31""")
def meta_split(t: Inputs):
    def half(v):
        return F.floor(v / 2).cast("long")

    members = F.array(*[F.struct((half(F.col("mx")) + dx).alias("x"), (half(F.col("my")) + dy).alias("y"),
                                 F.lit(dx * 16 - 3).alias("off_x"), F.lit(dy * 16 - 5).alias("off_y"))
                        for dx in (-1, 0, 1) for dy in (0, 1)])
    return cells_of(raster.split(blocks(t), members, 16, 16, fill=-2.0), "mx", "my", "x", "y")


def _level(src: str, k: int) -> str:
    return f"""l{k} AS (SELECT gc//2 AS gc, gr//2 AS gr, coalesce(avg(v) FILTER (WHERE v <> -9999), -9999) AS v FROM {src} GROUP BY 1, 2)"""


@plan("overview_pyramid", "A13", f"""
WITH {DEM_SQL}, {_level('dem', 1)}, {_level('l1', 2)},
p AS (SELECT DISTINCT 6 AS z, x>>1 AS x, y>>1 AS y FROM raster_tiles UNION SELECT DISTINCT 5, x>>2, y>>2 FROM raster_tiles),
c AS (SELECT 6 AS z, gc, gr, v FROM l1 UNION ALL SELECT 5, gc, gr, v FROM l2)
SELECT cast(p.z AS int) AS z, x, y, cast(i AS int) AS i, round(coalesce(v, -9999), 6) AS v
FROM (SELECT * FROM p, range(64) r(i)) p LEFT JOIN c ON c.z = p.z AND gc = x*8+i%8 AND gr = y*8+i//8""")
def overview_pyramid(t: Inputs):
    base = dem_tiles(t).withColumn("z", F.lit(7))
    up = raster.pyramid(base, 2, N, nodata=NODATA)
    return cells_of(up, "z", "x", "y").withColumn("v", F.round("v", 6))


@plan("rescale_fill_pixels", "J15", f"""
WITH {DEM_SQL}, {_level('dem', 1)}, {_level('l1', 2)},
p AS (SELECT DISTINCT x>>2 AS x, y>>2 AS y FROM raster_tiles),
a AS (SELECT cast(5 AS int) AS z, x, y, cast(7 AS int) AS src_z, cast(i AS int) AS i, round(coalesce(v, -9999), 6) AS v
  FROM (SELECT * FROM p, range(64) r(i)) q LEFT JOIN l2 ON gc = x*8+i%8 AND gr = y*8+i//8)
SELECT * FROM a UNION ALL
SELECT cast(9 AS int), 4*x+vec_id%4, 4*y+vec_id//4%4, cast(7 AS int), cast(i AS int), round(v, 6) FROM dem JOIN range(64) r(i)
  ON col = vec_id%4*2+i%8//4 AND row_no = vec_id//4%4*2+i//8//4""")
def rescale_fill_pixels(t: Inputs):
    stored = dem_tiles(t).withColumn("z", F.lit(7))
    vec = F.col("vec_id")
    coarse = t.raster_tiles.select(F.lit(5).alias("z"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y"))
    fine = t.raster_tiles.select(F.lit(9).alias("z"), (F.col("x") * 4 + vec % 4).alias("x"), (F.col("y") * 4 + F.floor(vec / 4) % 4).alias("y"))
    filled = raster.rescale_fill(coarse.unionByName(fine), stored, N, up=2, down=2, nodata=NODATA)
    return cells_of(filled, "z", "x", "y", "src_z").withColumn("v", F.round("v", 6))


@plan("all_blank", "A14", """
SELECT x//2 AS mx, y//2 AS my, bool_and(v < 1250) AS all_blank, count(*)//64 AS n_tiles FROM cells GROUP BY 1, 2""")
def all_blank(t: Inputs):
    shown = t.raster_tiles.withColumn("vals", F.transform("vals", lambda v: F.when(v >= 1250, v).otherwise(0.0)))
    grouped = shown.withColumn("mx", F.shiftright("x", 1)).withColumn("my", F.shiftright("y", 1))
    return raster.all_blank(grouped, ["mx", "my"], 0.0)


@plan("border_exchange", "R2", """
WITH s(role, dx, dy) AS (VALUES ('left',-1,0), ('right',1,0), ('top',0,-1), ('bottom',0,1), ('tl',-1,-1), ('tr',1,-1), ('bl',-1,1), ('br',1,1)),
w AS (SELECT x, y, role, i, CASE dx WHEN -1 THEN x*8-1 WHEN 1 THEN x*8+8 ELSE x*8+i END AS gc,
   CASE dy WHEN -1 THEN y*8-1 WHEN 1 THEN y*8+8 ELSE y*8+i END AS gr
   FROM raster_tiles, s, range(8) r(i) WHERE i = 0 OR dx = 0 OR dy = 0),
c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells)
SELECT x, y, role, cast(i AS int) AS i, coalesce(v, -1e0) AS v FROM w LEFT JOIN c USING (gc, gr)""")
def border_exchange(t: Inputs):
    bordered = raster.exchange_borders(t.raster_tiles, N, N, "bilateral", fill=-1.0)
    names = raster.BORDER_STRIPS["bilateral"]
    table = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])
    return bordered.select("x", "y", F.explode(table).alias("role", "vals")).select(
        "x", "y", "role", F.posexplode("vals").alias("i", "v"))


PADDED = """
WITH c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells),
w AS (SELECT 'bilateral' AS mode, x, y, i, x*8-1+i%10 AS gc, y*8-1+i//10 AS gr FROM raster_tiles, range(100) r(i)
  UNION ALL SELECT 'unilateral', x, y, i, x*8-1+i%9, y*8-1+i//9 FROM raster_tiles, range(81) r(i))
SELECT mode, x, y, cast(i AS int) AS i, coalesce(v, -1e0) AS v, round(18e0/7e0, 6) AS step_x, round(-7.2e0/7e0, 6) AS step_y FROM w LEFT JOIN c USING (gc, gr)"""


@plan("padded_raster", "R3", PADDED)
def padded_raster(t: Inputs):
    parts = []
    for mode in ("bilateral", "unilateral"):
        padded = raster.pad(raster.exchange_borders(t.raster_tiles, N, N, mode, fill=-1.0), N, N, mode)
        x, y = F.col("x"), F.col("y")
        box = geo.bbox(x * 18.0 - 180, 90 - (y + 1) * 7.2, x * 18.0 - 162, 90 - y * 7.2)
        g = padded.withColumn("gt", raster.geotransform(box, N, N))
        parts.append(g.select(F.lit(mode).alias("mode"), "x", "y", F.round(F.col("gt")[1], 6).alias("step_x"),
                              F.round(F.col("gt")[5], 6).alias("step_y"), F.posexplode("vals").alias("i", "v")))
    return parts[0].unionByName(parts[1])


@plan("sample_grid", "R1", """
WITH a AS (SELECT vec_id, x*18e0-180e0 AS minx, y*7e0 AS miny, label%3 AS m FROM raster_tiles),
g AS (SELECT vec_id, 'raster' AS kind, c AS col, r AS row_no, minx + 18e0/7e0*c AS x, miny + 7e0/7e0*r AS y
  FROM a, range(-1, 9) cc(c), range(-1, 9) rr(r) WHERE CASE m WHEN 0 THEN c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 7 WHEN 1 THEN c BETWEEN 0 AND 8 AND r BETWEEN 0 AND 8 ELSE true END
  UNION ALL SELECT vec_id, 'terrain', c, r, minx + 18e0/7e0*(c-0.5e0), miny + 7e0/7e0*(r-0.5e0)
  FROM a, range(-1, 9) cc(c), range(0, 9) rr(r) WHERE CASE m WHEN 0 THEN c BETWEEN 0 AND 7 AND r <= 7 WHEN 1 THEN c BETWEEN 0 AND 8 ELSE true END)
SELECT vec_id, kind, cast(col AS int) AS col, cast(row_no AS int) AS row_no, round(x, 5) AS x, round(y, 5) AS y FROM g""")
def sample_grid(t: Inputs):
    m = F.col("label") % 3
    mode = F.when(m == 0, "none").when(m == 1, "unilateral").otherwise("bilateral")
    x, y = F.col("x"), F.col("y")
    areas = t.raster_tiles.select("vec_id", mode.alias("mode"), geo.bbox(x * 18.0 - 180, y * 7.0, x * 18.0 - 162, y * 7.0 + 7).alias("box"))
    out = []
    for kind in ("raster", "terrain"):
        grid = raster.sample_grid(areas, N, N, F.col("mode"), terrain=kind == "terrain")
        out.append(grid.select("vec_id", F.lit(kind).alias("kind"), "col", "row_no", F.round("x", 5).alias("x"), F.round("y", 5).alias("y")))
    return out[0].unionByName(out[1])


POINTS = """pts AS (SELECT id, (id*7.3e0)%160e0 AS px, (id*3.1e0)%(8e0*(SELECT max(y)+1 FROM raster_tiles)) AS py,
    (SELECT max(y)+1 FROM raster_tiles)*8 AS th
  FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT 10000000+p_partkey FROM part) q)"""


def dem_points(t: Inputs):
    rows = t.raster_tiles.agg((F.max("y") + 1).alias("rows"))
    ids = t.customer.select(F.col("c_custkey").alias("id")).unionByName(t.part.select((F.col("p_partkey") + 10000000).alias("id")))
    return ids.join(F.broadcast(rows)).select(  # one-row side
        "id", (F.col("id") * 7.3 % 160.0).alias("px"), (F.col("id") * 3.1 % (F.lit(8.0) * F.col("rows"))).alias("py"),
        (F.col("rows") * 8).alias("th"))


CORNERS = f"""{DEM_SQL}, {POINTS},
k AS (SELECT id, px, py, px-floor(px) AS fx, py-floor(py) AS fy, cast(floor(px) AS bigint) AS x0, least(cast(ceil(px) AS bigint),159) AS x1,
      cast(floor(py) AS bigint) AS y0, least(cast(ceil(py) AS bigint), th-1) AS y1 FROM pts),
c4 AS (SELECT id, 'nw' AS c, x0 AS gc, y0 AS gr FROM k UNION ALL SELECT id, 'ne', x1, y0 FROM k UNION ALL SELECT id, 'sw', x0, y1 FROM k UNION ALL SELECT id, 'se', x1, y1 FROM k),
v4 AS (SELECT id, max(CASE WHEN c='nw' THEN v END) AS nw, max(CASE WHEN c='ne' THEN v END) AS ne, max(CASE WHEN c='sw' THEN v END) AS sw, max(CASE WHEN c='se' THEN v END) AS se
  FROM c4 JOIN dem USING (gc, gr) GROUP BY id),
q AS (SELECT k.*, nw, ne, sw, se FROM k JOIN v4 USING (id)),
n AS (SELECT *, coalesce((CASE WHEN nw<>-9999 THEN nw ELSE 0 END + CASE WHEN ne<>-9999 THEN ne ELSE 0 END + CASE WHEN sw<>-9999 THEN sw ELSE 0 END + CASE WHEN se<>-9999 THEN se ELSE 0 END)
   / nullif((nw<>-9999)::int + (ne<>-9999)::int + (sw<>-9999)::int + (se<>-9999)::int, 0), 0) AS m FROM q),
f AS (SELECT id, px, py, fx, fy, nw AS raw, CASE WHEN nw=-9999 THEN m ELSE nw END AS nw, CASE WHEN ne=-9999 THEN m ELSE ne END AS ne,
   CASE WHEN sw=-9999 THEN m ELSE sw END AS sw, CASE WHEN se=-9999 THEN m ELSE se END AS se FROM n)"""
NEAR = "(fx < 0.1e0 OR fx > 0.9e0) AND (fy < 0.1e0 OR fy > 0.9e0)"
BILINEAR = "(nw+(sw-nw)*fy) + ((ne+(se-ne)*fy) - (nw+(sw-nw)*fy))*fx"


@plan("dem_sample", "J12", f"""
WITH {CORNERS} SELECT id, round(px, 6) AS px, round(py, 6) AS py, round(CASE WHEN {NEAR} THEN raw ELSE {BILINEAR} END, 4) AS value FROM f""")
def dem_sample(t: Inputs):
    sampled = raster.sample_points(dem_points(t), dem_tiles(t), "id", "px", "py", N, F.lit(160), F.col("th"), NODATA)
    return sampled.select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), F.round("value", 4).alias("value"))


@plan("geoid_shift", "P22", f"""
WITH {CORNERS} SELECT id, round(id%1000 + ({BILINEAR})/100e0, 6) AS height FROM f""")
def geoid_shift(t: Inputs):
    # the raster stands for a geoid grid in centimetres
    offset = raster.sample_points(dem_points(t), dem_tiles(t), "id", "px", "py", N, F.lit(160), F.col("th"), NODATA, snap=False)
    return offset.select("id", F.round(elevation.shift_datum(F.col("id") % 1000, F.col("value") / 100.0), 6).alias("height"))


@plan("interpolators", "P21", """
WITH e AS (SELECT vec_id, cast(i AS int) AS quad, vals[i//7*8+i%7+1] AS nw, vals[i//7*8+i%7+2] AS ne, vals[i//7*8+i%7+9] AS sw, vals[i//7*8+i%7+10] AS se,
  ((vec_id+i)%10)/10e0 AS fx, ((vec_id+i)%7)/7e0 AS fy FROM raster_tiles, range(49) r(i))
SELECT vec_id, quad, round((nw+(sw-nw)*fy) + ((ne+(se-ne)*fy) - (nw+(sw-nw)*fy))*fx, 5) AS bilinear,
  round(sw+(se-sw)*fx+(nw-sw)*fy+(sw-se-nw+ne)*fx*fy, 5) AS hyperbolic FROM e""")
def interpolators(t: Inputs):
    quads = t.raster_tiles.withColumn("quad", F.explode(F.sequence(F.lit(0), F.lit(48))))
    col, row = F.col("quad") % 7, F.floor(F.col("quad") / 7)

    def at(dx, dy):
        return raster.cell(F.col("vals"), N, col + dx, row + dy)

    corners = (at(0, 1), at(1, 1), at(0, 0), at(1, 0))
    fx, fy = (F.col("vec_id") + F.col("quad")) % 10 / 10.0, (F.col("vec_id") + F.col("quad")) % 7 / 7.0
    return quads.select("vec_id", "quad", *[F.round(fn(*corners, fx, fy), 5).alias(name) for name, fn in elevation.INTERPOLATORS.items()])


@plan("elevation_pack", "P20", """
WITH h AS (SELECT vec_id, col, row_no, v*3.7e0-2000e0 AS h FROM cells),
p AS (SELECT *, cast(floor((h+10000e0)*10e0+0.5e0) AS bigint) AS m, cast(floor((h+32768e0)*256e0) AS bigint) AS t FROM h)
SELECT vec_id, col, row_no, cast(m//65536 AS int) AS mr, cast(m//256%256 AS int) AS mg, cast(m%256 AS int) AS mb,
  cast(t//65536 AS int) AS tr, cast(t//256%256 AS int) AS tg, cast(t%256 AS int) AS tb,
  round(m/10e0-10000e0, 4) AS m_height, round(t/256e0-32768e0, 4) AS t_height FROM p""")
def elevation_pack(t: Inputs):
    packed = t.cells.select("vec_id", "col", "row_no", (F.col("v") * 3.7 - 2000.0).alias("h")).withColumn(
        "m", elevation.pack_mapbox(F.col("h"))).withColumn("t", elevation.pack_terrarium(F.col("h")))
    bands = [F.col(f"{e}.{b}").alias(f"{e}{b}") for e in "mt" for b in "rgb"]
    out = packed.select("vec_id", "col", "row_no", *bands)
    return out.withColumn("m_height", F.round(elevation.unpack_mapbox(F.col("mr"), F.col("mg"), F.col("mb")), 4)).withColumn(
        "t_height", F.round(elevation.unpack_terrarium(F.col("tr"), F.col("tg"), F.col("tb")), 4))


@plan("mesh_sample", "J13 L3", f"""
WITH {POINTS}, c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, col, row_no, v FROM cells),
q AS (SELECT a.gc AS qx, a.gr AS qy, a.v AS v00, b.v AS v10, d.v AS v01, e.v AS v11 FROM c a JOIN c b ON b.gc=a.gc+1 AND b.gr=a.gr
  JOIN c d ON d.gc=a.gc AND d.gr=a.gr+1 JOIN c e ON e.gc=a.gc+1 AND e.gr=a.gr+1 WHERE a.col < 7 AND a.row_no < 7),
p AS (SELECT id, px, py, x, y FROM pts, range(2) dx(i), range(2) dy(j), LATERAL (SELECT cast(floor(px) AS bigint)-i AS x, cast(floor(py) AS bigint)-j AS y) l),
h AS (SELECT id, CASE WHEN px-qx+py-qy <= 1 THEN v00+(v10-v00)*(px-qx)+(v01-v00)*(py-qy)
   ELSE v11+(v01-v11)*(1-(px-qx))+(v10-v11)*(1-(py-qy)) END AS z FROM p JOIN q ON qx=x AND qy=y WHERE px <= qx+1 AND py <= qy+1)
SELECT id, round(max(z), 4) AS value FROM h GROUP BY 1""")
def mesh_sample(t: Inputs):
    quads = t.raster_tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(48))))
    col, row = F.col("i") % 7, F.floor(F.col("i") / 7).cast("int")
    gx, gy = F.col("x") * 8 + col, F.col("y") * 8 + row

    def vertex(name, dx, dy):
        return [(gx + dx).alias(f"{name}x"), (gy + dy).alias(f"{name}y"), raster.cell(F.col("vals"), N, col + dx, row + dy).alias(f"{name}z")]

    upper = quads.select(*vertex("a", 0, 0), *vertex("b", 1, 0), *vertex("c", 0, 1))
    lower = quads.select(*vertex("a", 1, 0), *vertex("b", 1, 1), *vertex("c", 0, 1))
    hit = raster.mesh_sample(dem_points(t), upper.unionByName(lower), "id", "px", "py", bucket=1.0, salts=2)
    return hit.select("id", F.round("value", 4).alias("value"))


SRC = Grid("source", "EPSG:3857", (-MERC_LIMIT, -MERC_LIMIT, MERC_LIMIT, MERC_LIMIT), (MERC_LIMIT / 2000,), tile_size=N)
LONLAT = Grid("lonlat", "EPSG:4326", (-180.0, -90.0, 180.0, 90.0), (0.097,), tile_size=N, origin="nw")
COARSER = Grid("coarser", "EPSG:3857", SRC.bbox, (MERC_LIMIT / 2000 * 1.5,), tile_size=N)


def target_tiles(t: Inputs, dst: Grid):
    """Tiles of the other grid that the raster touches."""
    box = geo.reproject_bbox(SRC.tile_bbox(F.col("x"), F.col("y"), F.lit(0)), SRC.srs, dst.srs)
    boxes = t.raster_tiles.select(box.alias("box"), F.lit(0).alias("z"))
    return cov.affected_tiles(boxes, dst).select("z", "x", "y").distinct()


@plan("raster_warp", "A21 J6", """
WITH n AS (SELECT max(y)+1 AS n FROM raster_tiles),
b AS (SELECT cast(ceil((90e0-degrees(2e0*atan(exp(pi()*(1e0-n*8e0/2000e0)))-pi()/2e0))/0.776e0) AS bigint) AS bottom FROM n),
d AS (SELECT tx, ty, i, -180e0+(tx*8+i%8+0.5e0)*0.097e0 AS lon, 90e0-(ty*8+i//8+0.5e0)*0.097e0 AS lat FROM b, range(19) a(tx), range(6, 100) e(ty), range(64) r(i) WHERE ty < bottom),
s AS (SELECT *, cast(floor((radians(lon)/pi()+1e0)*2000e0) AS bigint) AS gc, cast(floor((1e0-ln(tan(pi()/4e0+radians(lat)/2e0))/pi())*2000e0) AS bigint) AS gr FROM d),
c AS (SELECT x*8+col AS gc, y*8+row_no AS gr, v FROM cells)
SELECT tx AS x, ty AS y, cast(i AS int) AS i, v FROM s JOIN c USING (gc, gr)""")
def raster_warp(t: Inputs):
    blocks_ = raster.source_blocks(target_tiles(t, LONLAT), t.raster_tiles, LONLAT, SRC, 0)
    return cells_of(raster.warp(blocks_, LONLAT, SRC, 0), "x", "y").filter("v IS NOT NULL")


@plan("tileset_resample", "R4", f"""
WITH {DEM_SQL}, n AS (SELECT max(y)+1 AS n FROM raster_tiles),
d AS (SELECT tx, ty, (12*tx+13+7)//8-1 <= 19 AND (12*ty+13+7)//8-1 <= n-1 AS whole FROM n, range(14) a(tx), range(200) b(ty) WHERE ty < (8*n+11)//12),
k AS (SELECT tx, ty, i, 12*tx+(i%8+0.5e0)*1.5e0 AS px, 12*ty+(i//8+0.5e0)*1.5e0 AS py FROM d, range(64) r(i) WHERE whole),
c4 AS (SELECT tx, ty, i, px, py, dx, dy, cast(floor(px) AS bigint)+dx AS gc, cast(floor(py) AS bigint)+dy AS gr FROM k, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)),
q AS (SELECT tx, ty, i, px-floor(px) AS fx, py-floor(py) AS fy, max(CASE WHEN dx=0 AND dy=0 THEN v END) AS nw, max(CASE WHEN dx=1 AND dy=0 THEN v END) AS ne,
  max(CASE WHEN dx=0 AND dy=1 THEN v END) AS sw, max(CASE WHEN dx=1 AND dy=1 THEN v END) AS se FROM c4 JOIN dem USING (gc, gr) GROUP BY tx, ty, i, px, py),
m AS (SELECT *, coalesce((CASE WHEN nw<>-9999 THEN nw ELSE 0 END + CASE WHEN ne<>-9999 THEN ne ELSE 0 END + CASE WHEN sw<>-9999 THEN sw ELSE 0 END + CASE WHEN se<>-9999 THEN se ELSE 0 END)
   / nullif((nw<>-9999)::int + (ne<>-9999)::int + (sw<>-9999)::int + (se<>-9999)::int, 0), 0) AS m FROM q),
f AS (SELECT tx, ty, i, fx, fy, CASE WHEN nw=-9999 THEN m ELSE nw END AS nw, CASE WHEN ne=-9999 THEN m ELSE ne END AS ne,
   CASE WHEN sw=-9999 THEN m ELSE sw END AS sw, CASE WHEN se=-9999 THEN m ELSE se END AS se FROM m)
SELECT tx AS x, ty AS y, 'ok' AS state, cast(i AS int) AS i, round({BILINEAR}, 4) AS v FROM f
UNION ALL SELECT tx, ty, 'rejected', NULL, NULL FROM d WHERE NOT whole""")
def tileset_resample(t: Inputs):
    blocks_ = raster.source_blocks(target_tiles(t, COARSER), dem_tiles(t), COARSER, SRC, 0)
    whole, rejected = raster.split_complete(blocks_)
    cells = cells_of(raster.warp(whole, COARSER, SRC, 0, "bilinear", NODATA), "x", "y")
    done = cells.select("x", "y", F.lit("ok").alias("state"), "i", F.round("v", 4).alias("v"))
    return done.unionByName(rejected.select(
        "x", "y", F.lit("rejected").alias("state"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("v")))


@plan("coverage_mask", "A20", """
WITH c AS (SELECT vec_id, col, row_no, v, x*18e0-180e0+(col+0.5e0)*2.25e0 AS cx, 90e0-(y%25)*7.2e0-(row_no+0.5e0)*0.9e0 AS cy FROM cells)
SELECT vec_id, cast(row_no*8+col AS int) AS i,
  CASE WHEN cx > minx AND cx < maxx AND cy > miny AND cy < maxy AND cx+cy < maxx+maxy-cut THEN v ELSE -1e0 END AS v
FROM c JOIN boxes ON n_nationkey = vec_id%25""")
def coverage_mask(t: Inputs):
    x, y = F.col("x"), F.col("y") % 25
    tiles = t.raster_tiles.withColumn("box", geo.bbox(x * 18.0 - 180, 90 - y * 7.2 - 7.2, x * 18.0 - 162, 90 - y * 7.2))
    polygons = cut_coverages(t).select(F.col("coverage").alias("n"), geo.polygon_edges(F.col("polygon")).alias("edges"))
    placed = tiles.withColumn("n", (F.col("vec_id") % 25).cast("int")).join(polygons, "n")
    return cells_of(raster.mask(placed, N, N, background=-1.0), "vec_id")
