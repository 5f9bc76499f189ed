"""Tile containers: zip and tar.gz archives, MBTiles and GeoPackage, in bulk and in shards."""

from __future__ import annotations

import gzip
import io
import json
import shutil
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import keys
from tilespark.operators.cache_state import latest, rekey
from tilespark.operators.catalog import tileset_metadata
from tilespark.functions.tilemath import Grid
from tilespark.session import ship_package
from tilespark.sources.storage import open_filesystem, open_random, open_stream, put_bytes, qualified

ENTRY_SCHEMA = "container string, name string, layout string, format string, z int, x long, y long, data binary"
BATCH = 256
GZIP_MAGIC = b"\x1f\x8b"
SUFFIXES = {".zip": "zip", ".tar.gz": "tar", ".tgz": "tar", ".mbtiles": "mbtiles", ".gpkg": "gpkg"}


def container_kind(path: str) -> str:
    """Kind named by the file suffix; a GeoPackage may be followed by a table name."""
    plain = path.split("?")[0]
    if ".gpkg:" in plain:
        return "gpkg"
    for suffix, kind in SUFFIXES.items():
        if plain.endswith(suffix):
            return kind
    raise ValueError(f"unknown container {path}")


def _file_and_table(path: str) -> tuple[str, str | None]:
    """File of a container and, for a GeoPackage, the table named after it."""
    file, colon, table = path.partition(".gpkg:")
    return (file + ".gpkg", table.split("?")[0]) if colon else (path, None)


def _maybe_gunzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == GZIP_MAGIC else data


# A task reads at most this many entries of a container that can be entered in the middle.
CHUNK = 20_000
CHUNK_SCHEMA = "container string, path string, lo long, hi long"


def _zip_names(z: zipfile.ZipFile) -> list[str]:
    return [n for n in z.namelist() if n != "metadata.json" and not n.endswith("/")]


def _zip_entries(path: str, lo: int, hi: int) -> Iterator[dict]:
    with open_random(path) as src, zipfile.ZipFile(src) as z:
        meta = json.loads(z.read("metadata.json"))
        for name in _zip_names(z)[lo:hi]:
            yield dict(name=name, layout=meta.get("directory_layout") or "tms", format=meta["format"], data=z.read(name))


def _tar_members(path: str) -> Iterator[tuple[str, bytes]]:
    with open_stream(path) as src, tarfile.open(fileobj=src, mode="r|gz") as t:
        for member in t:
            if member.isfile():
                yield member.name, t.extractfile(member).read()


def _tar_entries(path: str) -> Iterator[dict]:
    """A compressed archive can only be read front to back; its metadata may come last."""
    meta = json.loads(next(data for name, data in _tar_members(path) if name == "metadata.json"))
    for name, data in _tar_members(path):
        if name != "metadata.json":
            yield dict(name=name, layout=meta.get("directory_layout") or "tms", format=meta["format"], data=data)


@contextmanager
def _database(path: str) -> Iterator[sqlite3.Connection]:
    """Open a database file read-only: in place on mounted storage, else from a task-private copy."""
    from pyarrow import fs

    filesystem, local = open_filesystem(_file_and_table(path)[0])
    with tempfile.NamedTemporaryFile() as copy:
        if not isinstance(filesystem, fs.LocalFileSystem):
            with filesystem.open_input_stream(local, compression=None) as src:
                shutil.copyfileobj(src, copy)
            copy.flush()
            local = copy.name
        con = sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)
        try:
            yield con
        finally:
            con.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _tile_tables(con: sqlite3.Connection, kind: str, table: str | None = None) -> list[str]:
    """Tables of tiles: the one asked for, or all."""
    if kind == "mbtiles":
        return ["tiles"]
    found = [name for name, in con.execute("SELECT table_name FROM gpkg_tile_matrix_set ORDER BY table_name")]
    if table is not None and table not in found:
        raise ValueError(f"no tile table {table}")
    return found if table is None else [table]


def _database_entries(path: str, kind: str, lo: int | None, hi: int | None) -> Iterator[dict]:
    with _database(path) as con:
        table, = _tile_tables(con, kind, _file_and_table(path)[1])
        if kind == "mbtiles":
            fmt = dict(con.execute("SELECT name, value FROM metadata")).get("format", "")
        else:
            fmt = (con.execute("SELECT description FROM gpkg_contents WHERE table_name = ?", (table,)).fetchone() or [""])[0]
        part, bounds = ("", ()) if lo is None else (" WHERE rowid >= ? AND rowid < ?", (lo, hi))
        # GeoPackage payloads are only unpacked for vector tiles
        unpack = kind == "mbtiles" or fmt in ("pbf", "mvt")
        for z, x, row, data in con.execute(
            f"SELECT zoom_level, tile_column, tile_row, tile_data FROM {_quoted(table)}{part}", bounds
        ):
            y = (1 << z) - 1 - row if kind == "mbtiles" else row
            yield dict(format=fmt, z=z, x=x, y=y, data=_maybe_gunzip(data) if unpack else data)


def _chunks(path: str, chunk: int) -> list[tuple[str, int | None, int | None]]:
    """Paths, with a GeoPackage's table, and ranges a container can be read in; an open range where it cannot be split."""
    kind = container_kind(path)
    if kind == "zip":
        with open_random(path) as src, zipfile.ZipFile(src) as z:
            spans = [(path, 0, len(_zip_names(z)))]
    elif kind == "tar":
        return [(path, None, None)]
    else:
        spans, (file, wanted) = [], _file_and_table(path)
        with _database(path) as con:
            for table in _tile_tables(con, kind, wanted):
                named = file if kind == "mbtiles" else f"{file}:{table}"
                try:
                    first, last = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
                except sqlite3.OperationalError:  # a view has no row ids
                    spans.append((named, None, None))
                    continue
                if first is not None:
                    spans.append((named, first, last + 1))
    return [(name, lo, None if lo is None else min(lo + chunk, end)) for name, first, end in spans
            for lo in ([None] if first is None else range(first, end, chunk))]


def _entries(path: str, lo: int | None, hi: int | None) -> Iterator[dict]:
    kind = container_kind(path)
    if kind == "zip":
        return _zip_entries(path, lo or 0, hi)
    return _tar_entries(path) if kind == "tar" else _database_entries(path, kind, lo, hi)


_COLUMNS = ["container", "name", "layout", "format", "z", "x", "y", "data"]


def _frames(rows: Iterator[dict], container: str) -> Iterator[pd.DataFrame]:
    block: list[dict] = []

    def frame():
        df = pd.DataFrame(block).reindex(columns=_COLUMNS)
        df["container"] = container
        df = df.astype({"z": "Int32", "x": "Int64", "y": "Int64"})
        return df.astype(object).where(df.notna(), None)

    for row in rows:
        block.append(row)
        if len(block) >= BATCH:
            yield frame()
            block = []
    if block:
        yield frame()


def read_containers(spark: SparkSession, paths: DataFrame, layouts: tuple[str, ...] = keys.LAYOUTS, chunk: int = CHUNK) -> DataFrame:
    """Tiles of many containers; entries whose name is no tile are in :func:`unknown_entries`."""
    return container_entries(spark, paths, layouts, chunk).filter("z IS NOT NULL").drop("name")


def unknown_entries(spark: SparkSession, paths: DataFrame, layouts: tuple[str, ...] = keys.LAYOUTS, chunk: int = CHUNK) -> DataFrame:
    """Entries of containers that name no tile: ``container, name, size``."""
    return container_entries(spark, paths, layouts, chunk).filter("z IS NULL").select("container", "name", "size")


def container_entries(spark: SparkSession, paths: DataFrame, layouts: tuple[str, ...] = keys.LAYOUTS, chunk: int = CHUNK) -> DataFrame:
    """Entries of many containers, small batches at a time.

    ``paths``: column ``path``. Of a GeoPackage all tile tables are read, or the one named after ``.gpkg:``. Archives with a directory and databases are read in chunks by many
    tasks, so one container may hold a third of all tiles. Archive entries get their key from the
    layout their metadata names.
    """
    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *part) for path in batch["path"] for part in _chunks(path, chunk)]
            yield pd.DataFrame(rows, columns=["container", "path", "lo", "hi"]).astype({"lo": "Int64", "hi": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for container, path, lo, hi in zip(batch["container"], batch["path"], batch["lo"], batch["hi"]):
                span = (None, None) if pd.isna(lo) else (int(lo), int(hi))
                yield from _frames(_entries(path, *span), container)

    ship_package(spark)
    chunks = paths.select("path").repartition("path").mapInPandas(plan, CHUNK_SCHEMA)
    entries = chunks.repartition("path", "lo").mapInPandas(read, ENTRY_SCHEMA)
    parsed = F
    for layout in layouts:
        parsed = parsed.when(F.col("layout") == layout, keys.parse_tile_path(layout, F.col("name")))
    key = parsed.otherwise(F.lit(None))
    return entries.withColumn("_key", key).select(
        "container", "name", F.coalesce("z", "_key.z").alias("z"), F.coalesce("x", "_key.x").alias("x"),
        F.coalesce("y", "_key.y").alias("y"), F.coalesce("_key.ext", "format").alias("format"), "data",
        F.octet_length("data").cast("long").alias("size"))


# ---- export ------------------------------------------------------------------------------------


def _held_box(tiles: pd.DataFrame, grid: Grid) -> list[float]:
    """Box of the tiles in the units of their grid."""
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for z, part in tiles.groupby("z"):
        span = grid.resolutions[int(z)] * grid.tile_size
        x0, x1, y0, y1 = part["x"].min(), part["x"].max() + 1, part["y"].min(), part["y"].max() + 1
        low, high = (grid.bbox[3] - y1 * span, grid.bbox[3] - y0 * span) if grid.origin in ("nw", "ul") else (grid.bbox[1] + y0 * span, grid.bbox[1] + y1 * span)
        box = [min(box[0], grid.bbox[0] + x0 * span), min(box[1], low), max(box[2], grid.bbox[0] + x1 * span), max(box[3], high)]
    return box


def _write_zip(tiles: pd.DataFrame, meta: dict, grid: Grid) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("metadata.json"), json.dumps(meta, sort_keys=True))
        for path, data in zip(tiles["path"], tiles["data"]):
            z.writestr(zipfile.ZipInfo(path), bytes(data))
    return out.getvalue()


def _write_tar(tiles: pd.DataFrame, meta: dict, grid: Grid) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as gz, tarfile.open(fileobj=gz, mode="w") as t:
        def add(name, payload):
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            t.addfile(info, io.BytesIO(payload))

        add("metadata.json", json.dumps(meta, sort_keys=True).encode())
        for path, data in zip(tiles["path"], tiles["data"]):
            add(path, bytes(data))
    return out.getvalue()


def _packed(data) -> bytes:
    return gzip.compress(bytes(data), mtime=0)


def _write_mbtiles(tiles: pd.DataFrame, meta: dict, grid: Grid) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE metadata (name text, value text)")
    con.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
    con.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
    con.executemany("INSERT INTO metadata VALUES (?, ?)", [(k, str(v)) for k, v in sorted(meta.items())])
    con.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [
        (int(z), int(x), (1 << int(z)) - 1 - int(y), _packed(d)) for z, x, y, d in zip(tiles["z"], tiles["x"], tiles["y"], tiles["data"])])
    con.commit()
    return con.serialize()


def _write_gpkg(tiles: pd.DataFrame, meta: dict, grid: Grid) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("PRAGMA application_id = 1196444487")
    con.execute("CREATE TABLE gpkg_contents (table_name text PRIMARY KEY, data_type text, identifier text, description text, "
                "min_x double, min_y double, max_x double, max_y double, srs_id integer)")
    con.execute("CREATE TABLE gpkg_tile_matrix_set (table_name text PRIMARY KEY, srs_id integer, min_x double, min_y double, max_x double, max_y double)")
    con.execute("CREATE TABLE gpkg_tile_matrix (table_name text, zoom_level integer, matrix_width integer, matrix_height integer, "
                "tile_width integer, tile_height integer, pixel_x_size double, pixel_y_size double, PRIMARY KEY (table_name, zoom_level))")
    con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name text, srs_id integer PRIMARY KEY, organization text, "
                "organization_coordsys_id integer, definition text, description text)")
    name, code = str(meta["name"]), int(grid.srs.split(":")[1])
    for srs in sorted({-1, 0, 4326, code}):  # the first three belong to every file
        con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', '')", (
            f"EPSG:{srs}" if srs > 0 else "undefined", srs, "EPSG" if srs > 0 else "NONE", srs))
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'tiles', ?, ?, ?, ?, ?, ?, ?)", (name, name, meta["format"], *_held_box(tiles, grid), code))
    con.execute("INSERT INTO gpkg_tile_matrix_set VALUES (?, ?, ?, ?, ?, ?)", (name, code, *grid.bbox))
    for z in sorted(set(int(v) for v in tiles["z"])):
        con.execute("INSERT INTO gpkg_tile_matrix VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (
            name, z, *grid.size(z), grid.tile_size, grid.tile_size, grid.resolutions[z], grid.resolutions[z]))
    quoted = _quoted(name)
    con.execute(f"CREATE TABLE {quoted} (id integer PRIMARY KEY AUTOINCREMENT, zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
    con.executemany(f"INSERT INTO {quoted} (zoom_level, tile_column, tile_row, tile_data) VALUES (?, ?, ?, ?)", [
        (int(z), int(x), int(y), _packed(d)) for z, x, y, d in zip(tiles["z"], tiles["x"], tiles["y"], tiles["data"])])
    con.commit()
    return con.serialize()


#: Data of one container, about.
MAX_BYTES = 128 << 20

WRITERS: dict[str, tuple[str, Callable[[pd.DataFrame, dict, Grid], bytes]]] = {
    "zip": (".zip", _write_zip), "tar": (".tar.gz", _write_tar), "mbtiles": (".mbtiles", _write_mbtiles), "gpkg": (".gpkg", _write_gpkg),
}


def assign_shards(tiles: DataFrame, level: int, max_tiles: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``shard``: the ancestor tile at ``level``, split into parts of about ``max_tiles`` tiles and ``max_bytes`` of data, whichever
    gives more.

    Parts come from counts, sizes and a hash of the key, so an area with a third of all tiles, or of large ones, becomes many
    containers instead of one.
    """
    z = F.col("z")
    area = F.concat_ws("-", F.least(z, F.lit(level)), keys.ancestor(F.col("x"), z, level), keys.ancestor(F.col("y"), z, level))
    placed = tiles.withColumn("_area", area)
    size = F.coalesce(F.sum(F.octet_length("data")), F.lit(0)) if "data" in tiles.columns else F.lit(0)
    parts = placed.groupBy("_area").agg(F.greatest(F.ceil(F.count(F.lit(1)) / max_tiles), F.ceil(size / max_bytes)).cast("long").alias("_parts"))
    part = F.pmod(F.xxhash64("z", "x", "y"), F.col("_parts"))
    return placed.join(parts, "_area").withColumn("shard", F.concat_ws("-", "_area", part)).drop("_area", "_parts")


def export_containers(
    tiles: DataFrame, root: str, kind: str, name: str, grid: Grid, level: int = 2, max_tiles: int = 20_000, layout: str = "tms",
    source: Grid | None = None, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Write tiles (z, x, y, format, data) as one container per shard; returns the manifest. A task holds one shard, which
    ``max_tiles`` and ``max_bytes`` bound.

    Payloads are gzipped in MBTiles and GeoPackage and raw in archives. The manifest carries each
    container's path, tile count, zoom range and bounds, taken from the keys. Tiles of another
    ``source`` grid are keyed anew; a tile that fits no single tile of ``grid`` refuses the export.
    """
    suffix, writer = WRITERS[kind]
    if source is not None and source != grid:
        moved, misfits = rekey(tiles, source, grid)
        if misfits.limit(1).count():
            raise ValueError("tiles do not align to the target grid")
        tiles = moved.drop("z", "x", "y").withColumnsRenamed({"nz": "z", "nx": "x", "ny": "y"})
    key = ("z", "x", "y")
    # a container holds a key once; copies are combined before they could crowd a shard
    single = latest(tiles, key) if "mtime" in tiles.columns else tiles.dropDuplicates(list(key))
    sharded = assign_shards(single, level, max_tiles, max_bytes).withColumn(
        "path", keys.tile_path(layout, F.col("x"), F.col("y"), F.col("z"), F.col("format")))
    meta = tileset_metadata(sharded, by="shard", grid=grid)
    described = sharded.select("shard", "z", "x", "y", "format", "path", "data").join(meta.select(
        "shard", "min_zoom", "max_zoom", "minx", "miny", "maxx", "maxy"), "shard")
    origin, srs, base = grid.origin, grid.srs, qualified(tiles.sparkSession, root)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        bounds = ",".join(repr(float(first[c])) for c in ("minx", "miny", "maxx", "maxy"))
        info = dict(
            name=name, format=first["format"], type="overlay", minzoom=int(first["min_zoom"]), maxzoom=int(first["max_zoom"]), bounds=bounds,
            center=f"{(first['minx'] + first['maxx']) / 2},{(first['miny'] + first['maxy']) / 2},0", directory_layout=layout,
            origin=origin, srs=srs, bounds_srs="EPSG:4326", res_factor="2", tile_size=grid.tile_size)
        target = f"{base}/{name}-{first['shard']}{suffix}"
        put_bytes(target, writer(group.sort_values(["z", "x", "y"]), info, grid))
        return pd.DataFrame([dict(shard=first["shard"], container=target, tiles=len(group), min_zoom=info["minzoom"],
                                  max_zoom=info["maxzoom"], minx=first["minx"], miny=first["miny"], maxx=first["maxx"], maxy=first["maxy"])])

    schema = "shard string, container string, tiles long, min_zoom int, max_zoom int, minx double, miny double, maxx double, maxy double"
    ship_package(tiles.sparkSession)
    # the manifest is stored: reading it again must not write the containers again
    manifest = f"{root}/manifest-{name}-{kind}"
    described.groupBy("shard").applyInPandas(write, schema).write.mode("overwrite").parquet(manifest)
    return tiles.sparkSession.read.parquet(manifest)
