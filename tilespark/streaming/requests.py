"""Request streams: classification against a store that is written meanwhile, windowed metrics, counters between resets, and
one creation per meta tile and interval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilespark.functions import keys
from tilespark.functions.tilemath import Grid
from tilespark.streaming.jobs import block_of, run_batches

KEY = ("z", "x", "y")


def classify(requests: DataFrame, stored: DataFrame, grid: Grid, expire: Column, covered: DataFrame | None = None, salts: int = 8) -> DataFrame:
    """Add ``state``: out_of_range, empty (outside the coverage), hit, stale or miss.

    Works on batches and streams. The static side is repeated once per salt, so requests for one
    popular tile spread over several join tasks. Of several writes of a stored tile the last counts.
    """
    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = requests.withColumn("_salt", salt)
    known = stored.groupBy(*KEY).agg(F.max("mtime").alias("_mtime")).withColumn("_salt", spread)
    joined = salted.join(known, [*KEY, "_salt"], "left")
    inside = F.lit(True)
    if covered is not None:
        area = covered.select(*KEY).distinct().withColumn("_covered", F.lit(True)).withColumn("_salt", spread)
        joined = joined.join(area, [*KEY, "_salt"], "left")
        inside = F.coalesce(F.col("_covered"), F.lit(False))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    level = F.greatest(F.least(z, F.lit(grid.levels - 1)), F.lit(0))
    served = keys.valid_key(x, y, z) & keys.in_matrix(x, y, grid.grid_w(level), grid.grid_h(level))
    state = (
        F.when(~served, "out_of_range").when(~inside, "empty")
        .when(F.col("_mtime").isNull(), "miss").when(F.col("_mtime") < expire, "stale").otherwise("hit")
    )
    return joined.withColumn("state", state).select(*requests.columns, "state")


def judged(requests: DataFrame, stored: DataFrame, grid: Grid, expire: Column, covered: DataFrame | None = None) -> DataFrame:
    """:func:`classify` for one batch of requests: each distinct key is looked up once, and nothing is repeated.

    If the store is partitioned by blocks (a column ``block``, see ``jobs.upsert_tiles``), only the blocks that the batch asks for
    are read. A tile that many requests ask for is one key in the lookups; requests then join their key's answer, where Spark splits
    a hot key.
    """
    asked = requests.select(*KEY).distinct()
    if "block" in stored.columns:
        asked = asked.withColumn("block", block_of(F.col("x"), F.col("y")))
        blocks = asked.select("z", "block").distinct()
        stored = stored.join(blocks, ["z", "block"], "left_semi")
    known = stored.join(asked, list(KEY), "left_semi").groupBy(*KEY).agg(F.max("mtime").alias("_mtime"))
    answers = asked.select(*KEY).join(known, list(KEY), "left")
    inside = F.lit(True)
    if covered is not None:
        area = covered.select(*KEY).join(asked, list(KEY), "left_semi").distinct().withColumn("_covered", F.lit(True))
        answers = answers.join(area, list(KEY), "left")
        inside = F.coalesce(F.col("_covered"), F.lit(False))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    level = F.greatest(F.least(z, F.lit(grid.levels - 1)), F.lit(0))
    served = keys.valid_key(x, y, z) & keys.in_matrix(x, y, grid.grid_w(level), grid.grid_h(level))
    state = F.when(~served, "out_of_range").when(~inside, "empty").when(F.col("_mtime").isNull(), "miss").when(
        F.col("_mtime") < expire, "stale").otherwise("hit")
    answers = answers.select(*[F.col(k).alias(f"_{k}") for k in KEY], state.alias("state"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return requests.join(answers, same[0] & same[1] & same[2]).select(*requests.columns, "state")


def classify_stream(requests: DataFrame, lookup: Callable[[], tuple[DataFrame, DataFrame | None]], grid: Grid, expire: Column, path: str, checkpoint: str) -> None:
    """Classify what has arrived into Parquet under ``path``, one folder a batch.

    ``lookup`` gives the store and the coverage as they are when a batch begins, so a batch sees what earlier ones, or another
    stream, have written. A batch that runs again after a failure replaces its own folder.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        stored, covered = lookup()
        judged(batch, stored, grid, expire, covered).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    run_batches(requests, handle, checkpoint)


def windowed_metrics(classified: DataFrame, ts: str, window: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Hits, misses and errors per window, service and layer; windows close behind the watermark."""
    late = classified.withWatermark(ts, watermark) if watermark else classified
    bad = F.col("event_type") == "error"
    hit = F.col("state") == "hit"
    counted = late.groupBy(F.window(ts, window, slide), "service", "layer").agg(
        F.count_if(hit & ~bad).alias("hits"), F.count_if(~hit & ~bad).alias("misses"), F.count_if(bad).alias("errors"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          "service", "layer", "hits", "misses", "errors")


SEGMENT = "service long, layer long, salt int, since timestamp, until timestamp, hits long, misses long, errors long"
_HELD = "since long, hits long, misses long, errors long, at array<long>, code array<int>"
_RESET = 3


def _rows(parts: list[tuple[int, int | None, np.ndarray]], key: tuple) -> pd.DataFrame:
    at = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
    return pd.DataFrame({
        "service": key[0], "layer": key[1], "salt": key[2], "since": pd.Series([at(s) for s, _, _ in parts], dtype="datetime64[us]"),
        "until": pd.Series([at(u) for _, u, _ in parts], dtype="datetime64[us]"), **{n: [int(c[i]) for _, _, c in parts] for i, n in enumerate(("hits", "misses", "errors"))}})


def counters_between_resets(classified: DataFrame, resets: DataFrame, layers: DataFrame, ts: str, watermark: str = "10 minutes", salts: int = 8) -> DataFrame:
    """Hits, misses and errors of each service and layer between one reset of its service and the next, as rows of ``SEGMENT``: one
    per salt, to be added up with :func:`segment_totals`.

    ``resets``: a stream of ``service`` and ``ts``; a reset belongs to the time after it. ``layers``: the services and their layers, a static
    table. A segment is given once the watermark has passed its end, so events and resets may come in any order up to the delay. What
    comes before the first reset begins at no time (null); what comes after the last one is not given, as it is still open. Events of one time
    and a reset at that time are taken reset first. State holds a segment's three counts and the events inside the delay; events are dealt
    over salts, so that a hot layer is several groups.
    """
    bad, hit = F.col("event_type") == "error", F.col("state") == "hit"
    events = classified.select("service", "layer", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"), F.col(ts).alias("at"),
                               F.when(bad, 2).when(hit, 0).otherwise(1).alias("code"))
    known = layers.select("service", "layer").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marks = resets.join(known, "service").select("service", "layer", "salt", F.col(ts).alias("at"), F.lit(_RESET).alias("code"))
    rows = events.unionByName(marks).withWatermark("at", watermark)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, counts, at, code = None, np.zeros(3, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        if state.exists:
            since, *n, held_at, held_code = state.get
            counts = np.array(n, np.int64)
            at.append(np.array(held_at, np.int64))
            code.append(np.array(held_code, np.int32))
        for batch in batches:
            at.append(batch["at"].to_numpy("datetime64[us]").astype(np.int64))
            code.append(batch["code"].to_numpy(np.int32))
        at, code = np.concatenate(at), np.concatenate(code)
        order = np.lexsort((code != _RESET, at))
        at, code = at[order], code[order]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(at, passed, side="left"))  # nothing earlier can come
        cuts = np.flatnonzero(code[:ready] == _RESET)
        out, begin = [], 0
        for cut in cuts:
            counts = counts + np.bincount(code[begin:cut], minlength=4)[:3]
            out.append((since, int(at[cut]), counts))
            since, counts, begin = int(at[cut]), np.zeros(3, np.int64), cut + 1
        counts = counts + np.bincount(code[begin:ready], minlength=4)[:3]
        rest = at[ready:]
        state.update((since, *(int(c) for c in counts), rest.tolist(), code[ready:].tolist()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest[0]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield _rows(out, key)

    return rows.groupBy("service", "layer", "salt").applyInPandasWithState(fold, SEGMENT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def segment_totals(segments: DataFrame) -> DataFrame:
    """Segments of all salts added up."""
    return segments.groupBy("service", "layer", "since", "until").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("errors").alias("errors"))


def meta_tile_requests(requests: DataFrame, ts: str, meta: int = 4, interval: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """Meta tiles that are asked for, once per interval: requests deduplicated by meta tile and interval behind a watermark.

    Time is cut into intervals, so the outcome does not depend on how micro-batches fall.
    """
    main = requests.select(
        "z", keys.main_tile(F.col("x"), meta).alias("mx"), keys.main_tile(F.col("y"), meta).alias("my"),
        F.window(ts, interval)["start"].alias("slot"))
    return main.withWatermark("slot", watermark).dropDuplicates(["z", "mx", "my", "slot"])
