"""Hook for payload decoders supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def decode_payloads(tiles: DataFrame, decoder: Callable, schema: str) -> DataFrame:
    """Run a user decoder over batches of tiles.

    ``decoder`` takes and returns a pandas frame (any number of rows out per tile) with the columns
    of ``schema``. It sees one Arrow batch at a time, so memory does not grow with the data.
    """
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield decoder(batch)

    return tiles.mapInPandas(run, schema)
