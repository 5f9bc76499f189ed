"""Tile sources and sinks: directories, containers, feature JSON, access logs, fetch manifests."""
