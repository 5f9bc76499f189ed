"""Column builders: tile keys, grids, geometry, elevation, request parsing."""
