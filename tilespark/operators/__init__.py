"""DataFrame operators over tiles, coverages, rasters, features and requests."""
