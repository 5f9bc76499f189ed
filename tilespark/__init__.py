"""Spark-first analysis and maintenance of map-tile pyramids."""
