"""streaming of the raster engine."""
