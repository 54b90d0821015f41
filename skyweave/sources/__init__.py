"""sources of the raster engine."""
