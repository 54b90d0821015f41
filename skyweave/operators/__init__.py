"""operators of the raster engine."""
