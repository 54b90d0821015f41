"""functions of the raster engine."""
