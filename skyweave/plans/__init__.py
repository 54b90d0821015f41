"""plans of the raster engine."""
