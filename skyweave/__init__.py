"""skyweave: best-observation composites and related raster analytics, declared as Spark plans."""
