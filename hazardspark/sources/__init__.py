"""Table, feature and raster readers and writers."""
