"""Analytics over rasters and discrete global grids on Spark."""
