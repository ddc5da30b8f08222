"""operators of the spatial library."""
