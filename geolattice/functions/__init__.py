"""functions of the spatial library."""
