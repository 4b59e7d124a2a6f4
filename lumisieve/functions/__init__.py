"""Column functions on pixels, rasters and hash values."""
