"""Images as DataFrames."""
