"""Perceptual image hashing and similarity search on Spark DataFrames."""
