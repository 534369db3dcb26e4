"""Movement analytics on Spark: keypoint tables, latents and state paths in,
endpoint tables out.  Every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
