"""lumenfold: media-catalog analytics on PySpark DataFrames."""
