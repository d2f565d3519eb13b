"""Media metadata analytics on Spark: containers, parts, tags and codecs as DataFrames."""

__version__ = "0.1.0"
