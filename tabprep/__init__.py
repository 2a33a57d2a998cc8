"""tabprep: profiling and preparing large tables for modelling, on Spark DataFrames."""

__version__ = "0.1.0"
