"""hydroframe: analytics for hydrodynamic simulation results on Spark DataFrames."""

__version__ = "0.1.0"
