"""terrane: a Spark-native engine for spatial tables, rasters, networks and linear references."""

__version__ = "0.1.0"
