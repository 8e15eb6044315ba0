"""A PySpark-native analytics engine for uniformly sampled signals."""

__version__ = "0.1.0"
