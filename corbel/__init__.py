"""corbel: Spark-native code and corpus linkage engine."""

__version__ = "0.1.0"
