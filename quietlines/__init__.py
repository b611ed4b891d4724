"""quietlines: a Spark-native engine that makes session logs safe to share."""

__version__ = "0.1.0"
