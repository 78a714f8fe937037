"""leafwright: a Spark-native analytics engine for long-form documents."""

__version__ = "0.1.0"
