"""panelspark: Spark-native multi-site daily panel modelling and attribution."""

__version__ = "0.1.0"
