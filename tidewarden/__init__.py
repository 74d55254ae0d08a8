"""A Spark-native engine that scans tool-calling traffic, applies policy and tracks tool manifests."""

__version__ = "0.1.0"
