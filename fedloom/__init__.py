"""fedloom: Spark-native analytics over federated parameter updates."""

__version__ = "0.1.0"
