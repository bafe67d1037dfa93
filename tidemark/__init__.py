"""Tidemark: a Spark-native analytics engine for episodic time series and training corpora."""

__version__ = "0.1.0"
