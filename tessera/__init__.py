"""tessera: a PySpark-native analytics engine for code graphs and text corpora."""

__version__ = "0.1.0"
