"""shelfmark: a Spark-native engine for analysing and auditing large file catalogues."""

__version__ = "0.1.0"
