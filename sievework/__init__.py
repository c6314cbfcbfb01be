"""PySpark-native corpus curation engine."""
