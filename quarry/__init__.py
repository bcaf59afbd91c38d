"""quarry: a PySpark-native retrieval and document-analytics engine."""
