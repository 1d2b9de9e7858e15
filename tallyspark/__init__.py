"""tallyspark: a PySpark-native engine for company financial reporting and research text."""
