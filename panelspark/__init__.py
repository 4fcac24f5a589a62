"""PySpark-native record linkage, panel building and measurement."""
