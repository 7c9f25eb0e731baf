"""A PySpark-native analytics engine: a small SQL-like dialect and a Python API over a database.table catalog."""
