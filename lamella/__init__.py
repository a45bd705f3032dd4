"""lamella: a PySpark-native analytics engine for donor-keyed tissue tables."""
