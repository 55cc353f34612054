"""A PySpark-native analytics engine for single-cell time-lapse assays."""
