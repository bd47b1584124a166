"""seqlake: a PySpark-native analytics engine for amplicon sequence data and training-data pipelines."""
