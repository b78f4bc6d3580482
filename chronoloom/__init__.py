"""chronoloom: a PySpark-native engine for keyed time-series snapshots and their behaviour."""
