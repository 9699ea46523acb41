"""PySpark-native anomaly detection on sequences of log events."""
