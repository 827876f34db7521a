"""talewind: Spark-native analytics over endpoint telemetry and training-data tables."""
