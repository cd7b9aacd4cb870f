"""Privacy-aware panel analytics as DataFrame -> DataFrame functions on Spark SQL."""
