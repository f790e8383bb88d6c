"""Customer feature, decision and monitoring analytics as Spark DataFrame functions."""
