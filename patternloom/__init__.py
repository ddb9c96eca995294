"""Log-pattern analytics and text processing on Spark."""
