"""Set-based analytics over trade and shipping cases, written for Spark."""
