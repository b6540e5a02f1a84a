"""sievework: a Spark-first analytics library for screening document collections."""
