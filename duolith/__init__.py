"""duolith: a Spark-native engine for aligning and auditing document corpora."""
