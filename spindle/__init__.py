"""spindle: a Spark-native engine for preparing and auditing training corpora."""
