"""tidemark: a Spark-native engine for labelled time-series metrics."""
