"""PySpark-native engine for sampled-model ensembles and corpus preparation."""
