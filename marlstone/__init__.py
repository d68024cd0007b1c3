"""Spark-native engine for spatio-temporal objects, dialogue links and result scoring."""
