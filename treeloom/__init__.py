"""A PySpark-native engine for labelled trees, text retrieval and evaluation reports."""
