"""A PySpark-native engine for corpora, vectors and their similarity graphs."""
