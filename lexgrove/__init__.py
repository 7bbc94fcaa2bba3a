"""A PySpark-native engine for building and scoring question sets over concept hierarchies."""
