"""A PySpark-native engine for sequence annotation and taxonomic profiling."""
