"""A PySpark-native engine for dense grids, vectors, particles and short series."""
