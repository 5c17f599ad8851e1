"""orrery: a PySpark-native engine for gridded volumes, meshes, replicated state streams and run logs."""
