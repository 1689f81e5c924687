"""A PySpark-native analytics engine for batch geodata: typed layers, spatial joins, grids, pyramids, contracts."""
