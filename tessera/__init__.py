"""A PySpark-native analytics library: tables, statistics, graphs, factors and streams as DataFrame plans."""
