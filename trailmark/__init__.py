"""Spark-native analytics over fact catalogues, trajectories, rasters and road graphs."""
