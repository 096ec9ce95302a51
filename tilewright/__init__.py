"""tilewright: a PySpark-native engine for large tiled remote-sensing tables.

Rasters, vector segments, lidar points and training data are DataFrames keyed
by tile; operators are DataFrame plans. See README.md for the map of modules.
"""

__version__ = "0.1.0"
