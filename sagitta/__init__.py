"""sagitta: a PySpark-native engine for exchange-matrix (quiver) analytics."""

__version__ = "0.1.0"
