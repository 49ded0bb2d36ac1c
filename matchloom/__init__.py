"""matchloom: a PySpark-native engine that matches long records to criteria documents."""

__version__ = "0.1.0"
