"""PySpark-native engine for linking and harmonising multi-source spatial records."""
