"""PySpark-native tick and regime analytics."""
