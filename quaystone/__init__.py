"""A PySpark-native analytics engine for payment-style transaction data."""
