"""Ledgerline: Spark-native operators for auditing and summarising large record collections."""
