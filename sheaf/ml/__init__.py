"""Spark ML: description features, category classifier with keyword fallback, isolation forest."""
