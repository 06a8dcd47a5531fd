"""Change-evidence analytics as PySpark DataFrame operators."""
