"""gridspark: power-grid resilience analytics as PySpark DataFrame operators."""
