"""basisweave: cross-venue spread analytics as PySpark DataFrame jobs."""
