"""lodestrata: configuration-driven analysis pipelines and corpus operators on PySpark."""

__version__ = "0.1.0"
