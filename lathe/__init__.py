"""lathe: exact, Python-semantics data processing on PySpark."""

__version__ = "0.1.0"
