"""weftline: a relational dataset engine on the PySpark DataFrame API."""

__version__ = "0.1.0"
