"""codeweft: a PySpark engine for typed code graphs and the text they come from."""

__version__ = "0.1.0"
