"""Find information disclosure in captured web data with Spark."""

__version__ = "0.1.0"
