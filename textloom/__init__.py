"""textloom: document segmentation, editing and redaction over collections, on Spark."""

__version__ = "0.1.0"
