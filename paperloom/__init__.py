"""paperloom: document-grounded dataset construction, retrieval, review and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
