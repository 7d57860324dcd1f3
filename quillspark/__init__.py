"""quillspark: document field extraction and corpus preparation on PySpark DataFrames."""

__version__ = "0.1.0"
