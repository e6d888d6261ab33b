"""millrace: dataset curation for text and vectors, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
