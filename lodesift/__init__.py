"""lodesift: retrieval, evaluation and text-collection analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
