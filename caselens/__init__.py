"""caselens: a PySpark-native engine for evaluating retrieval-augmented question answering."""

__version__ = "0.1.0"
