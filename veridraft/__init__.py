"""Analytics over batches of generated text, declared as Spark DataFrames."""

__version__ = "0.1.0"
