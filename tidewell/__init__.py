"""tidewell: curating event timelines and training corpora with Spark DataFrames."""

__version__ = "0.1.0"
