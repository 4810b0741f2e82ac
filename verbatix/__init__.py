"""Text diagnostics on Spark: labelled corpora as DataFrame plans."""
