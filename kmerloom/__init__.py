"""k-mer set analytics on PySpark: extraction, masked superstrings, masks, bounds."""
