"""tesserine: a passage-retrieval and corpus-analytics engine made of PySpark DataFrame operators."""
