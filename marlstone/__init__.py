"""Corpus analytics on PySpark: notes in, DataFrame plans out."""
