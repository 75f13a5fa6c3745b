"""Comparative-genomics analytics expressed as PySpark DataFrame plans."""
