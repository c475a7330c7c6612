"""Quillstone: text-evidence analytics expressed as PySpark DataFrame plans."""
