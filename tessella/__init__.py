"""A relational analytics engine expressed as PySpark DataFrame plans."""
