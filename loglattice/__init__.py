"""Log evidence analytics expressed as Spark DataFrame plans."""
