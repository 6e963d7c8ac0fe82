"""tessera: analytics over tiles, patch vectors and training text, expressed as Spark DataFrame plans."""
