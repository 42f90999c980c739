"""Document search, cataloguing and synchronisation as Spark DataFrame plans."""
