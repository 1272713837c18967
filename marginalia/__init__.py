"""Retrieval and analytics over document libraries, as Spark DataFrame plans."""
