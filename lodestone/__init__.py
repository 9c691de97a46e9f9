"""Lodestone: text retrieval, graph evaluation and paired statistics as Spark DataFrame plans."""
