"""Question-driven table reduction as Spark jobs over many questions and tables at once."""
