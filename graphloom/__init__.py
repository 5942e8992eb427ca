"""graphloom: Spark jobs over very large collections of small graphs."""
