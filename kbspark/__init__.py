"""Knowledge-base and retrieval work as Spark jobs over tables."""
