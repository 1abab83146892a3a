"""Review-comprehension evaluation as Spark jobs over tables of examples and answers."""
