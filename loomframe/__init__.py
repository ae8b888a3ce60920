"""loomframe: dataset building, auditing and evaluation as Spark DataFrame operators."""
