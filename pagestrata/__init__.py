"""Layout analytics over tables of positioned page content, written as Spark DataFrame operators."""
