"""terrane: geodata analytics and corpus-scale data preparation on PySpark."""
