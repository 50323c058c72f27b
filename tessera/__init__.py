"""tessera: ordered, NA-aware data frames and corpus tools on PySpark."""
