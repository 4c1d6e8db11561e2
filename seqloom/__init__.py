"""seqloom: DataFrame operators for sequence, structure and corpus tables on PySpark."""
