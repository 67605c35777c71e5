"""Column -> Column functions (native expressions; C5 fold and LCS are Arrow UDFs)."""
