"""Column expressions: satellites and units, validation, zigzag and delta transforms, bit layout."""
