"""DataFrame -> DataFrame operators, one module per group of the blueprint."""
