"""DataFrame -> DataFrame operators, one module per business objective."""
