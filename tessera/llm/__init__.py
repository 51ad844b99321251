"""Training-data operators: one module per operator, plus the registered
queries (``queries``).  Nothing outside this package imports it."""
