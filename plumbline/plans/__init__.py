"""Driver queries: the operators applied to the supplied tables, each with its SQL."""
