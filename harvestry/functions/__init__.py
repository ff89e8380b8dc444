"""Functions of the listings engine."""
