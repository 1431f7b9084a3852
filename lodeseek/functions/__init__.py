"""Column functions: pure expressions unless the name says otherwise."""
