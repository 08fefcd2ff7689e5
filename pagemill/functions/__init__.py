"""Column functions: native expressions, no Python in the execution path."""
