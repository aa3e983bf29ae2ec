"""Column-level helpers (all Catalyst expressions, no UDFs)."""
