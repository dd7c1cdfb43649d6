"""Reading of tables."""
