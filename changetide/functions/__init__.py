"""Column expressions: JSON access, parsing, source metadata, presentation."""
