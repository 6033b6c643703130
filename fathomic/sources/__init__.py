"""Frame input, column and row selection, model files."""
