"""Column functions of document text."""
