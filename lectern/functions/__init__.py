"""Column functions: text, identifiers, URLs and message frames."""
