"""From restricted Python expressions to plans."""
