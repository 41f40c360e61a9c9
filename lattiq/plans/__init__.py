"""From formulas and view queries to DataFrame plans."""
