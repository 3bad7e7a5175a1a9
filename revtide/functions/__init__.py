"""Column functions that operators share."""
