"""Column -> Column functions: text, missing values, numbers."""
