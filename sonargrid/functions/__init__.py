"""Column functions on texts: quantities, dates, notes, channel lists, names."""
