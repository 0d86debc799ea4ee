"""Column functions: text, addresses, dates, identities, scores."""
