"""Column expressions: cleaning, domains, addresses, patterns."""
