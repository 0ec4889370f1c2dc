"""Pure helpers: format rules, output naming, SQL text clean-up, column names."""
