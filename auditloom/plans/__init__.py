"""Named queries over the driver's tables, each a call of operators, with the SQL that says the same."""
