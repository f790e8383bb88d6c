"""Named queries over the given tables, each with the SQL that states the expected result."""
