"""Named queries over the tables, and SQL that gives the same rows."""
