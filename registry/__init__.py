"""The registered queries and the SQL that states their expected results."""
