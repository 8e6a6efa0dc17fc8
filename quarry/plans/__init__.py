"""Queries over the operators, each with the SQL that says the same where SQL can."""
