"""Queries of the validation engine over the benchmark tables, with the SQL that gives the same rows."""
