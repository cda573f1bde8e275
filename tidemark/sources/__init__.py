"""Readers that bring raw tables to the column names the operators expect."""
