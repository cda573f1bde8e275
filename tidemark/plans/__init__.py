"""End-to-end assemblies of the operators, and the SQL used to check them."""
