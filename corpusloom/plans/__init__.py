"""End-to-end plans made of the operators, and the catalogue of checked queries."""
