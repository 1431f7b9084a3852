"""End-to-end plans over the operators, and the registered queries."""
