"""Query plans over the given tables; importing a module registers its queries."""
