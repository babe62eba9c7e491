"""Plans: end-to-end analysis plan, the query catalogue and its SQL oracle."""
