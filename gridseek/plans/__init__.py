"""What plans need besides columns: measured broadcasts and cut lineage."""
