"""Column-level building blocks: text normal forms, seeded randomness, scoring."""
