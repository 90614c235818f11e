"""The line filter of the batch engine on an unbounded text source."""
