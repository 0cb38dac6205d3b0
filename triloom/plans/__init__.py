"""Query text to algebra, and the choice of a join order."""
