"""The surveyed surface has no unbounded sources, so no streaming operator is built here."""
