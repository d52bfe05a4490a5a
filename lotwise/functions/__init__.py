"""Column builders: geometry, band measures, damage classes, hashes."""
