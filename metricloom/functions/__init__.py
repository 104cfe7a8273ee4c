"""Column-level functions: filters, formulas, time grains and formats."""
