"""corpuslens.functions: column expressions."""
