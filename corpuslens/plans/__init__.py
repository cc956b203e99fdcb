"""corpuslens.plans: composed analytics."""
