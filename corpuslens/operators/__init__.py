"""corpuslens.operators: DataFrame operators."""
