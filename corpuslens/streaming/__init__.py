"""corpuslens.streaming: incremental jobs."""
