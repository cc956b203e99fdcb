"""corpuslens.sources: readers, writers and snapshot tables."""
