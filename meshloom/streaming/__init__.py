"""Sets and maps are static in this model, so it has no stream operators; iteration lives in ``meshloom.plans``."""
