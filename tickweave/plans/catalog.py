"""Query catalogue: name -> builder, and name -> DuckDB SQL of the same result."""

from . import basics, binary_models, estimators, files, model_specs, panels, samples, temporal

MODULES = [basics, temporal, panels, samples, model_specs, files, estimators, binary_models]
QUERIES: dict = {}
ORACLES: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
FLAGSHIP = temporal.large_ordinary_flow
