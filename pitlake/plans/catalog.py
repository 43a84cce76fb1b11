"""All catalogue modules, imported for their registrations."""

from . import (  # noqa: F401
    catalog_aggs, catalog_evals, catalog_joins, catalog_models, catalog_scalars, catalog_sources, catalog_squads, catalog_windows, feature_table,
)
from .registry import ORACLES, QUERIES  # noqa: F401
