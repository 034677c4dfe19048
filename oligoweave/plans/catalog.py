"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> SQL."""

from __future__ import annotations

from oligoweave.plans import catalog_pool, catalog_profile, catalog_search, catalog_sequences, catalog_spacers, catalog_tables

_PARTS = [catalog_profile, catalog_sequences, catalog_tables, catalog_search, catalog_spacers, catalog_pool]

FLAGSHIP = "greedy_panel_selection"
QUERIES: dict = {}
ORACLE: dict = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
