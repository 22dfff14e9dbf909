"""Every query of the engine with its DuckDB oracle, by name."""

from .plans import catalog, ingest, kept, opinions, origins, outside, products, rankings, readings, reports, whole  # noqa: F401, the others register theirs in the catalogue's

FLAGSHIP = "rank_products"
QUERIES: dict = {**catalog.QUERIES}
ORACLES: dict = {**catalog.ORACLES}
