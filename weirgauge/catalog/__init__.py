"""All registered queries."""

from weirgauge.catalog import analysis, detection, ingest, nat, traffic  # noqa: F401
from weirgauge.catalog.registry import ORACLES, QUERIES  # noqa: F401
