"""Queries by name and their SQL twins."""

from __future__ import annotations

from . import along, merging, network, overlays, reading, repeats, screens  # noqa: F401  they add their queries to COMPOSED
from .composed import COMPOSED, COMPOSED_SQL
from .dialect import Duck, Spark
from .fixtures import with_views
from .relational import RELATIONAL

FLAGSHIP = "altitude_time"


def _run(text):
    return lambda spark, sf_dir: spark.sql(with_views(Spark(sf_dir), text(Spark(sf_dir))))


QUERIES: dict = {name: _run(text) for name, text in RELATIONAL.items()} | COMPOSED
ORACLES: dict[str, str] = {name: with_views(Duck(), text(Duck())) for name, text in RELATIONAL.items()} | COMPOSED_SQL
