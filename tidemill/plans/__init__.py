"""Named queries over the star-schema and text tables, with DuckDB SQL for each."""

from . import events, items, mail, orders, resolution, streams, texts, views, writes  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
