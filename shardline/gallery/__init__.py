"""Every operator run on the provided tables, with the SQL that states the same result."""

from shardline.gallery import (  # noqa: F401  (importing registers the queries)
    accounts,
    catalog,
    elt,
    flow,
    functions,
    relational,
    storage,
)
from shardline.gallery.base import ORACLE, QUERIES  # noqa: F401
