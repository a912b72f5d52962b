"""Second constructions: alternate graphs of a session, each a store of its own by name.

The main store is never touched. A construction lives as long as the session: the
first time that a session opens a name, what an earlier one left under it goes, and
so does what was built from another source under the same name. Opened with the
same source, or without one, it stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import commit
from ..operators.checkpoint import shared_dir
from ..operators.graph import adjacency
from . import store

# Fixed value: names that a session may open.
MOST = 8


class Constructions:
    def __init__(self, spark: SparkSession, root: str | None = None):
        """``root`` is a folder that executors share, a project's own; by default one in the checkpoint folder."""
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/graphloom/constructions").rstrip("/")
        self._source: dict[str, str | None] = {}

    def _key(self, name: str) -> str:
        return self.spark.range(1).select(slug(F.lit(name)).alias("s")).first()["s"]

    def open(self, name: str, source: str | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> str:
        """The path of a construction's store. A new one, or one built again, has the
        given nodes and edges, or none. Names of one slug are one construction;
        a name beyond the eighth is refused."""
        key = self._key(name)
        path = f"{self.root}/{key}"
        known = key in self._source
        if not known and len(self._source) >= MOST:
            raise ValueError(f"a session has at most {MOST} constructions: open one of {', '.join(sorted(self._source))}")
        if known and source in (None, self._source[key]):
            return path
        store.remove(self.spark, path)
        commit.create(self.spark, path, nodes, edges)
        self._source[key] = source
        return path

    def pairs(self, name: str) -> DataFrame:
        """``u, v``: neighbours over the live edges of a construction that was opened."""
        key = self._key(name)
        if key not in self._source:
            raise KeyError(name)
        return adjacency(store.current(self.spark, f"{self.root}/{key}")["edges"])
