"""An index that follows changes and deletions.

``SymbolTable`` keeps one row per file, its digest and its symbols, in a
``KeyedTable``: a changed file's row takes the place of the old one and a
deleted file's row goes, so symbols that a file no longer has are withdrawn
with it and the postings equal those of a full rebuild.

Changes come as a batch (``update``), by comparing a new snapshot with what is
indexed (``refresh``: only files whose digest differs are analysed), or as a
stream of (path, ..., content, deleted, seq) rows (``follow``), where of several
rows of one file the last counts.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.plans.registry import ExtractorRegistry
from quarry.session import bound_batches
from quarry.sources.commits import KeyedTable

SCHEMA = ("path string, repo string, language string, sha string, symbols array<struct<symbol:string,kind:string>>, error string")


@dataclasses.dataclass
class SymbolTable:
    spark: SparkSession
    root: str
    registry: ExtractorRegistry | None = None
    buckets: int = 32

    def __post_init__(self):
        self.table = KeyedTable(self.spark, self.root, SCHEMA, "path", self.buckets)

    def _rows(self, files: DataFrame) -> DataFrame:
        bound_batches(files.sparkSession)
        r = IX.checked_symbols_expr(self.registry)
        seen = files.select("path", "repo", "language", "sha", F.col("read_error"), r.alias("r"))
        return seen.select("path", "repo", "language", "sha", F.col("r.symbols").alias("symbols"), F.coalesce("read_error", "r.error").alias("error"))

    def update(self, files: DataFrame, deleted: DataFrame, batch: str, stream: str = "") -> bool:
        """Index ``files`` anew and withdraw ``deleted(path)``."""
        return self.table.merge(deleted.select("path"), self._rows(files), batch, stream)

    def refresh(self, files: DataFrame, batch: str) -> bool:
        """Bring the index to a whole snapshot of the corpus."""
        held = self.table.read().select("path", "sha")
        same = F.col("sha").eqNullSafe(F.col("held_sha"))
        fresh = files.join(held.withColumnRenamed("sha", "held_sha").withColumn("known", F.lit(True)), "path", "left")
        changed = fresh.filter(F.col("known").isNull() | ~same).drop("held_sha", "known")
        gone = held.select("path").join(files.select("path"), "path", "left_anti")
        return self.update(changed, gone, batch)

    def symbols(self) -> DataFrame:
        """symbols(repo, path, language, symbol, kind, ord) of the latest version."""
        return (self.table.read().select("repo", "path", "language", F.posexplode("symbols").alias("ord", "s"))
                .select("repo", "path", "language", "s.symbol", "s.kind", F.col("ord").cast("int").alias("ord")))

    def follow(self, changes: DataFrame, checkpoint_dir: str, available_now: bool = True):
        """Start the stream; ``changes`` has the columns of ``files`` and
        ``deleted`` and ``seq``.  Returns the ``StreamingQuery``."""
        stream = checkpoint_dir.rstrip("/")

        def merge(batch: DataFrame, number: int) -> None:
            cols = [c for c in batch.columns if c not in ("seq", "path")]
            last = batch.groupBy("path").agg(F.max_by(F.struct(*cols), "seq").alias("l")).select("path", "l.*")
            last = last.persist()
            try:
                self.update(last.filter("not deleted"), last.filter("deleted"), str(number), stream)
            finally:
                last.unpersist()
        w = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
