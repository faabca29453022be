"""Composite corpus jobs.

``apply_all`` chains the rewrites the way the reference does: one index is
built first and frozen (quirk X13: later steps search renamed symbols under
their old names), every new corpus version is cut with a reliable checkpoint
(on a cluster: the shared ``spark.checkpoint.dir``) or committed as a step, and
the record tables are returned for the artifact writer.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import transforms as TR
from quarry.operators import validate as VA
from quarry.session import cut_lineage
from quarry.sources.commits import Steps


@dataclass
class Settings:
    """Transform settings (defaults of the reference's configuration)."""
    seed: int = 42
    rename_fraction: float = 0.05
    api_migrations: int = 10
    migrate_fraction: float = 0.6
    wrapper_layers: int = 8
    duplication_directories: int = 2
    max_dir_files: int = 100
    rename_mode: str = "parity"
    boundary: str = "unicode"


def build_index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, symbol_index)."""
    symbols = IX.extract_symbols(files)
    return symbols, IX.symbol_index_long(symbols)


def apply_all(files: DataFrame, settings: Settings | None = None, root: str | None = None) -> dict:
    """T1 -> T2 -> T3 -> T4 -> T5 -> T6, returning the final corpus, the
    four record tables, the validation table and the summary (A9).

    With ``root`` every step is a commit there: a run that died is started again
    with the same corpus and settings and goes on after its last step."""
    s = settings or Settings()
    if root is None:
        def step(name, make):
            return {k: cut_lineage(v) for k, v in make().items()}
    else:
        step = Steps(files.sparkSession, root, asdict(s)).run
    symbols = step("index", lambda: {"symbols": IX.extract_symbols(files)})["symbols"]            # frozen index (X13)

    def rename():
        r = TR.rename_symbols(files, symbols, p=s.rename_fraction, seed=s.seed, mode=s.rename_mode, boundary=s.boundary)
        return {"files": r.files, "rename_map": r.record.select("old", "new")}

    def migrate():
        r = TR.migrate_api(v1["files"], symbols, n=s.api_migrations, fraction=s.migrate_fraction, seed=s.seed)
        return {"files": r.files, "api_migrations": r.record.drop("rank"), "api_migration_files": r.details}

    def wrap():
        r = TR.add_wrappers(v2["files"], symbols, n=s.wrapper_layers, seed=s.seed)
        return {"files": r.files, "wrapper_layers": r.record.select("symbol", "original_file", "wrapper_file", "call_chain")}

    def duplicate():
        r = TR.duplicate_with_drift(v3["files"], k=s.duplication_directories, max_files=s.max_dir_files, seed=s.seed)
        return {"files": r.files, "duplication_map": TR.duplication_record(r).select("original_path", "duplicate_path", "modified_files")}
    v1 = step("rename", rename)
    v2 = step("migrate", migrate)
    v3 = step("wrap", wrap)
    v4 = step("duplicate", duplicate)
    records = {k: v for tables in (v1, v2, v3, v4) for k, v in tables.items() if k != "files"}
    return {"files": v4["files"], "symbols": symbols, "records": records, "validation": VA.validate_corpus(v4["files"]),
            "summary": transform_summary(records, s.seed)}


def transform_summary(records: dict, seed: int) -> DataFrame:
    """One row, the seed and the row count of each record table."""
    names = ["rename_map", "api_migrations", "wrapper_layers", "duplication_map"]  # one row per record
    counts = None
    for n in names:
        c = records[n].agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value")
        counts = c if counts is None else counts.unionByName(c)
    wide = counts.groupBy().pivot("metric", names).agg(F.first("value"))
    return wide.select(F.lit(seed).alias("seed"), F.col("rename_map").alias("renames"),
                       F.col("api_migrations"), F.col("wrapper_layers"), F.col("duplication_map").alias("duplications"))


def save_records(result: dict, out_dir: str) -> None:
    """The record tables as JSON folders plus the summary."""
    from quarry.sources.artifacts import write_table
    for name, df in result["records"].items():
        write_table(df, f"{out_dir}/{name}", fmt="json")
    write_table(result["summary"], f"{out_dir}/metadata", fmt="json")
