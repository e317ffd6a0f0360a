"""Tables and shared intermediate frames of the test data, wired to the operators.

Intermediate marts that many queries read (order lines, the policy panel) are written once per
session to the shared folder, the way a warehouse run materializes its marts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.functions.durable import slices, stored
from tallyfield.operators import warehouse
from tallyfield.sources import transactions

# fixed values: dates suited to the test tables (orders run from 1995-01-01 to 2001-08-01)
CUTOFFS = ("1999-06-01", "2000-01-01", "2000-06-01")
HOLDOUT_END = "2001-08-01"
T0 = "2000-06-01"  # a Thursday: the week it falls in still counts as before the policy
EARLY_T0 = "1996-01-01"  # early enough that many customers start after it
HOME_COUNTRY = "NATION_0"

_MARTS: dict[tuple, DataFrame] = {}


def code_version() -> str:
    """Digest of the library's sources: the version a record carries."""
    digest = hashlib.sha1()
    root = Path(__file__).resolve().parent.parent
    for part in ("functions", "operators", "plans", "sources"):
        for source in sorted((root / part).glob("*.py")):
            digest.update(source.read_bytes())
    return digest.hexdigest()[:12]


def input_version(spark: SparkSession, sf_dir: str) -> int:
    """Changes when a file of the folder does: names, sizes and times as the storage itself lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))


def mart(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """Build once per (application, state of the data folder), kept as Parquet in the shared folder.

    write: False where the frame reads a table that its building has stored already.
    """
    key = (spark.sparkContext.applicationId, sf_dir, input_version(spark, sf_dir), name)
    if key not in _MARTS:
        _MARTS[key] = stored(build(), name) if write else build()
    return _MARTS[key]


@dataclass(frozen=True)
class Frames:
    spark: SparkSession
    sf_dir: str

    def raw(self, description: bool = True, country: bool = True) -> DataFrame:
        return transactions.adapt_orders(self.spark, self.sf_dir, description, country)

    def stg(self) -> DataFrame:
        """Staged lines as a columnar table: the joins of the adapter run once, readers prune to their columns.

        They run for one slice of the orders after the other, so the disk does not hold the joins of a whole large table.
        """
        def build():
            n = slices(transactions.table(self.spark, self.sf_dir, "lineitem").count())
            first, *more = [warehouse.stg_orders(transactions.adapt_orders(self.spark, self.sf_dir, slice_of=(k, n))) for k in range(n)]
            return stored(first, "stg", *more)

        return mart(self.spark, self.sf_dir, "stg", build, write=False)

    def lines(self) -> DataFrame:
        """Non-return lines with only what order-level work needs."""
        return warehouse.order_lines(self.stg()).select("customer_id", "invoice_no", "invoice_date", "line_total")

    def int_orders(self) -> DataFrame:
        return mart(self.spark, self.sf_dir, "int_orders",
                    lambda: warehouse.int_orders(self.stg()), write=False)

    def dim_customers(self, lines: DataFrame | None = None) -> DataFrame:
        """Written once, like the other marts: checks, reports and reconciliations read it.

        lines: the staged lines from a table that keeps an invoice's lines together, where one is written already.
        """
        return mart(self.spark, self.sf_dir, "dim_customers", lambda: warehouse.dim_customers(self.stg() if lines is None else lines))
