"""The store of runs: their parameters and metrics, curves and trades, kept by experiment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.bucketed import Bucketed

RUNS = "run_id bigint, sweep_id string, name string, params string, metrics string, created_at timestamp"
EQUITY = "run_id bigint, date date, equity double, benchmark double, drawdown double, invested_pct double, positions int, flow double"
TRADES = "run_id bigint, symbol_id int, symbol string, industry string, signal_date date, entry_date date, entry_price double, exit_date date, exit_price double, qty double, pnl double, pnl_pct double, weeks_held int, exit_reason string, entry_score double"


@dataclass
class Result:
    """What one experiment made, in the columns above."""

    runs: DataFrame
    equity: DataFrame
    trades: DataFrame


class RunStore:
    """Three tables bucketed by run; an experiment's rows are replaced together, its runs last.  A run's id is its own in all experiments."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        table = lambda name, columns: Bucketed(spark, f"{root}/{name}", columns, "run_id", "experiment", buckets)
        self._runs, self._equity, self._trades = table("runs", RUNS), table("equity", EQUITY), table("trades", TRADES)

    def save(self, experiment: str, result: Result) -> None:
        """Put an experiment's rows in place of those it had; a reader goes by runs, which are written when their curves and trades are there."""
        self._trades.replace(result.trades, experiment)
        self._equity.replace(result.equity, experiment)
        self._runs.replace(result.runs, experiment)

    def load(self, experiment: str | None = None) -> Result:
        """All runs, or those of an experiment; curves and trades are read by the partition."""
        one = lambda df: df if experiment is None else df.where(F.col("experiment") == experiment)
        return Result(*(one(t.rows()) for t in (self._runs, self._equity, self._trades)))

    def sweep(self, sweep_id: str) -> Result:
        """The runs of a sweep with their curves and trades, found by joins that shuffle nothing."""
        every = self.load()
        runs = every.runs.where(F.col("sweep_id") == sweep_id)
        own = lambda df: df.join(runs.select("run_id").hint("merge"), "run_id", "left_semi")
        return Result(runs, own(every.equity), own(every.trades))

    def overview(self) -> DataFrame:
        """``run_id, experiment, name, sweep_id, final_equity, worst_drawdown, trades, pnl`` of every run."""
        every = self.load()
        curve = every.equity.groupBy("run_id").agg(F.max_by("equity", "date").alias("final_equity"), F.min("drawdown").alias("worst_drawdown"))
        sold = every.trades.groupBy("run_id").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"))
        joined = every.runs.join(curve.hint("merge"), "run_id", "left").join(sold.hint("merge"), "run_id", "left")
        return joined.select("run_id", "experiment", "name", "sweep_id", "final_equity", "worst_drawdown", F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
