"""Running one workflow for many sets of arguments, with logs of each run and a report.

Data parallelism is Spark's; runs are only queued side by side from a few driver threads, so that small runs fill the
cluster. A failed run doesn't stop the others.
"""

from __future__ import annotations

import html
import logging
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.workflow import Node, Results, Workflow

STATS_DDL = "run string, node string, start timestamp, end timestamp, seconds double, failed boolean, origin string, message string"
PAGE = Template("""<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Report</title></head><body>
<h1>Execution report</h1><p>$finished of $total runs finished between $start and $end.</p>
<h2>Workflow</h2><pre>$dot</pre>
<h2>Nodes</h2><table border="1"><tr><th>node</th><th>runs</th><th>least s</th><th>most s</th><th>mean s</th><th>deviation s</th></tr>$nodes</table>
<h2>Errors</h2><table border="1"><tr><th>node</th><th>kind</th><th>runs</th></tr>$errors</table>
<h2>Runs</h2><ul>$runs</ul></body></html>
""")


class OwnThread(logging.Filter):
    """Lets records of one thread pass."""

    def __init__(self):
        super().__init__()
        self.thread = threading.get_ident()

    def filter(self, record: logging.LogRecord) -> bool:
        return record.thread == self.thread


class Executor:
    def __init__(self, workflow: Workflow, arguments: Sequence[dict[Node, dict]], names: Sequence[str] | None = None, logs: str | None = None, log_filter: logging.Filter | None = None, handler: Callable[[str], logging.Handler] = logging.FileHandler, action: Callable[[Results], object] | None = None):
        """action: what to do with a run's outputs (a write, say); without it only plans are made."""
        self.workflow, self.arguments = workflow, list(arguments)
        self.names = [str(k + 1) for k in range(len(self.arguments))] if names is None else list(names)
        if len(self.names) != len(self.arguments) or len(set(self.names)) < len(self.names):
            raise ValueError("every run needs a name of its own")
        self.logs, self.log_filter, self.handler, self.action = logs, log_filter, handler, action
        self.results: list[Results] = []

    def log_paths(self) -> list[str]:
        return [f"{self.logs}/run-{n}.log" for n in self.names]

    def run(self, workers: int = 1) -> list[Results]:
        if self.logs:
            Path(self.logs).mkdir(parents=True, exist_ok=True)
        with ThreadPoolExecutor(workers) as pool:
            self.results = list(pool.map(self._one, range(len(self.arguments))))
        return self.results

    def _one(self, k: int) -> Results:
        log = self.handler(self.log_paths()[k]) if self.logs else None
        root = logging.getLogger()
        if log:
            log.addFilter(OwnThread())
            if self.log_filter:
                log.addFilter(self.log_filter)
            root.addHandler(log)
        try:
            logging.getLogger(__name__).warning("run %s started", self.names[k])
            result = self.workflow.execute(self.arguments[k], raise_errors=False)
            if self.action and not result.failed:
                try:
                    self.action(result)
                except Exception as e:
                    result.failed_node = "action"
                    logging.getLogger(__name__).exception("the action of run %s failed: %s", self.names[k], e)
            return result.without_outputs()
        finally:
            if log:
                root.removeHandler(log)
                log.close()

    def succeeded(self) -> list[int]:
        return [k for k, r in enumerate(self.results) if not r.failed]

    def failed(self) -> list[int]:
        return [k for k, r in enumerate(self.results) if r.failed]

    def read_logs(self) -> list[str | None]:
        return [Path(p).read_text() if Path(p).exists() else None for p in self.log_paths()] if self.logs else [None] * len(self.names)

    def stats(self, spark: SparkSession) -> DataFrame:
        """A row for each node of each run."""
        rows = []
        for name, r in zip(self.names, self.results, strict=True):
            for s in r.stats.values():
                rows.append((name, s.name, s.start, s.end, (s.end - s.start).total_seconds(), s.error is not None, s.origin, s.error))
        return spark.createDataFrame(rows, STATS_DDL)

    def report(self, spark: SparkSession, path: str) -> str:
        stats = self.stats(spark)
        nodes = "".join(f"<tr><td>{html.escape(r[0])}</td>" + "".join(f"<td>{v:.3g}</td>" for v in r[1:]) + "</tr>" for r in durations(stats).orderBy("node").collect())
        errors = "".join(f"<tr><td>{html.escape(r.node)}</td><td>{html.escape(r.origin)}</td><td>{html.escape(', '.join(r.runs))}</td></tr>" for r in grouped_errors(stats).collect())
        runs = "".join(f"<li>{html.escape(n)}: {'failed at ' + html.escape(r.failed_node) if r.failed else 'finished'}</li>" for n, r in zip(self.names, self.results, strict=True))
        times = [r.start for r in self.results if r.start] + [r.end for r in self.results if r.end] or [datetime.now()]
        text = PAGE.substitute(finished=len(self.succeeded()), total=len(self.names), start=min(times), end=max(times), dot=html.escape(self.workflow.dot()), nodes=nodes, errors=errors, runs=runs)
        Path(path).write_text(text)
        return path


def durations(stats: DataFrame, node: str = "node", seconds: str = "seconds") -> DataFrame:
    """node, n, and the least, greatest, mean and (population) deviation of its seconds."""
    s = F.col(seconds)
    return stats.groupBy(node).agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"))


def grouped_errors(stats: DataFrame) -> DataFrame:
    """node, origin, runs of the failures, most frequent first."""
    groups = stats.where("failed").groupBy("node", "origin").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return groups.orderBy(F.size("runs").desc(), "node", "origin")


def run_counts(runs: DataFrame, failed: str = "failed") -> DataFrame:
    return runs.agg(F.count_if(~F.col(failed)).alias("finished"), F.count_if(failed).alias("failed"))


def confusion(pairs: DataFrame, truth: str, predicted: str, normalize: bool = True) -> DataFrame:
    """truth, predicted, value: counts of each pair, or their share of the truth's row."""
    from pyspark.sql.window import Window

    counts = pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    if not normalize:
        return counts.withColumnRenamed("n", "value")
    return counts.select(truth, predicted, (F.col("n") / F.sum("n").over(Window.partitionBy(truth))).alias("value"))
