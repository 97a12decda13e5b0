"""Profiling runs: one discovery with a time limit, suites over data sets, and a command line.

    python -m lattica.experiment --dataset FILE --results-file PATH --algorithm levelwise --sampling-mode NO_SAMPLING \\
        --run-mode APPEND [--max-error 0.05] [--sample-param 200] [--timeout 120] [--seed 114514] [--max-lhs N]
"""

from __future__ import annotations

import argparse
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .plans.discover import Discovery, discover
from .sources.csv import datasets_by_width, read_csv
from .sources.results import ResultsTable, RunResult

#: Names as result rows carry them.
#: The strategies of the search, by the mode's name.
STRATEGY_OF = {"NO_SAMPLING": "none", "RANDOM": "random", "FOCUSED": "focused", "NEYMAN": "neyman"}
CONFIGS = {"NO_SAMPLING": "G3-No-Sampling", "RANDOM": "G3-Random-Sampling", "FOCUSED": "G3-Focused-Sampling", "NEYMAN": "G3-Neyman-Sampling"}
ALGORITHMS = {"levelwise": "levelwise", "tane": "levelwise", "bestfirst": "bestfirst", "pyro": "bestfirst"}
DEFAULTS = {"max_error": 0.05, "sample_param": 200.0, "seed": 114514, "timeout": 120.0}


class Timers:
    """Named wall-clock timers."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


class MemoryMonitor:
    """Watches the heap of the driver's JVM while a block runs: peak_mb, the last shares of the heap in use, and a call of
    alert(level, share) whenever that passes to "warning" or "critical"."""

    WARNING, CRITICAL, HISTORY = 0.70, 0.85, 10

    def __init__(self, spark: SparkSession, interval: float = 0.2, alert: Callable[[str, float], None] | None = None):
        self.runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        self.interval, self.alert = interval, alert
        self.peak_mb, self.level, self.history = 0, "normal", deque(maxlen=self.HISTORY)
        self._over = threading.Event()

    def look(self) -> None:
        used = self.runtime.totalMemory() - self.runtime.freeMemory()
        share = used / self.runtime.maxMemory()
        self.peak_mb = max(self.peak_mb, used >> 20)
        self.history.append(share)
        level = "critical" if share >= self.CRITICAL else "warning" if share >= self.WARNING else "normal"
        if level not in (self.level, "normal") and self.alert:
            self.alert(level, share)
        self.level = level

    def _watch(self) -> None:
        while not self._over.wait(self.interval):
            self.look()

    def __enter__(self) -> MemoryMonitor:
        self.look()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self.look()


class RunTimeout(Exception):
    pass


@contextmanager
def time_limit(spark: SparkSession, minutes: float):
    """Cancels the Spark jobs of the block when the time is over, and raises RunTimeout."""
    group, over = f"run-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop():
        over.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(minutes * 60, stop)
    timer.daemon = True
    sc.setJobGroup(group, "profiling run", interruptOnCancel=True)
    timer.start()
    try:
        yield
        if over.is_set():
            raise RunTimeout(f"over {minutes:g} minutes")
    except RunTimeout:
        raise
    except Exception as e:
        if over.is_set():
            raise RunTimeout(f"over {minutes:g} minutes") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def configured(algorithm: str, sampling: str) -> tuple[str, str, str | None]:
    """The search, the sampling mode that holds, and a warning if it differs from the one asked for."""
    if algorithm.lower() not in ALGORITHMS:
        raise ValueError(f"no algorithm named {algorithm}; there are {', '.join(ALGORITHMS)}")
    if sampling not in CONFIGS:
        raise ValueError(f"no sampling mode named {sampling}; there are {', '.join(CONFIGS)}")
    search = ALGORITHMS[algorithm.lower()]
    if search == "levelwise" and sampling != "NO_SAMPLING":
        return search, "NO_SAMPLING", "the levelwise search takes no sample; running with NO_SAMPLING"
    return search, sampling, None


def run_one(df: DataFrame, dataset: str, algorithm: str = "levelwise", sampling: str = "NO_SAMPLING", results: ResultsTable | None = None, max_error: float = 0.05, sample_param: float = 200, seed: int = 114514, timeout: float = 120, max_lhs: int | None = None, measure: str = "g3") -> tuple[RunResult, Discovery | None]:
    """One discovery; a failure or timeout is a row of the results, too."""
    search, sampling, warning = configured(algorithm, sampling)
    row = RunResult(dataset, CONFIGS[sampling], search, columns=len(df.columns), stats=warning or "N/A")
    found = None
    memory = MemoryMonitor(df.sparkSession)
    try:
        with memory, time_limit(df.sparkSession, timeout):
            found = discover(df, max_error, measure, max_lhs, search=search, cast_all_string=True, sampling=STRATEGY_OF[sampling], sample_param=sample_param, seed=seed)
        row.rows, row.fd_count, row.validations, row.execution_ms = found.total_rows, len(found.rows), found.validations, int(found.seconds * 1000)
        row.stats = " | ".join(filter(None, [warning, *(", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in x.items()) for x in found.levels)])) or "N/A"
    except RunTimeout as e:
        row.status, row.message = "TIMEOUT", str(e)
    except Exception as e:  # noqa: BLE001  a suite goes on with the next run
        row.status, row.message = "FAILURE", f"{type(e).__name__}: {str(e)[:300]}"
    row.memory_mb = memory.peak_mb
    if results:
        results.write(row)
    return row, found


def plan_suite(datasets: Sequence[str], algorithms: Sequence[str] = ("bestfirst", "levelwise")) -> list[tuple[str, str, str]]:
    """For each data set every sampling mode of the best-first search, then the levelwise one."""
    return [(d, a, s) for d in datasets for a in algorithms for s in (CONFIGS if ALGORITHMS[a.lower()] == "bestfirst" else ("NO_SAMPLING",))]


def run_suite(spark: SparkSession, folder_or_files: str | Sequence[str], results: ResultsTable, skip_done: bool = True, dry_run: bool = False, **options) -> list[RunResult]:
    """All runs of a plan, narrowest data set first; those with a successful row are skipped."""
    files = [p for p, _ in datasets_by_width(spark, folder_or_files)] if isinstance(folder_or_files, str) else list(folder_or_files)
    out = []
    for path, algorithm, sampling in plan_suite(files):
        search, mode, _ = configured(algorithm, sampling)
        if dry_run:
            out.append(RunResult(path, CONFIGS[mode], search, "PLANNED"))
        elif not (skip_done and results.has(path, CONFIGS[mode], search)):
            out.append(run_one(read_csv(spark, path), path, algorithm, sampling, results, **options)[0])
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica.experiment", description="Discover approximate functional dependencies of a delimited file.")
    p.add_argument("--dataset", required=True)
    p.add_argument("--results-file", required=True)
    p.add_argument("--algorithm", required=True, type=str.lower, choices=sorted(ALGORITHMS))
    p.add_argument("--sampling-mode", required=True, choices=list(CONFIGS))
    p.add_argument("--run-mode", required=True, choices=["APPEND", "OVERWRITE"])
    p.add_argument("--max-error", type=float, default=DEFAULTS["max_error"])
    p.add_argument("--sample-param", type=float, default=DEFAULTS["sample_param"])
    p.add_argument("--timeout", type=float, default=DEFAULTS["timeout"], help="minutes")
    p.add_argument("--seed", type=int, default=DEFAULTS["seed"])
    p.add_argument("--max-lhs", type=int)
    p.add_argument("--measure", default="g3", choices=["g3", "g1"])
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--use-dynamic-threshold", action="store_true", help="accepted for older scripts; has no effect")
    p.add_argument("--verbose", action="store_true")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    timers = Timers()
    with timers.timed("load"):
        df = read_csv(spark, a.dataset, header=not a.no_header)
    with timers.timed("run"):
        row, found = run_one(df, a.dataset, a.algorithm, a.sampling_mode, ResultsTable(spark, a.results_file, a.run_mode), a.max_error, a.sample_param, a.seed, a.timeout, a.max_lhs, a.measure)
    for text in (row.message, row.stats if "levelwise search" in row.stats else ""):
        if text:
            print(text)
    if found:
        print("\n".join(found.show()))
    if a.verbose:
        print({**timers.seconds, "validations": row.validations})
    return int(row.status != "SUCCESS")


if __name__ == "__main__":
    raise SystemExit(main())
