"""Runs queries over datasets and keeps a row of results for each: plan expansion, failure rows, resuming, paired estimates, lane sweeps.

    python -m loomcert.runner [base|certify|commit|paired|sweep] results.csv [query[:dataset] ...]

base times a query, certify its reduced join tree with all checks, commit the fingerprints of customer's columns; paired times base and certify in
alternating order, and sweep plans lanes over several privacy budgets. LOOMCERT_DATA names the folders of datasets, as name=folder pairs.
"""

from __future__ import annotations

import csv
import os
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from statistics import mean, median

from pyspark.sql import DataFrame, SparkSession

TABULAR = ("q3", "q5", "q8", "q9", "q18")
GRAPH = ("gq1", "gq2", "gq3", "gq4")
MODES = ("base", "certify", "commit", "paired", "sweep")
DEFAULT = "tpch=/root/testdata/sf0.01,events=/root/testdata/sf0.01"


@dataclass
class Row:
    query: str
    dataset: str
    mode: str = ""
    rows: int = 0
    scans: int = 0
    shuffles: int = 0
    run_s: float = 0.0
    certify_s: float = 0.0
    commit_s: float = 0.0
    difference_s: float = 0.0
    floor_s: float = 0.0
    lanes: int = 0
    wall_s: float = 0.0
    holds: str = ""
    status: str = ""


HEADER = [f.name for f in fields(Row)]


def datasets(spec: str | None = None) -> dict[str, str]:
    return dict(x.split("=", 1) for x in (spec or os.environ.get("LOOMCERT_DATA") or DEFAULT).split(","))


def plan(specs: list[str], known: dict[str, str]) -> list[tuple[str, str]]:
    """(query, dataset) of specs query[:dataset], each once: without a dataset, tabular queries run on the first and pattern queries on all others.

    Unknown queries and datasets are refused before anything runs.
    """
    out: list[tuple[str, str]] = []
    names = list(known)
    for spec in specs or [*TABULAR, *GRAPH]:
        q, _, d = spec.partition(":")
        if q not in TABULAR + GRAPH or (d and d not in known):
            raise ValueError(f"unknown query or dataset: {spec}")
        for x in [d] if d else names[:1] if q in TABULAR else names[1:] or names:
            if (q, x) not in out:
                out.append((q, x))
    return out


def finished(path: str) -> dict[tuple[str, str, str], dict]:
    """The result rows of a file by query, dataset and mode; failed ones are left out, so that they run again."""
    if not Path(path).exists():
        return {}
    with open(path, newline="") as f:
        return {(r["query"], r["dataset"], r["mode"]): r for r in csv.DictReader(f) if not r["status"].startswith("FAILED")}


def counted_plan(df: DataFrame) -> tuple[int, int]:
    """Table scans and shuffles of the initial plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan"), text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning") + text.count("Exchange SinglePartition")


def timed(run: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def estimate(runs: list[tuple[float, float]]) -> tuple[float, float | None]:
    """(difference, floor) of pairs (base, bound), of which even ones took the base first: the mean of both orders' means, and the larger of half
    their gap and half the spread; with one order only the median, and no floor."""
    d = [b - a for a, b in runs]
    even, odd = d[::2], d[1::2]
    if not odd:
        return median(d), None
    return (mean(even) + mean(odd)) / 2, max(abs(mean(even) - mean(odd)) / 2, (max(d) - min(d)) / 2)


def paired(base: Callable[[], float], bound: Callable[[], float], repeats: int = 4) -> list[tuple[float, float]]:
    """Measures both as often, the base first on even repetitions and last on odd ones."""
    out = []
    for k in range(repeats):
        if k % 2 == 0:
            a = base()
            out.append((a, bound()))
        else:
            b = bound()
            out.append((base(), b))
    return out


def _certified(spark: SparkSession, root: str, query: str) -> DataFrame:
    from .operators.certify import TREES
    from .plans import jointree as J
    from .sources.tables import table

    tree = TREES[query](lambda t: table(spark, root, t))
    return J.verdict(tree, J.reduce_tree(tree))


def run_one(spark: SparkSession, query: str, dataset: str, root: str, mode: str) -> list[Row]:
    """The result rows of one job; a failure is a row whose status says so, and doesn't stop the others."""
    from .operators import core_queries

    began, row = time.perf_counter(), Row(query, dataset, mode, status="OK")
    try:
        queries = core_queries()[0]
        run = lambda: queries[query](spark, root)
        certified = lambda: _certified(spark, root, query)
        if mode in ("base", "certify", "commit"):
            df = run()
            row.scans, row.shuffles = counted_plan(df)
            row.rows = df.count()
            row.run_s = timed(run)
        if mode == "certify":
            first = time.perf_counter()
            got = certified().first()
            row.certify_s, row.holds = time.perf_counter() - first, ";".join(f"{k}={v}" for k, v in got.asDict().items())
            if min(got) == 0:
                row.status = "FAILED: a check does not hold"
        elif mode == "commit":
            row.commit_s = timed(lambda: queries["column_fingerprint"](spark, root))
        elif mode == "paired":
            run(), certified()
            row.difference_s, floor = estimate(paired(lambda: timed(run), lambda: timed(certified)))
            row.floor_s = -1.0 if floor is None else floor
        elif mode == "sweep":
            return sweep(spark, query, dataset, root)
    except Exception as error:  # noqa: BLE001
        row.status = "FAILED: " + (str(error).splitlines() or ["no message"])[0].replace(",", ";")[:200]
    row.wall_s = time.perf_counter() - began
    return [row]


def sweep(spark: SparkSession, query: str, dataset: str, root: str, length: int = 1 << 16) -> list[Row]:
    """A row for each budget: the lanes that the released capacity takes; over the limit the row is SKIPPED, not cut."""
    from .operators.bags import MAX_LANES
    from .operators import core_queries

    out = []
    if query not in MAX_LANES:
        return [Row(query, dataset, "sweep", status="SKIPPED: no lanes")]
    for r in core_queries()[0]["dp_sweep"](spark, root).where("bag = 'bag1'").orderBy("epsilon").collect():
        lanes = max(1, -(-r.capacity // length))
        out.append(Row(query, f"{dataset}@{r.epsilon}", "sweep", rows=r.capacity, lanes=lanes, status="OK" if lanes <= MAX_LANES[query] else "SKIPPED: too many lanes"))
    return out


def run_all(spark: SparkSession, mode: str, path: str, specs: list[str], known: dict[str, str]) -> list[Row]:
    """Runs the jobs that have no good row in the file yet and writes the file anew after each; good rows of before stay."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}: {MODES}")
    jobs, before = plan(specs, known), finished(path)
    kept, out = list(before.values()), []
    for q, d in jobs:
        if any((a, b.split("@")[0], m) == (q, d, mode) for a, b, m in before):
            continue
        out += run_one(spark, q, d, known[d], mode)
        with open(path, "w", newline="") as f:
            w = csv.DictWriter(f, HEADER)
            w.writeheader()
            w.writerows(kept + [asdict(r) for r in out])
    return out


def main(args: list[str]) -> None:
    from .session import session

    if len(args) < 2 or args[0] not in MODES:
        sys.exit(__doc__)
    for row in run_all(session("runner"), args[0], args[1], args[2:], datasets()):
        print(",".join(str(v) for v in asdict(row).values()))


if __name__ == "__main__":
    main(sys.argv[1:])
