"""One check run: results, alert outbox and report from a single evaluation.

The results are small (one row per spec) but expensive (they scan the sources),
and both the outbox and the report read them. They are therefore written once
as a reliable checkpoint in the shared ``spark.checkpoint.dir`` folder: the
scans run once, and a lost executor re-reads the checkpoint instead of
re-running the scans.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigil.plans.alerts import route_alerts
from vigil.plans.backends import get_preset
from vigil.plans.evaluate import check_all
from vigil.plans.isolate import isolated
from vigil.plans.registry import get_check
from vigil.plans.report import run_report
from vigil.plans.specs import config_frames
from vigil.schema import MEASURES
from vigil.session import ensure_checkpoint_dir
from vigil.sources.sinks import write_outbox


@dataclass
class Run:
    results: DataFrame
    outbox: DataFrame
    report: DataFrame


def run_checks(specs: DataFrame, measures, channels, as_of=None, defaults=None, alert_on_healthy: bool = False,
               outbox_path: str | None = None) -> Run:
    """E2 + A1-A17 + E4: evaluate every spec once, route alerts, summarise.
    ``outbox_path`` names the folder of this run's outbox (one folder per run)."""
    results = check_all(specs, measures, as_of=as_of, defaults=defaults)
    ensure_checkpoint_dir(results.sparkSession)
    results = results.checkpoint(eager=True)
    outbox = route_alerts(results, channels, alert_on_healthy=alert_on_healthy)
    if outbox_path is not None:
        # The folder holds this run's outbox: overwriting makes a re-run (after a
        # failure) rewrite the same sends instead of adding duplicates.
        write_outbox(outbox, outbox_path, mode="overwrite")
        outbox = results.sparkSession.read.schema(outbox.schema).json(outbox_path)
    return Run(results=results, outbox=outbox, report=run_report(results, outbox))


def run_config(spark: SparkSession, config: Mapping, sources: Mapping[str, Mapping], as_of=None,
               required: Iterable[str] = (), outbox_path: str | None = None) -> Run:
    """A whole run from a parsed config: its checks by name (a backend's name stands for its
    preset), each measured once for all its pipelines with the arguments ``sources[check]`` (or
    ``sources[backend]``), bound to the specs' settings, evaluated and routed. SQL checks need no source: each
    pipeline's ``query`` setting runs over the session's tables. A check that is not registered, or has no
    source, is an error; a source that can't be read, at planning or at run time, makes its own
    pipelines unknown, as do required settings that are not set."""
    from vigil.operators import bind, sql_scalar
    cfg = config_frames(spark, config)
    if not config.get("pipelines"):
        raise ValueError("the config has no pipelines")
    preset = get_preset(config.get("backend"))
    by_name = {k.lower(): v for k, v in sources.items()}
    names = sorted({p.get("check") or (preset.check if preset else config.get("backend")) for p in config["pipelines"]})
    given = {name: by_name.get(name.lower(), by_name.get(config["backend"].lower()) if preset and name == preset.check else None) for name in names}
    checks = {name: get_check(name) for name in names}
    queries = {}
    if "sql_scalar" in checks and given["sql_scalar"] is None:
        del checks["sql_scalar"]
        queries = {r["pipeline"]: r["query"] for r in cfg.specs.where("check = 'sql_scalar'").select(
            "pipeline", cfg.specs["params"].getItem("query").alias("query")).collect() if r["query"]}
    if lacking := [name for name in checks if given[name] is None]:
        raise KeyError(f"no source given for {', '.join(lacking)}")
    needed = set(required)

    def of_check(name):
        return cfg.specs.where(cfg.specs["check"] == name)

    def one(name, measure):
        return lambda: bind(of_check(name), measure(**given[name]), required=needed & {name})
    measures = isolated(cfg.specs, {name: one(name, measure) for name, measure in checks.items()})
    if "sql_scalar" in names and "sql_scalar" not in checks:
        specs = of_check("sql_scalar")
        for pipeline, sql in queries.items():  # each pipeline has a query, and so a source, of its own
            own = specs.where(specs["pipeline"] == pipeline)
            measures = measures.unionByName(isolated(own, {"sql_scalar": lambda p=pipeline, q=sql: sql_scalar(spark, q, p)}))
        unset = specs.where(~specs["pipeline"].isin(list(queries))) if queries else specs
        measures = measures.unionByName(bind(unset, spark.createDataFrame([], MEASURES), settings={"sql_scalar": "query"}, required=["sql_scalar"]))
    return run_checks(cfg.specs, measures, cfg.channels, as_of=as_of, defaults=cfg.defaults,
                      alert_on_healthy=bool(config.get("alert_on_healthy")), outbox_path=outbox_path)
