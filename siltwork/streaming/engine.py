"""One plan for batch and stream: parse, transform, route, with side outputs and rescue."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.operators.dispatch import Dispatched, dispatch
from siltwork.operators.routing import Group, choose_model, error_records, fan_out, non_empty, route
from siltwork.plans.model import Compiler, Model, parse_model
from siltwork.plans.rules import Rule, parse_rules, split_rules
from siltwork.plans.text import SyntaxProblem
from siltwork.sources.files import read_rescue, recovered, write_rescue
from siltwork.sources.sinks import blackhole, write_file

Writer = Callable[[str, DataFrame], None]


@dataclass
class Engine:
    """Rules, models and sink groups.

    ``mode``: ``debug`` raises on a bad rule or model; ``normal`` and ``stoic`` skip that one, note it
    in ``problems`` and go on with the rest, ``stoic`` also where no rule is left.  A sink is tried
    ``retries`` times more before its records go to the rescue folder; ``debug`` raises instead.
    """

    rules: str
    models: tuple[str, ...] = ()
    groups: list[Group] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    mode: str = "normal"
    skip_parse: bool = False
    skip_sink: bool = False
    retries: int = 1

    def __post_init__(self):
        self.problems: list[str] = []
        found = [self._load(lambda t=t, p=p: parse_rules(t, p)) for p, t in split_rules(self.rules)]
        self.parsed: list[Rule] = [rule for rules in found if rules for rule in rules]
        if not self.parsed and self.rules.strip() and self.mode == "normal":
            self.problems.append("no rule is left: every text is a miss")
        loaded = [self._load(lambda t=t: parse_model(t)) for t in self.models]
        self.loaded: dict[str, Model] = {m.name: m for m in loaded if m is not None and m.enabled}

    def _load(self, make):
        try:
            return make()
        except SyntaxProblem as problem:
            if self.mode == "debug":
                raise
            self.problems.append(str(problem))
            return None

    def run(self, events: DataFrame) -> dict[str, DataFrame]:
        """Sink name to records: business sinks as ``group/sink``, and miss, residue, error and default."""
        return {} if self.skip_parse else self._outputs(dispatch(events, self.parsed))

    def _outputs(self, parsed: Dispatched) -> dict[str, DataFrame]:
        out = {"miss": parsed.misses(), "residue": parsed.residue()}
        if self.skip_sink:
            return out
        models = {n: m.rules for n, m in self.loaded.items()}
        by_name = {g.name: g for g in self.groups}
        for rule in self.parsed:
            records = parsed.records(rule.key, self.tables)
            kinds = parsed.kinds[rule.key]
            name = choose_model(rule.key, models)
            group = by_name.get(route(rule.key, self.groups, models))
            if name is not None:
                fields = len(kinds)
                made = Compiler(self.loaded[name], self.tables).apply(records, kinds)
                wrong = error_records(made, rule=rule.key, group=group.name if group else "default", model=name, source_fields=fields)
                out["error"] = out["error"].unionByName(wrong) if "error" in out else wrong
                records = non_empty(made)
                kinds = {k: v for k, v in kinds.items() if k in records.columns}
            if group is None:
                out[f"default/{rule.key}"] = records
                continue
            for sink, rows in fan_out(records, group, kinds=kinds).items():
                key = f"{group.name}/{sink}"
                out[key] = out[key].unionByName(rows, allowMissingColumns=True) if key in out else rows
        return out

    def deliver(self, events: DataFrame, write: Writer, rescue: str | None = None) -> list[str]:
        """Write every output from one parse of the events, which are kept dispatched meanwhile.

        A sink that fails and keeps failing has all its records put into the rescue folder; what it
        took before it failed is then delivered twice (at least once).  Gives the failed sinks.
        """
        if self.skip_parse:
            return []
        parsed = dispatch(events, self.parsed)
        kept = parsed.all.persist(StorageLevel.MEMORY_AND_DISK)
        failed = []
        try:
            for name, rows in self._outputs(replace(parsed, all=kept)).items():
                for attempt in range(self.retries + 1):
                    try:
                        write(name, rows)
                        break
                    except Exception:
                        if rescue is None or self.mode == "debug":
                            raise
                        if attempt == self.retries:
                            write_rescue(rows, rescue, name.replace("/", "__"))
                            failed.append(name)
        finally:
            kept.unpersist()
        return failed

    def recover(self, spark: SparkSession, rescue: str, sink: str, write: Writer, schema: str, *, checkpoint: str, lines_a_round: int | None = None) -> int:
        """Send rescued records of a sink on to it, newest file first; gives their number.

        Files that were sent are named in the checkpoint folder and not sent again; a round ends
        after the file that reaches ``lines_a_round``.
        """
        files = read_rescue(spark, rescue, sink.replace("/", "__"), schema)
        done = recovered(spark, checkpoint)
        open_files = files.join(done, "file", "left_anti").groupBy("file").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy(F.desc("at"), F.desc("file")).rowsBetween(Window.unboundedPreceding, -1))
        some = open_files.withColumn("before", F.coalesce(before, F.lit(0)))
        if lines_a_round is not None:
            some = some.where(F.col("before") < lines_a_round)
        some = some.select("file", "n").collect()  # names of files of one round
        if not some:
            return 0
        names = spark.createDataFrame([(r.file,) for r in some], "file string")
        write(sink, files.join(F.broadcast(names), "file", "left_semi").select("record.*"))
        names.coalesce(1).write.mode("append").text(checkpoint)
        return sum(r.n for r in some)

    def stream(self, events: DataFrame, write: Writer, checkpoint: str, rescue: str | None = None, **trigger):
        """The same plan over each micro-batch, which is parsed once for all sinks."""

        def batch(rows: DataFrame, number: int) -> None:
            if "event_id" in rows.columns:
                rows = rows.withColumn("event_id", F.xxhash64("event_id", F.lit(number), F.monotonically_increasing_id()))
            self.deliver(rows, write, rescue)

        query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def reload(engine: Engine, query, events: DataFrame, write: Writer, checkpoint: str, rescue: str | None = None, *, wait: float = 60.0, trigger: dict | None = None, **changes):
    """(engine, query) with other rules, models or groups on the same checkpoint.

    The new engine is made first, so that a mistake in debug mode leaves the old query running; then
    the batch in progress ends, at most ``wait`` seconds on, and the new query goes on where it stopped.
    """
    made = replace(engine, **changes)
    until = time.monotonic() + wait
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()
    return made, made.stream(events, write, checkpoint, rescue, **(trigger or {}))


def file_writer(folder: str, fmt: str = "json", groups: tuple[Group, ...] | list[Group] = ()) -> Writer:
    """Files of each sink under its name, in the format that its group gives it, or in ``fmt``."""
    formats = {f"{g.name}/{s.name}": s.fmt for g in groups for s in g.sinks}
    return lambda name, rows: write_file(rows, f"{folder}/{name}", formats.get(name, fmt))


def blackhole_writer(_: str, rows: DataFrame) -> None:
    blackhole(rows)


def windowed_counts(stream: DataFrame, ts: str, dims: tuple[str, ...], *, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and dimensions, rows later than the watermark left out."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *dims).agg(F.count(F.lit(1)).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *dims, "total")
