"""First-match dispatch of raw events over parse rules: hits, partial hits, residue and misses.

Each rule becomes a struct column in one scan; nothing is shuffled or scanned twice.  Rules keep their
declared order, so results do not depend on what came before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.plans.rules import Rule, enrichments, matched, parse_rules, typed_fields

PARTIAL_SHARE = 0.2


@dataclass
class Dispatched:
    """``all``: one row per event with rule_key, outcome (hit, partial, miss, blank), best_rule, residue and a struct per rule."""

    all: DataFrame
    rules: list[Rule]
    kinds: dict[str, dict[str, str]]

    def column(self, key: str) -> str:
        return f"r{[r.key for r in self.rules].index(key)}"

    def records(self, key: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Parsed fields of a rule's hits and partial hits, with the events' other columns.

        A sub-field that asks for an enrichment, ``@ip +geo(city)``, is looked up in the key column
        of the table of that name, and ``city`` is added; without the table it is NULL.
        """
        name = self.column(key)
        hidden = {f"r{k}" for k in range(len(self.rules))} | {"outcome", "best_rule", "depth", "residue"}
        keep = [F.col(f"`{c}`") for c in self.all.columns if c not in hidden]
        fields = [f.name for f in self.all.schema[name].dataType.fields if f.name != "left"]
        rows = self.all.where((F.col("rule_key") == key) & F.col("outcome").isin("hit", "partial"))
        out = rows.select(*keep, *[F.col(name)[f].alias(f) for f in fields if f not in self.all.columns])
        for field, table, column in enrichments(next(r for r in self.rules if r.key == key)):
            if table in (tables or {}):
                known = tables[table].groupBy(F.col("key").cast("string").alias(f"__{column}")).agg(F.min(column).alias(column))
                out = out.join(known, F.col(f"`{field}`").cast("string") == F.col(f"__{column}"), "left").drop(f"__{column}")
            else:
                out = out.withColumn(column, F.lit(None).cast("string"))
        return out

    def residue(self) -> DataFrame:
        return self.all.where("outcome = 'partial'").select(F.concat(F.lit("wpl:"), "rule_key", F.lit(",residue:"), "residue").alias("residue"))

    def misses(self) -> DataFrame:
        return self.all.where("outcome = 'miss'").select("raw", "best_rule", "depth")


def dispatch(events: DataFrame, rules: list[Rule] | str, raw: str = "raw", partial_share: float = PARTIAL_SHARE) -> Dispatched:
    """Each rule's expression runs once, and only on texts that no earlier rule took; without rules every text is a miss.

    Of a miss, best_rule is the last rule that did not match, or one after it that matched but left
    too much and had parsed further than all before; depth is the most that was parsed, at least 1.
    """
    rules = parse_rules(rules) if isinstance(rules, str) else rules
    text, size = F.col(raw), F.octet_length(raw)
    out, kinds = events, {}
    open_yet, best, depth = F.lit(True), F.lit(None).cast("string"), F.lit(0)
    keys, residue = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rule in enumerate(rules):
        out = out.withColumn(f"r{k}", F.when(open_yet, matched(rule, text)))
        record, found = typed_fields(rule, F.col(f"r{k}"))
        kinds[rule.key] = {n: f.kind for n, f in found.items()}
        out = out.withColumn(f"r{k}", record)
        left = F.col(f"r{k}.left")
        parsed = size - F.octet_length(left)
        fits = F.coalesce(F.octet_length(left) <= partial_share * size, F.lit(False))
        failed = F.col(f"r{k}").isNull()
        further = ~failed & (parsed > depth)
        state = {"fits": open_yet & fits, "best": F.when(failed | further, F.lit(rule.key)).otherwise(best), "depth": F.when(failed, F.greatest(depth, F.lit(1))).when(further, parsed).otherwise(depth)}
        out = out.withColumn(f"r{k}s", F.struct(*[c.alias(n) for n, c in state.items()]))
        s = F.col(f"r{k}s")
        open_yet, best, depth = open_yet & ~s["fits"], s["best"], s["depth"]
        keys, residue = F.when(s["fits"], F.lit(rule.key)).otherwise(keys), F.when(s["fits"], left).otherwise(residue)
    out = out.withColumns({"rule_key": keys, "residue": F.nullif(residue, F.lit(""))})
    hit = F.col("rule_key").isNotNull()
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    out = out.withColumns({
        "outcome": F.when(hit & F.col("residue").isNotNull(), "partial").when(hit, "hit").when(blank | text.isNull(), "blank").otherwise("miss"),
        "best_rule": F.when(~hit, best),
        "depth": F.when(~hit, depth.cast("int")),
    })
    # a generator of one row: filters on what was parsed stay above it, so that no expression runs twice; others go below
    found = [F.col(n).alias(n) for n in (*[f"r{k}" for k in range(len(rules))], "rule_key", "residue", "outcome", "best_rule", "depth")]
    return Dispatched(out.select(*[F.col(f"`{c}`") for c in events.columns], F.inline(F.array(F.struct(*found)))), rules, kinds)
