"""Queries of parse rules, sources, sinks, the engine and recovery, over lines rendered from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators import routing, stats
from siltwork.operators.dispatch import dispatch
from siltwork.plans.conditions import compile_condition
from siltwork.plans.model import Compiler, apply_model, parse_model
from siltwork.sources import files, reference, sinks
from siltwork.streaming.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, sql


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='siltwork-')}/io-{uuid.uuid4().hex}"


def _rule(name: str, rule: str, line: str, columns: str, sql: str, where: str = "true") -> None:
    """Lines rendered by an SQL expression, parsed by one rule; ``columns`` are expressions over its fields."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _events(spark, sf_dir).where(where).select("event_id", F.expr(line).alias("raw"))
        return dispatch(lines, rule).records("r").selectExpr("event_id", *[c.strip() for c in columns.split(";")])

    _add(name, run, sql)


_rule("rule_json", "rule r { (json(digit@user:uid, chars@kind, float@v, _@drop)) }", "to_json(struct(user_id as user, event_type as kind, value as v, 1 as drop))", "uid; kind; v", "select event_id, user_id uid, event_type kind, value v from events")
_rule("rule_json_mismatch", "rule r { (json(digit@kind)) }", "to_json(struct(if(event_id % 2 = 0, event_type, '7') as kind))", "kind", "select event_id, 7::bigint kind from events where event_id % 2 = 1")
_rule("rule_json_whole", "rule r { |unquote/unescape|(json) }", "concat('\"', replace(props, '\"', concat(char(92), '\"')), '\"')", "get_json_object(json, '$.k') k", "select event_id, props->>'$.k' k from events")
_rule("rule_kv_one", r"rule r { (chars:head\;kv(digit@uid)\;kv(@kind)) }", "concat('h x;uid=', user_id, ';kind=\"', event_type, '\"')", "head; uid; kind", "select event_id, 'h x' head, user_id uid, event_type kind from events")
_rule("rule_kv_many", r"rule r { (symbol(EVT), *kv:pairs\,) }", "concat('EVT a=1,uid=', user_id, ',kind=', event_type, ',a=2')", "pairs['a'] a; pairs['uid'] uid; pairs['kind'] kind", "select event_id, '2' a, user_id::varchar uid, event_type kind from events")
_rule("rule_kvarr", "rule r { (symbol(EVT), kvarr(digit@uid, _@gone):rest) }", "concat('EVT uid=', user_id, ' tag=', event_type, ', tag:\"b\" gone=1 tag[0]=z')", "uid; rest['tag[0]'] t0; rest['tag[1]'] t1; rest['gone'] gone", "select event_id, user_id uid, 'z' t0, 'b' t1, null::varchar gone from events")
_rule("rule_alt_opt_not", "rule r { (symbol(A)), alt(symbol(-click),symbol(-view),symbol(-error)), opt(symbol(MORE)), not(symbol(STOP)), (digit:n) }", "concat('A -', event_type, if(event_id % 2 = 0, ' MORE', ''), if(event_id % 3 = 0, ' STOP', ''), ' ', user_id)", "n", "select event_id, user_id n from events where event_type in ('click','view','error') and event_id % 3 <> 0")
_rule("rule_separators", r"rule r { (chars:a{\s(uid=)}, kv(digit@uid)\;, chars:b\t, chars:c) }", "concat('some words here uid=', user_id, ';', event_type, char(9), 'end')", "a; uid; b; c", "select event_id, 'some words here' a, user_id uid, event_type b, 'end' c from events")
_rule("rule_group_separator", r"rule r { (chars:a, digit:uid, chars:b)\; }", "concat('some words;', user_id, '; ', event_type)", "a; uid; b", "select event_id, 'some words' a, user_id uid, event_type b from events")
_rule("rule_scalar_types", "rule r { (sn:id, bool:even, float:v, ip:addr, http/method:m, time:t, _) }", "concat('SN-', event_id, ' ', if(event_id % 2 = 0, 'true', 'false'), ' ', cast(user_id as string), '.5 10.0.0.', event_id % 256, ' GET ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' skipped')", "id; even; v; addr; m; t", "select event_id, 'SN-'||event_id id, event_id % 2 = 0 even, user_id + 0.5::double v, '10.0.0.'||(event_id % 256) addr, 'GET' m, date_trunc('second', ts) t from events")
_rule("rule_wrapped_agent", 'rule r { (digit:pri<<,>>, chars:name<[,]>, http/agent:agent", 2*_, *_) }', "concat('<', event_id % 190, '>[', event_type, ' x] \"Agent/', user_id, ' (x; y)\" - - a b c')", "pri; name; agent", "select event_id, event_id % 190 pri, event_type||' x' as name, 'Agent/'||user_id||' (x; y)' agent from events")
_rule("rule_base64_hex", "rule r { |decode/base64|decode/hex|(digit:uid, chars:kind) }", "base64(hex(concat(user_id, ' ', event_type)))", "uid; kind", "select event_id, user_id uid, event_type kind from events")
_rule("rule_checks", "rule r { (digit:uid |digit_range(0,400), chars:kind |chars_not_has(view) |not(starts_with('p')), chars:w |chars_replace(a,b)) }", "concat(user_id, ' ', event_type, ' banana')", "uid; kind; w", "select event_id, user_id uid, event_type kind, 'bbnbnb' w from events where user_id between 0 and 400 and event_type <> 'view' and event_type not like 'p%'")
_rule("rule_regex_in", "rule r { (chars:kind |chars_in(click, view) |regex_match('^[cv].*k?$'), digit:uid) }", "concat(event_type, ' ', user_id)", "kind; uid", "select event_id, event_type kind, user_id uid from events where event_type in ('click','view')")
_rule("rule_annotation", '#[tag(team: "ops")] rule r { (digit:uid) }', "cast(user_id as string)", "uid; team", "select event_id, user_id uid, 'ops' team from events")
_rule("rule_repeats", "rule r { (2*digit:pair, 2*_, chars:kind) }", "concat(user_id, ' ', event_id, ' - - ', event_type)", "pair; `pair[1]` second; kind", "select event_id, user_id pair, event_id as second, event_type kind from events")


def _parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    lines = _events(spark, sf_dir).select(F.concat_ws(",", F.lit("EVT"), "event_id", F.concat("event_type", F.lit("\r"))).alias("value"))
    lines.write.text(f"{base}/logs")
    found = files.read_files(spark, f"{base}/logs", "part-*.txt", key="web")
    return dispatch(found, r"rule r { (symbol(EVT), digit:id, chars:kind)\, }").records("r")


_add("source_files", lambda s, d: _parsed_files(s, d).selectExpr("id", "kind", "src_key"), "select event_id id, event_type kind, 'web' src_key from events")
_add("source_event_ids", lambda s, d: _parsed_files(s, d).agg(F.count_distinct("event_id").alias("ids"), F.count(F.lit(1)).alias("lines")), "select count(*) ids, count(*) \"lines\" from events")


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed_files(spark, sf_dir).withColumn("ups_ip", F.lit("192.0.2.9"))
    tagged = files.with_tags(rows, tags=("access_source", "kind", "absent"))
    return files.with_provenance(tagged).selectExpr("id", "kind", "absent", "access_source like '%/logs/part-%' as from_file", "wp_src_key", "wp_src_ip")


_add("source_provenance", _provenance, "select event_id id, event_type kind, null::varchar absent, true from_file, 'web' wp_src_key, '192.0.2.9' wp_src_ip from events")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("%% no base64")).otherwise(F.base64(F.concat_ws(",", "event_id", "event_type").cast("binary")))
    _events(spark, sf_dir).select(raw.alias("value")).write.text(f"{base}/logs")
    return files.read_files(spark, f"{base}/logs", "*", encode="base64", on_error="keep").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


_add("source_base64", _encoded, "select case when event_id % 5 <> 0 then event_id||','||event_type end raw, count(*) n from events group by 1")
_add("generator_profile", lambda s, d: files.profile_table(s, 60, files.composite([files.constant(10), files.stepped([(20, 1), (20, 5)]), files.burst(0, 30, 10, 2), files.ramp(0, 60, 30)], "sum")), "select t::bigint t, (10 + case when t < 20 then 1 else 5 end + case when t % 10 < 2 then 30 else 0 end + 60*least(1.0, t/30.0))::double rate from range(60) r(t)")
_add("generator_extremes", lambda s, d: files.profile_table(s, 60, files.composite([files.constant(10), files.ramp(0, 60, 30)], "max")), "select t::bigint t, greatest(10.0, 60*least(1.0, t/30.0))::double rate from range(60) r(t)")
_add("generator_samples", lambda s, d: files.generate(s, ["a b", "c"], 1000).groupBy("src_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("kinds")), "select 'generator' src_key, 1000::bigint n, 2::bigint kinds")
_add("generator_rule", lambda s, d: dispatch(files.generate_by_rule(s, {"a": "ip", "n": "digit", "t": "time", "c": "chars"}, 500), "rule r { (ip:a, digit:n, time:t, chars:c) }").all.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "select 'hit' outcome, 500::bigint n")


def _rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    files.write_rescue(_events(spark, sf_dir).select("event_id", "event_type"), base, "g__all")
    files.write_rescue(_events(spark, sf_dir).where("event_id % 2 = 0").select(F.concat_ws("|", "event_id", "event_type").alias("raw")), base, "raw", raw="raw")
    records = files.read_rescue(spark, base, "g__all", "event_id long, event_type string").select("kind", "record.event_id", "record.event_type")
    raw = files.read_rescue(spark, base, "raw").select("kind", F.split("payload", r"\|")[0].cast("bigint").alias("event_id"), F.split("payload", r"\|")[1].alias("event_type"))
    return records.unionByName(raw)


_add("rescue_entries", _rescue, "select 'record' kind, event_id, event_type from events union all select 'raw', event_id, event_type from events where event_id % 2 = 0")


def _rescue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    files.write_rescue(_events(spark, sf_dir).select("event_id").coalesce(1), base, "a")
    files.write_rescue(_events(spark, sf_dir).select("event_id").coalesce(1), base, "a")
    files.write_rescue(_events(spark, sf_dir).where("event_id % 2 = 0").select("event_id").coalesce(1), base, "b")
    return files.rescue_statistics(spark, base).select("sink", "files", "lines")


_add("rescue_statistics", _rescue_statistics, "select 'a' sink, 2::bigint files, 2*count(*) \"lines\" from events union all select 'b', 1, count(*) from events where event_id % 2 = 0")

_MODEL = "name : m\nrule : /web/*\n---\nid = read(); kind = read(); twice = calc(read(id) * 2); start = pipe read(kind) | starts_with('c');"
_STRICT = "name : s\nrule : /app/*\n---\nstart = pipe read(kind) | starts_with('c');"
_OFF = "name : off\nenable : false\nrule : /web/*\n---\nid = chars(never);"
_RULES = r"package /web { rule evt { (symbol(EVT), digit:id, chars:kind)\, } } package /app { rule app { (symbol(APP), digit:id, chars:kind)\, } } package /other { rule o { (symbol(OTH), digit:id) } rule bad { (nosuch) } }"


def _engine() -> Engine:
    groups = [routing.Group("web", ("/web/*",), sinks=[routing.Sink("clicks", "$kind == chars(click)", tags={"env": "t"}), routing.Sink("all")]), routing.Group("app", (), ("s*",), sinks=[routing.Sink("all")])]
    return Engine(_RULES, (_OFF, _MODEL, _STRICT), groups)


def _engine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("case event_id % 5 when 0 then concat('EVT,', event_id, ',', event_type) when 1 then concat('APP,', event_id, ',', event_type) when 2 then concat('OTH ', event_id) when 3 then 'nothing' else concat('OTH ', event_id + 1000000, ' x') end")
    return _events(spark, sf_dir).select("event_id", line.alias("raw"))


def _counted(outputs: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n") for name, df in sorted(outputs.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_ENGINE_SQL = """select 'web/clicks' sink, count(*) n from events where event_id%5=0 and event_type='click'
union all select 'web/all', count(*) from events where event_id%5=0
union all select 'app/all', count(*) from events where event_id%5=1 and event_type like 'c%'
union all select 'error', count(*) from events where event_id%5=1 and event_type not like 'c%'
union all select 'default//other/o', count(*) from events where event_id%5 in (2,4)
union all select 'miss', count(*) from events where event_id%5=3
union all select 'residue', count(*) from events where event_id%5=4"""
_add("engine_sinks", lambda s, d: _counted(_engine().run(_engine_lines(s, d))), _ENGINE_SQL)
_add("engine_records", lambda s, d: _engine().run(_engine_lines(s, d))["web/clicks"].select("id", "kind", "twice", "start", "env"), "select event_id id, event_type kind, event_id*2 twice, event_type start, 't' env from events where event_id%5=0 and event_type='click'")
_add("engine_errors", lambda s, d: _engine().run(_engine_lines(s, d))["error"].groupBy("__err_kind", "__wpl_rule", "__sink_group", "__oml_model", "__src_field_count").agg(F.count(F.lit(1)).alias("n")), "select 'oml_transform_empty' __err_kind, '/app/app' __wpl_rule, 'app' __sink_group, 's' __oml_model, 3 __src_field_count, count(*) n from events where event_id%5=1 and event_type not like 'c%' having count(*)>0")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)

    def write(name: str, rows: DataFrame) -> None:
        if name == "web/all":
            raise OSError("fails on purpose")
        sinks.write_file(rows, f"{base}/out/{name.strip('/').replace('//', '/')}", "json")

    failed = _engine().deliver(_engine_lines(spark, sf_dir), write, f"{base}/rescue")
    sent = []
    _engine().recover(spark, f"{base}/rescue", failed[0], lambda name, rows: sent.append(rows), "id long, kind string, twice long", checkpoint=f"{base}/checkpoint")
    clicks = spark.read.schema("id long, kind string, twice long").json(f"{base}/out/web/clicks")
    return sent[0].withColumn("sink", F.lit("recovered")).unionByName(clicks.withColumn("sink", F.lit("clicks")))


_add("engine_rescue", _delivered, "select event_id id, event_type kind, event_id*2 twice, 'recovered' sink from events where event_id%5=0 union all select event_id, event_type, event_id*2, 'clicks' from events where event_id%5=0 and event_type='click'")


def _format(name: str, fmt: str, sql: str) -> None:
    _add(name, lambda s, d: sinks.formatted(_events(s, d).select("event_id", F.concat("event_type", F.lit(' "q", x')).alias("kind")), fmt), f"select {sql} as \"value\" from events")


_K = "event_type||' \"q\", x'"
_format("sink_json", "json", f"'{{\"event_id\":'||event_id||',\"kind\":\"'||replace({_K},'\"','\\\"')||'\"}}'")
_format("sink_csv", "csv", f"event_id||',\"'||replace({_K},'\"','\"\"')||'\"'")
_format("sink_kv", "kv", f"'event_id: '||event_id||', kind: \"'||replace({_K},'\"','\\\"')||'\"'")
_format("sink_raw", "raw", f"event_id||' '||{_K}")
_format("sink_proto_text", "proto-text", f"'event_id: '||event_id||' kind: \"'||replace({_K},'\"','\\\"')||'\"'")
_format("sink_show", "show", f"'event_id(digit) = '||event_id||chr(10)||'kind(chars) = '||{_K}")


def _arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    sinks.write_arrow_files(_events(spark, sf_dir).select("event_id", "event_type", "value"), base).agg(F.sum("rows")).collect()
    return sinks.read_arrow_files(spark, base, "event_id long, event_type string, value double")


_add("sink_arrow_file", _arrow_files, "select event_id, event_type, value from events")
_add("sink_syslog", lambda s, d: sinks.syslog_lines(_events(s, d).select("event_id"), "raw", facility=2, severity=3).select(F.regexp_replace("value", "^(<[0-9]+>)[A-Z][a-z]{2} +[0-9]+ [0-9:]{8} ", "$1").alias("line")), "select '<19>siltwork siltwork: '||event_id line from events")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    shown = nations.select(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 7 == 0, F.lit("no number")).otherwise(F.col("n_nationkey").cast("string")).alias("number"))
    shown.coalesce(1).write.option("header", True).csv(f"{base}/data")
    create = "CREATE TABLE IF NOT EXISTS {table} (id INTEGER PRIMARY KEY, code INTEGER NOT NULL, name TEXT NOT NULL);"
    insert = "INSERT INTO {table} (name, code) VALUES (?2, ?1);"
    table = reference.load_table(spark, base, create, insert, data_file="data", by_header=["number", "title"], on_error="skip", expected=(1, 100))
    return apply_model(_events(spark, sf_dir).withColumn("code", F.col("user_id") % 25), "name : t\n---\nevent_id = read(); name = select name from nations where code = read(code);", {"nations": table})


_add("reference_table", _reference, "select event_id, n_name as name from events left join nation on n_nationkey = user_id % 25 and n_nationkey % 7 <> 0")
_add("lookup_or", lambda s, d: apply_model(_events(s, d).selectExpr("event_id", "user_id % 25 a", "event_id % 25 b"), "name : t\n---\nevent_id = read(); n = select count(*) from nation where n_nationkey = read(a) or n_nationkey = read(b);", {"nation": s.read.parquet(f"{d}/nation.parquet")}), "select event_id, case when user_id % 25 = event_id % 25 then 1 else 2 end::bigint n from events")
_add("lookup_less", lambda s, d: apply_model(_events(s, d).selectExpr("event_id", "user_id % 25 a"), "name : t\n---\nevent_id = read(); n = select count(*) from nation where n_nationkey < read(a);", {"nation": s.read.parquet(f"{d}/nation.parquet")}), "select event_id, user_id % 25 n from events")
_add("path_argument", lambda s, d: apply_model(_events(s, d).withColumnRenamed("event_type", "/a/b"), "name : t\n---\nevent_id = read(); x = read(/a/b);"), "select event_id, event_type x from events")
_add("to_str", lambda s, d: apply_model(_events(s, d), "name : t\n---\nevent_id = read(); a = pipe read(user_id) | to_str; b = pipe read(event_type) | to_str;"), "select event_id, user_id::varchar a, event_type b from events")
_add("wildcard_numbers", lambda s, d: (lambda rows: rows.where(compile_condition("$user_id =* digit(7) || $value =* float(50.0)", routing.fields_of(rows))).select("event_id"))(_events(s, d)), "select event_id from events where user_id = 7 or abs(value - 50.0) < 1e-4")
_add("stat_records", lambda s, d: stats.record_form(stats.measures(_events(s, d), stats.StatItem("parse", "by_kind", "item", ("event_type",), 2), F.lit(True), "ts")).select("event_type", "total", F.round("speed", 9).alias("speed")), "select event_type, count(*) total, round(count(*)*1000.0::double/(datediff('millisecond', min(ts), max(ts))+1)/10000, 9) speed from events group by 1")


_DIAG = "name : t\n---\nevent_id = read(); a = read(absent); n : digit = read(mixed); c = calc(read(event_id) / (read(event_id) % 2)); f = fmt('{odd}', @odd); none* = take();"


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr("event_id", "if(event_id % 3 = 0, 'x', '5') mixed", "if(event_id % 2 = 0, null, 'y') odd")
    return Compiler(parse_model(_DIAG), diagnostics=True).apply(rows).select("event_id", F.array_join("__diag", ";").alias("issues"))


_add("diagnostics", _diagnosed, "select event_id, 'missing_field: absent'||case when event_id%3=0 then ';parse_fail: n' else '' end||case when event_id%2=0 then ';math_eval_fail: c;fmt_var_missing: odd' else '' end||';batch_no_match: none*' issues from events")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
