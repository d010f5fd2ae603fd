"""The queries of the log engine over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import scalar
from siltwork.operators import routing, stats
from siltwork.operators.dispatch import dispatch
from siltwork.plans.conditions import compile_condition
from siltwork.plans.model import apply_model
from siltwork.plans.rules import key_values
from siltwork.sources.syslog import header

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _model(name: str, table: str, statements: str, sql: str | None, tables: tuple[str, ...] = (), statics: str = "", columns: str | None = None) -> None:
    """A query that applies an object model to a table."""
    text = f"name : {name}\n---\n{statics}\n{statements}\n"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        if columns:
            rows = rows.selectExpr(*[c.strip() for c in columns.split(";")])
        return apply_model(rows, text, {t: _table(spark, sf_dir, t) for t in tables})

    _add(name, run, sql)


_LI = "l_orderkey = read(); l_linenumber = read();"
_LIS = "l_orderkey, l_linenumber::bigint l_linenumber"
_model("calc_add_mul", "lineitem", _LI + "x = calc(read(l_orderkey) * 3 + read(l_partkey) - 7); y = calc(read(l_extendedprice) * 0.7 + read(l_quantity) * 0.3);", f"select {_LIS}, l_orderkey*3+l_partkey-7 as x, l_extendedprice*0.7::double+l_quantity*0.3::double as y from lineitem")
_model("calc_div", "lineitem", _LI + "x = calc(read(l_orderkey) / read(l_partkey)); y = calc(read(l_extendedprice) / read(l_quantity));", f"select {_LIS}, l_orderkey::double/nullif(l_partkey,0)::double x, l_extendedprice/nullif(l_quantity,0) y from lineitem")
_model("calc_div_zero", "lineitem", _LI + "x = calc(read(l_orderkey) / (read(l_linenumber) - 1)); y = calc(read(l_orderkey) % (read(l_linenumber) - 1));", f"select {_LIS}, l_orderkey::double/nullif(l_linenumber-1,0)::double x, (l_orderkey % nullif(l_linenumber-1,0))::bigint y from lineitem")
_model("calc_mod", "lineitem", _LI + "x = calc((0 - read(l_orderkey)) % 7);", f"select {_LIS}, ((0-l_orderkey) % 7)::bigint x from lineitem")
_model("calc_round", "lineitem", _LI + "r = calc(round(read(l_extendedprice) / 3)); f = calc(floor(read(l_extendedprice) - 5000.5)); c = calc(ceil(read(l_tax) * 100)); n = calc(round(0 - read(l_quantity) / 4)); a = calc(abs(5000 - read(l_extendedprice)));", f"select {_LIS}, round(l_extendedprice/3)::bigint r, floor(l_extendedprice-5000.5::double)::bigint f, ceil(l_tax*100)::bigint c, round(0-l_quantity/4)::bigint n, abs(5000-l_extendedprice) a from lineitem")
_model("calc_overflow", "lineitem", _LI + "x = calc(read(l_orderkey) * 9000000000000000); y = calc(read(l_comment) + 1);", f"select {_LIS}, try_cast(l_orderkey::hugeint*9000000000000000 as bigint) x, null::double y from lineitem")
_model("calc_neg", "orders", "o_orderkey = read(); x = calc(-read(o_custkey) + -(read(o_totalprice)));", "select o_orderkey, (0-o_custkey)+(0-o_totalprice) x from orders")

_model("match_eq", "orders", 'o_orderkey = read(); x = match read(o_orderstatus) { chars(O) => chars(open), chars(F) => chars(filled), };', "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' end x from orders")
_model("match_neq", "orders", "o_orderkey = read(); x = match read(o_orderstatus) { !chars(O) => digit(1), _ => digit(0) }; y = match read(o_custkey) { !chars(O) => digit(1), _ => digit(0) };", "select o_orderkey, (o_orderstatus<>'O')::int::bigint x, 0::bigint y from orders")
_model("match_in", "part", "p_partkey = read(); x = match read(p_size) { in (digit(1), digit(10)) => chars(small) ; in (digit(11), digit(30)) => chars(medium) ; _ => chars(large) ; };", "select p_partkey, case when p_size between 1 and 10 then 'small' when p_size between 11 and 30 then 'medium' else 'large' end x from part")
_model("match_or", "orders", "o_orderkey = read(); x = match read(o_orderpriority) { chars(1-URGENT) | chars(2-HIGH) => chars(tier1), _ => chars(tier2) };", "select o_orderkey, case when o_orderpriority in ('1-URGENT','2-HIGH') then 'tier1' else 'tier2' end x from orders")
_model("match_tuple", "orders", "o_orderkey = read(); x = match (read(o_orderstatus), read(o_orderpriority)) { (chars(O), starts_with('1')) => chars(now), (chars(O) | chars(P), _) => chars(later), _ => chars(done) };", "select o_orderkey, case when o_orderstatus='O' and o_orderpriority like '1%' then 'now' when o_orderstatus in ('O','P') then 'later' else 'done' end x from orders")
_model("match_functions", "part", "p_partkey = read(); a = match read(p_type) { starts_with('STANDARD') => digit(1), ends_with('STEEL') => digit(2), contains('BRUSHED') => digit(3), _ => digit(0) }; b = match read(p_name) { regex_match('^[a-m].*e') => bool(true), _ => bool(false) }; c = match read(p_brand) { iequals('brand#13') => digit(1), iequals_any('BRAND#21', 'brand#32') => digit(2), _ => digit(0) }; d = match read(p_name) { is_empty() => digit(1), _ => digit(0) };", "select p_partkey, case when starts_with(p_type,'STANDARD') then 1 when suffix(p_type,'STEEL') then 2 when contains(p_type,'BRUSHED') then 3 else 0 end::bigint a, regexp_matches(p_name,'^[a-m].*e') b, case when lower(p_brand)='brand#13' then 1 when lower(p_brand) in ('brand#21','brand#32') then 2 else 0 end::bigint c, (p_name='')::int::bigint d from part")
_model("match_numeric", "lineitem", _LI + "x = match read(l_quantity) { gt(40) => chars(many), lt(5) => chars(few), in_range(20, 30) => chars(mid), eq(10) => chars(ten), _ => chars(other) };", f"select {_LIS}, case when l_quantity>40 then 'many' when l_quantity<5 then 'few' when l_quantity between 20 and 30 then 'mid' when abs(l_quantity-10)<1e-10 then 'ten' else 'other' end x from lineitem")
_model("match_default", "events", "event_id = read(); x = match read(no_such_field) { chars(a) => chars(b), _ => chars(missing) };", "select event_id, 'missing' x from events")

def _lookup_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("level", F.concat(F.lit(" "), F.substring("o_orderpriority", 3, 20)))
    return apply_model(orders, "name : t\n---\nstatic { weights = object { URGENT = float(9.0); High = float(7.0); medium = float(5.0); }; }\no_orderkey = read(); x = lookup_nocase(weights, read(level), float(0.5));")


_add("lookup_nocase", _lookup_nocase, "select o_orderkey, case lower(trim(substr(o_orderpriority,3))) when 'urgent' then 9.0::double when 'high' then 7.0::double when 'medium' then 5.0::double else 0.5::double end x from orders")

_model("read_option", "events", "event_id = read(); a = read(option : [none, event_type]); b = read(nothing) { _ : chars(default) }; c = @user_id;", "select event_id, event_type a, 'default' b, user_id c from events")
_model("take_move", "events", "event_id = take(); kind = take(event_type); gone = read(event_type) { _ : chars(gone) }; * = take();", "select event_id, event_type kind, 'gone' gone, ts, user_id, value, props from events")
_model("batch_glob", "customer", "c_n* = take();", "select c_name, c_nationkey::bigint c_nationkey from customer")
_model("batch_type", "customer", "* : float = take(); key = read(c_custkey);", "select c_acctbal, c_custkey as key from customer")
_model("collect_array", "customer", "c_custkey = read(); x : array = collect read(keys : [c_name, c_mkt*]); y = pipe read(x) | nth(1); z = pipe read(x) | to_json; __t = read(x);", "select c_custkey, [c_name, c_mktsegment] x, c_mktsegment y, to_json([c_name, c_mktsegment])::varchar z from customer")
_model("object_member", "customer", "c_custkey = read(); __o : obj = object { name = read(c_name); seg : chars = read(c_mktsegment); }; x = pipe read(__o) | get(seg); j = pipe read(__o) | to_json;", "select c_custkey, c_mktsegment x, '{\"name\":\"'||c_name||'\",\"seg\":\"'||c_mktsegment||'\"}' j from customer")
_model("fmt_concat", "customer", "c_custkey = read(); x = fmt('{c_name}<{c_mktsegment}>{c_nationkey}', @c_name, read(c_mktsegment), @c_nationkey); y = fmt('{a}-{b}', @c_name, read(missing));", "select c_custkey, c_name||'<'||c_mktsegment||'>'||c_nationkey x, '' y from customer")
_model("temp_field", "customer", "__half = calc(read(c_acctbal) / 2); c_custkey = read(); x = calc(read(__half) + 1);", "select c_custkey, c_acctbal/2+1 x from customer")
_model("static_const", "customer", "c_custkey = read(); x = match read(c_mktsegment) { seg => digit(1), _ => digit(0) }; y = limit;", "select c_custkey, (c_mktsegment='BUILDING')::int::bigint x, 100::bigint y from customer", statics="static { seg = chars(BUILDING); limit = digit(100); }")
_model("declared_type", "events", "event_id = read(); n : digit = read(digits); f : float = read(digits); b : bool = read(flag); t : chars = read(value_id);", "select event_id, user_id n, user_id::double f, (user_id % 2 = 0) b, user_id::varchar t from events", columns="event_id; cast(user_id as string) digits; if(user_id % 2 = 0, 'true', 'false') flag; user_id value_id")
_model("skip_empty_map_to", "events", "event_id = read(); a = pipe read(zero) | skip_empty; b = pipe read(event_type) | starts_with('p') | map_to(7); c = pipe read(event_type) | starts_with('p'); d = pipe read(event_type) | map_to(true);", "select event_id, nullif(user_id % 3, 0) a, case when event_type like 'p%' then 7 end::bigint b, case when event_type like 'p%' then event_type end c, true d from events", columns="event_id; event_type; user_id % 3 zero")
_model("now_functions", "region", "r_regionkey = read(); t = Now::time(); d = Now::date(); h = Now::hour();", None)
_model("base64_functions", "customer", "c_custkey = read(); e = pipe read(c_name) | base64_encode; d = pipe read(e) | base64_decode; bad = pipe read(c_name) | base64_decode;", "select c_custkey, to_base64(encode(c_name)) e, c_name d, '' bad from customer")
_model("html_json_escape", "events", "event_id = read(); a = pipe read(props) | html_escape; b = pipe read(props) | json_escape; c = pipe read(b) | json_unescape; d = pipe read(props) | str_escape;", "select event_id, replace(replace(replace(replace(replace(replace(props,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;'),'/','&#x2F;') a, replace(replace(props,'\\','\\\\'),'\"','\\\"') b, props c, replace(replace(replace(props,'\\','\\\\'),'''','\\'''),'\"','\\\"') d from events")
_model("html_unescape", "events", "event_id = read(); a = pipe read(props) | html_escape | html_unescape;", "select event_id, props a from events")
_model("time_to_ts", "events", "event_id = read(); s = pipe read(ts) | Time::to_ts; ms = pipe read(ts) | Time::to_ts_ms; us = pipe read(ts) | Time::to_ts_us; z = pipe read(ts) | Time::to_ts_zone(-5, s);", "select event_id, (epoch_us(ts)-28800000000)//1000000 s, (epoch_us(ts)-28800000000)//1000 ms, epoch_us(ts)-28800000000 us, (epoch_us(ts)+18000000000)//1000000 z from events")
_model("url_parts", "pages", "page_id = read(); d = pipe read(url) | url(domain); h = pipe read(url) | url(host); u = pipe read(url) | url(uri); p = pipe read(url) | url(path); q = pipe read(url) | url(params);", r"select page_id, regexp_extract(url,'^[a-z]+://([^/?#:]+)',1) d, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) h, regexp_extract(url,'^[a-z]+://[^/?#]+(.*)$',1) u, regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1) p, regexp_extract(url,'\?([^#]*)',1) q from pages")
_model("path_parts", "pages", "page_id = read(); n = pipe read(p) | path(name); d = pipe read(p) | path(path); w = pipe read(p) | path(default);", r"select page_id, regexp_extract(url,'^[a-z]+://[^/?#]+/([a-z]+)/',1) d, 'x.log' n, regexp_extract(url,'^[a-z]+://[^/?#]+/([a-z]+)/',1)||'/x.log' w from pages", columns=r"page_id; concat(regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1), '\\', 'x.log') p")
_model("json_get", "events", "event_id = read(); k : digit = pipe read(props) | get(k);", "select event_id, (props->>'$.k')::bigint k from events")
_model("main_word", "part", "p_partkey = read(); w = pipe read(p_name) | extract_main_word;", None)
_model("subject_object", "part", "p_partkey = read(); o = pipe read(p_name) | extract_subject_object;", None)

_IP = "concat_ws('.', '10', cast(user_id % 256 as string), cast((user_id * 7) % 256 as string), cast(event_id % 256 as string))"
_IPD = "'10.'||(user_id % 256)||'.'||((user_id*7) % 256)||'.'||(event_id % 256)"
_IPN = "(10::bigint*16777216+(user_id % 256)*65536+((user_id*7) % 256)*256+(event_id % 256))"


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ip", F.expr(_IP))


_add("ip4_to_int", lambda s, d: apply_model(_addressed(s, d), "name : t\n---\nevent_id = read(); n = pipe read(ip) | ip4_to_int; same = pipe read(event_type) | ip4_to_int;", kinds={"ip": "ip"}), f"select event_id, {_IPN}::bigint n, event_type same from events")
_add("ip_match", lambda s, d: apply_model(_addressed(s, d), "name : t\n---\nevent_id = read(); x = match read(ip) { in (ip(10.0.0.0), ip(10.99.255.255)) => chars(low); !ip(10.100.0.0) => chars(high); };", kinds={"ip": "ip"}), f"select event_id, case when {_IPN} <= 174325759 then 'low' when {_IPN} <> 174325760 then 'high' end x from events")
_add("cidr_functions", lambda s, d: _addressed(s, d).select("event_id", scalar.cidr4_min(F.concat("ip", F.lit("/20"))).alias("low"), scalar.cidr4_max(F.concat("ip", F.lit("/20"))).alias("high"), scalar.cidr4_contains(F.col("ip"), F.lit("10.64.0.0/10")).alias("hit"), scalar.ip4_text(scalar.ip4_int(F.col("ip"))).alias("text"), scalar.ip4_int(F.lit("x")).alias("bad"), scalar.trim_quotes(F.concat(F.lit('"'), "ip", F.lit('"'))).alias("bare")), f"select event_id, ({_IPN} - {_IPN} % 4096)::bigint low, ({_IPN} - {_IPN} % 4096 + 4095)::bigint high, ({_IPN} between 171966464 and 176160767)::int hit, {_IPD} text, 0::bigint bad, {_IPD} bare from events")

_model("sql_lookup_equi", "orders", "o_orderkey = read(); name, seg = select c_name, c_mktsegment from customer where c_custkey = read(o_custkey);", "select o_orderkey, c_name as name, c_mktsegment seg from orders left join customer on c_custkey=o_custkey", ("customer",))
_model("sql_lookup_own_names", "nation", "n_nationkey = read(); _,_ = select r_name, r_regionkey from region where r_regionkey = read(n_regionkey) and r_name != 'ASIA';", "select n_nationkey::bigint n_nationkey, r_name, r_regionkey from nation left join region on r_regionkey=n_regionkey and r_name<>'ASIA'", ("region",))
_model("sql_lookup_in", "lineitem", _LI + "n, names = select count(distinct s_suppkey), group_concat(distinct s_name) from supplier where s_suppkey in (read(l_suppkey), read(l_linenumber), 3);", f"with a as (select distinct l_suppkey, l_linenumber from lineitem), b as (select a.l_suppkey, a.l_linenumber ln, count(distinct s_suppkey) n, string_agg(distinct s_name, ',' order by s_name) as names from a join supplier on s_suppkey in (a.l_suppkey, a.l_linenumber, 3) group by 1,2) select l_orderkey, l.l_linenumber::bigint l_linenumber, coalesce(n,0) n, names from lineitem l left join b on b.l_suppkey=l.l_suppkey and b.ln=l.l_linenumber", ("supplier",))
_model("sql_lookup_agg", "customer", "c_custkey = read(); n, big = select count(*), max(o_totalprice) from orders where o_custkey = read(c_custkey) and o_orderstatus = 'F';", "select c_custkey, coalesce(n,0) n, big from customer left join (select o_custkey, count(*) n, max(o_totalprice) big from orders where o_orderstatus='F' group by 1) on o_custkey=c_custkey", ("orders",))
_model("sql_lookup_miss", "events", "event_id = read(); x = select c_name from customer where c_custkey = read(absent);", "select event_id, null::varchar x from events", ("customer",))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select((F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 700_000).alias("low"), (F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 700_000 + 500_000).alias("high"), "n_name")


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_model(_addressed(spark, sf_dir), "name : t\n---\nevent_id = read(); band = select n_name from bands where ip4_between(read(ip), low, high) = 1;", {"bands": _bands(spark, sf_dir)}, {"ip": "ip"})


_add("sql_lookup_range", _range, f"select event_id, n_name band from events left join nation on {_IPN} between 167772160+n_nationkey*700000 and 167772160+n_nationkey*700000+500000")


def _filter(name: str, table: str, key: str, condition: str, where: str, expect: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return rows.where(compile_condition(condition, routing.fields_of(rows)) == F.lit(expect)).select(key)

    _add(name, run, f"select {key} from {table} where {where}")


_filter("filter_and", "orders", "o_orderkey", "$o_orderstatus == chars(O) && $o_totalprice > float(100000.0)", "o_orderstatus='O' and o_totalprice>100000")
_filter("filter_or_group", "orders", "o_orderkey", "$o_custkey < digit(50) && ($o_orderstatus == chars(F) || $o_orderstatus == chars(P))", "o_custkey<50 and o_orderstatus in ('F','P')")
_filter("filter_not", "orders", "o_orderkey", "!($o_orderstatus == chars(O) || $missing == digit(1))", "o_orderstatus<>'O'")
_filter("filter_isset", "orders", "o_orderkey", "isset($o_custkey) && !isset($nothing) && $o_custkey >= digit(100)", "o_custkey>=100")
_filter("filter_wildcard", "part", "p_partkey", "$p_type =* chars(*BRASS) || $p_brand =* chars(Brand#1?)", "p_type like '%BRASS' or p_brand like 'Brand#1_'")
_filter("filter_type_mismatch", "orders", "o_orderkey", "$o_custkey != chars(7)", "false")
_filter("filter_expect_false", "events", "event_id", "$event_type == chars(click)", "not coalesce(event_type='click', false)", expect=False)

_GROUP = routing.Group("g", ("/web/*",), sinks=[routing.Sink("errors", "$event_type == chars(error)", tags={"level": "high"}), routing.Sink("paid", "$event_type == chars(purchase) || $value > float(90.0)"), routing.Sink("all")], tags={"env": "test"})
_add("route_fanout", lambda s, d: routing.deliveries(_table(s, d, "events"), _GROUP).select("event_id", "sink"), "select event_id, 'errors' sink from events where event_type='error' union all select event_id, 'paid' from events where event_type='purchase' or value>90 union all select event_id, 'all' from events")
_add("tags_merge", lambda s, d: routing.fan_out(_table(s, d, "events"), _GROUP, {"env": "prod", "app": "x"})["errors"].select("event_id", "app", "env", "level"), "select event_id, 'x' app, 'test' env, 'high' as level from events where event_type='error'")
_add("route_error", lambda s, d: routing.error_records(apply_model(_table(s, d, "events"), "name : t\n---\nx = pipe read(event_type) | starts_with('c');"), rule="/web/r", group="g", model="t", source_fields=6).groupBy("__err_kind", "__oml_model").count().withColumnRenamed("count", "n"), "select 'oml_transform_empty' __err_kind, 't' __oml_model, count(*) n from events where event_type is null or event_type not like 'c%' having count(*) > 0")

_RULES = r"""
package /web {
  rule access { (ip:sip, 2*_, time/clf:at<[,]>, http/request:request", http/status:status, digit:size) }
  rule pairs { (chars:tag, kv:pairs) }
}
"""
_RULES = _RULES.replace("  rule pairs { (chars:tag, kv:pairs) }\n", "  rule short { (symbol(EVT), digit:id, chars:kind)\\, }\n")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(f"case when event_id % 5 < 3 then concat({_IP}, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0800] \"GET /', event_type, ' HTTP/1.1\" ', cast(200 + user_id % 3 as string), ' ', cast(user_id as string), if(event_id % 5 = 2, ' TAIL', '')) when event_id % 5 = 3 then concat('EVT,', cast(event_id as string), ',', event_type) when event_id % 10 = 4 then 'nothing valid' else '  ' end")
    return _table(spark, sf_dir, "events").select("event_id", line.alias("raw"))


_add("rule_dispatch", lambda s, d: dispatch(_lines(s, d), _RULES).all.select("event_id", "outcome", "rule_key", "residue", "best_rule"), "select event_id, case when event_id%5=2 then 'partial' when event_id%5<4 then 'hit' when event_id%10=4 then 'miss' else 'blank' end outcome, case when event_id%5<3 then '/web/access' when event_id%5=3 then '/web/short' end rule_key, case when event_id%5=2 then 'TAIL' end residue, case when event_id%5=4 then '/web/short' end best_rule from events")
_add("regex_log_parse", lambda s, d: dispatch(_lines(s, d), _RULES).records("/web/access").select("event_id", "sip", "at", "request", "status", "size"), f"select event_id, {_IPD} sip, date_trunc('second', ts) as at, 'GET /'||event_type||' HTTP/1.1' request, (200+user_id%3)::bigint status, user_id size from events where event_id%5<3")
_add("sep_pattern", lambda s, d: dispatch(_lines(s, d), _RULES).records("/web/short").select("event_id", "id", "kind"), "select event_id, event_id id, event_type kind from events where event_id%5=3")
_add("kv_parse", lambda s, d: _table(s, d, "events").select("event_id", key_values(F.concat(F.lit("id="), "event_id", F.lit(", kind: \""), "event_type", F.lit("\",id="), "user_id"), ",", "=:").alias("m")).select("event_id", F.col("m")["id"].cast("bigint").alias("id"), F.col("m")["kind"].alias("kind")), "select event_id, user_id id, event_type kind from events")


def _syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("case event_id % 3 when 0 then concat('<', cast(event_id % 190 as string), '>1 2024-10-05T12:34:56Z host app 123 - - ', event_type) when 1 then concat('<34>Oct 11 22:14:15 mymachine su: ', event_type) else concat('<34>Xyz 11 22:14:15 ', event_type) end")
    return _table(spark, sf_dir, "events").select("event_id", header(line).alias("h")).select("event_id", "h.format", "h.pri", "h.host", "h.app", "h.message")


_add("syslog_norm", _syslog, "select event_id, case event_id%3 when 0 then 'rfc5424' when 1 then 'rfc3164' else 'raw' end format, case event_id%3 when 0 then (event_id%190)::int when 1 then 34 end pri, case event_id%3 when 0 then 'host' when 1 then 'mymachine' end host, case event_id%3 when 0 then 'app' when 1 then 'su' end app, case event_id%3 when 0 then event_type when 1 then 'su: '||event_type else '<34>Xyz 11 22:14:15 '||event_type end message from events")

_ITEM = stats.StatItem("parse", "by_kind", "item", ("event_type",), 2)
_ok = lambda: F.coalesce(F.col("value") > 50, F.lit(False))
_add("stat_rates", lambda s, d: stats.measures(_table(s, d, "events"), _ITEM, _ok(), "ts"), "select 'parse' stage, 'by_kind' as name, 'item' target, event_type, count(*) total, count(*) filter (where value>50) success, min(ts) beg_time, max(ts) end_time, (count(*) filter (where value>50))*100.0::double/count(*) suc_rate, count(*)*1000.0::double/(datediff('millisecond', min(ts), max(ts))+1) speed from events group by event_type")
_add("stat_topn", lambda s, d: stats.top_n(stats.measures(_table(s, d, "events"), stats.StatItem("parse", "users", "item", ("user_id",), 5), _ok()), 5, ("user_id",)).select("user_id", "total", "success"), "select user_id::varchar user_id, count(*) total, count(*) filter (where value>50) success from events group by 1 order by total desc, user_id limit 10")
_add("stat_window", lambda s, d: stats.windowed(_table(s, d, "events"), _ITEM, _ok(), "ts", "1 hour").select("window_start", "event_type", "total", "success"), "select date_trunc('hour', ts) window_start, event_type, count(*) total, count(*) filter (where value>50) success from events group by 1,2")
_add("stat_merge", lambda s, d: stats.merge(stats.measures(_table(s, d, "events"), _ITEM, _ok(), "ts").unionByName(stats.measures(_table(s, d, "events"), _ITEM, _ok(), "ts")), ("event_type",)).select("event_type", "total", "success", "beg_time", "end_time"), "select event_type, count(*)*2 total, (count(*) filter (where value>50))*2 success, min(ts) beg_time, max(ts) end_time from events group by 1")


def _expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").groupBy(F.lit("g").alias("group"), F.col("event_type").alias("sink")).agg(F.count(F.lit(1)).alias("lines"))
    wanted = {"g": stats.GroupExpect(sinks={"click": stats.Expect(ratio=0.2, tol=0.5), "error": stats.Expect(low=0.9)})}
    return stats.check_expectations(lines, wanted).where("sink <> '*'").select("sink", "lines", "share", "status")


_add("expect_ratio", _expect, "select event_type sink, count(*) lines, count(*)::double/(select count(*) from events)::double share, case when event_type='error' and count(*)::double/(select count(*) from events) < 0.9 then 'fail' when event_type='click' and abs(count(*)::double/(select count(*) from events)-0.2)>0.5 then 'fail' else 'ok' end status from events group by 1")
_add("alert_rule", lambda s, d: stats.alerts(stats.measures(_table(s, d, "events"), _ITEM, _ok()), "$suc_rate < float(49.0) || $total > digit(1000000)", "ops", "low success").select("event_type", "notify", "prompt"), "select event_type, 'ops' notify, 'low success' prompt from events group by event_type having (count(*) filter (where value>50))*100.0::double/count(*) < 49 or count(*)>1000000")

_FLAGSHIP = """name : flagship
rule : /web/*
---
static { tiers = object { click = chars(low); purchase = chars(high); error = chars(urgent); }; }
__kind = pipe read(request) | get(none);
event_id = read();
sip = read();
at = read();
epoch = pipe read(at) | Time::to_ts;
address = pipe read(sip) | ip4_to_int;
band = select n_name from bands where ip4_between(read(sip), low, high) = 1;
class = match read(status) { digit(200) => chars(ok); in (digit(201), digit(299)) => chars(odd); _ => chars(other); };
kb = calc(round(read(size) / 1024.0));
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered access-log lines: parse, transform, enrich by an address range, route by filter."""
    parsed = dispatch(_lines(spark, sf_dir), _RULES)
    records = apply_model(parsed.records("/web/access"), _FLAGSHIP, {"bands": _bands(spark, sf_dir)}, parsed.kinds["/web/access"])
    group = routing.Group("g", sinks=[routing.Sink("ok", "$class == chars(ok)"), routing.Sink("rest", "$class == chars(ok)", expect=False)])
    return routing.deliveries(records, group)


_add("flagship", flagship, f"select event_id, {_IPD} sip, date_trunc('second', ts) as at, (epoch_us(date_trunc('second', ts))-28800000000)//1000000 epoch, {_IPN}::bigint address, n_name band, case when user_id%3=0 then 'ok' else 'odd' end as class, round(user_id/1024.0::double)::bigint kb, case when user_id%3=0 then 'ok' else 'rest' end sink from events left join nation on {_IPN} between 167772160+n_nationkey*700000 and 167772160+n_nationkey*700000+500000 where event_id%5<3")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

