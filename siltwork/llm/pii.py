"""Personal data: base patterns, then bootstrapped contextual extraction, in DataFrame functions only.

Base spans are leftmost, non-overlapping matches per kind (email, ip, card, phone), kept where they
pass their test.  Offsets come from pairing a text's matches with the pieces between them; counts
are code points.  The expressions are written so that Java's matcher neither recurses nor rescans:
possessive quantifiers where the next sign can't belong to the run, and look-behinds that start a
match at the beginning of its run or at the end of the match before.  Sums and maxima along a text
are scans by doubling, so n matches cost n log n steps.

Bootstrapping: whole base spans, and maximal runs of other tokens with a digit or an at sign that
only blanks part, are instances; the two words of the text before them are patterns.  The base spans
are seeds.  On the bipartite graph of patterns and instances a pattern's confidence is the mean score
of its instances and an unseen instance's score the mean confidence of its patterns, in turns, until
the set of confident patterns stays or ``rounds`` turns are done; patterns that end confident, and
that enough different seeds support, add the unseen runs that follow them as spans of their kind.

Defined cases: null text is empty and has no spans; texts of any length are read whole; repeated
rows have the same spans, and count once as evidence; a null doc_id keeps its row; an empty table
gives no rows; other columns, whatever their names, are ignored, or kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # fewer than 13 digits fail the card's test in any case
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_MAYBE = "[0-9@]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(match, r"\."), small)
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(values: Column, join) -> Column:
    """Running ``join`` of an array from the left, each place included, by doubling."""

    def whole(v: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(v))
        return F.aggregate(steps, v, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, join(F.get(acc, i - p), x)).otherwise(x)))

    return _bound(values, whole)


_EMPTY = "array<struct<s: int, e: int, match: string, before: string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Array of (s, e, match, before): offsets of each match, and the piece of text before it."""

    def of(b: Column) -> Column:
        matches, pieces = b["matches"], b["pieces"]
        steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        return _bound(_scan(steps, lambda x, y: x + y), lambda at: F.transform(matches, lambda m, i: F.struct(F.get(at, i).alias("s"), (F.get(at, i) + F.length(m)).alias("e"), m.alias("match"), F.get(pieces, i).alias("before"))))

    def some(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, _bound(F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("pieces")), of)).otherwise(F.array().cast(_EMPTY))

    return F.when(text.rlike(_MAYBE), _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(F.array().cast(_EMPTY))


def _kept(kind: str, found: Column) -> Column:
    return F.transform(F.filter(found, lambda x: _passes(kind, x["match"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["match"].alias("match")))


_BLANKS = r"^[\x20\t]++$"


def _context(near: Column) -> Column:
    """The two words before an instance, lower-cased, digits as 0; empty where there are fewer."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(near), r"(?<!\S)(\S++\s++\S++)\s++$", 1), r"\s+", " "), "[0-9]", "0")


def _tokens(found: Column) -> Column:
    """Tokens with their context, and whether only blanks part them from the token before."""

    def one(x: Column, i: Column, tokens: Column) -> Column:
        # two words stand before a token in what lies between it and the token before the last
        text = lambda k, name: F.coalesce(F.get(tokens, k)[name], F.lit(""))
        near = F.concat(text(i - 2, "match"), text(i - 1, "before"), text(i - 1, "match"), x["before"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["match"].alias("match"), ((i > 0) & x["before"].rlike(_BLANKS)).alias("adjacent"), _context(near).alias("context"))

    return _bound(found, lambda tokens: F.transform(tokens, lambda x, i: one(x, i, tokens)))


_INSTANCES = "array<struct<s: int, e: int, match: string, context: string, kind: string>>"
_NONE, _LAST = -1, 2**31 - 1


def _instances(tokens: Column, kinds: dict[str, Column]) -> Column:
    """Seeds, the base spans that overlap none of an earlier kind, and runs of tokens outside base spans.

    Tokens (order 0, before spans that start with them) and the kinds' spans are sorted together;
    running maxima of ends and minima of starts, per kind and those before it, tell what overlaps.
    """
    n = len(KINDS)

    def part(found: Column, order: int) -> Column:
        return F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), i.alias("k")))

    parts = [part(tokens, 0), *[part(kinds[k], o) for o, k in enumerate(KINDS, 1)]]

    def among(x: Column, upto: int, value: Column, other: int) -> Column:
        return F.when((x["o"] > 0) & (x["o"] < upto), value).otherwise(F.lit(other))

    def place(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.struct(*[among(x, u, x["e"], _NONE).alias(f"c{u}") for u in range(2, n + 2)], F.when(x["o"] == 0, x["k"]).otherwise(F.lit(_NONE)).alias("token")))
        names = [f"c{u}" for u in range(2, n + 2)]
        before = _scan(ends, lambda x, y: F.struct(*[F.greatest(x[c], y[c]).alias(c) for c in (*names, "token")]))
        starts = F.transform(F.reverse(every), lambda x: F.struct(*[among(x, u, x["s"], _LAST).alias(f"c{u}") for u in range(2, n + 2)]))
        after = _scan(starts, lambda x, y: F.struct(*[F.least(x[c], y[c]).alias(c) for c in names]))

        def one(x: Column, i: Column, b: Column) -> Column:
            def covered(upto: int) -> Column:
                return (F.get(b["before"], i)[f"c{upto}"] > x["s"]) | (F.get(b["after"], F.size(every) - 1 - i)[f"c{upto}"] < x["e"])

            clash = F.when(x["o"] == 0, covered(n + 1))
            for o in range(2, n + 1):
                clash = clash.when(x["o"] == o, covered(o))
            return F.struct(*[x[c].alias(c) for c in "soek"], F.get(b["before"], i)["token"].alias("token"), clash.otherwise(F.lit(False)).alias("clash"))

        return _bound(F.struct(before.alias("before"), after.alias("after")), lambda b: F.filter(F.transform(every, lambda x, i: one(x, i, b)), lambda x: ~x["clash"]))

    def seed(x: Column) -> Column:
        match, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for o, k in enumerate(KINDS, 1):
            match = F.when(x["o"] == o, F.get(kinds[k], x["k"])["match"]).otherwise(match)
            name = F.when(x["o"] == o, F.lit(k)).otherwise(name)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), match.alias("match"), F.get(tokens, x["token"])["context"].alias("context"), name.alias("kind"))

    def run(free: Column, i: Column, j: Column) -> Column:
        first = F.get(tokens, F.get(free, i)["k"])
        match = F.array_join(F.transform(F.slice(free, i + 1, j - i), lambda y: F.get(tokens, y["k"])["match"]), " ")
        return F.struct(first["s"].alias("s"), F.get(free, j - 1)["e"].alias("e"), match.alias("match"), first["context"].alias("context"), F.lit(None).cast("string").alias("kind"))

    def runs(free: Column) -> Column:
        starts = F.filter(F.transform(free, lambda x, i: F.when((i > 0) & F.get(tokens, x["k"])["adjacent"] & (F.get(free, i - 1)["k"] == x["k"] - 1), F.lit(_NONE)).otherwise(i)), lambda i: i >= 0)
        return _bound(starts, lambda at: F.transform(at, lambda i, k: run(free, i, F.coalesce(F.get(at, k + 1), F.size(free)))))

    def both(placed: Column) -> Column:
        return F.concat(F.transform(F.filter(placed, lambda x: x["o"] > 0), seed), _bound(F.filter(placed, lambda x: x["o"] == 0), runs))

    return _bound(_bound(F.sort_array(F.concat(*parts)), place), both)


def base_spans(text: Column) -> Column:
    """Per text a struct: the base spans (s, e, match) of each kind, and its instances (s, e, match, context, kind)."""

    def of(b: Column) -> Column:
        kinds = {k: b[k] for k in KINDS}
        instances = F.when(F.size(b["token"]) > 0, _instances(b["token"], kinds)).otherwise(F.array().cast(_INSTANCES))
        return F.struct(*[F.transform(b[k], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS], F.filter(instances, lambda x: x["context"] != "").alias("instances"))

    found = F.struct(*[_kept(k, _spans(text, PATTERNS[k])).alias(k) for k in KINDS], _tokens(_spans(text, _TOKEN)).alias("token"))
    return _bound(found, of)


def candidates(spans: DataFrame) -> DataFrame:
    """(doc_id, h, context, instance, s, e, kind): instances in context; kind where they are base spans."""
    rows = spans.select("doc_id", "h", F.explode("found.instances").alias("x"))
    return rows.select("doc_id", "h", "x.context", F.lower("x.match").alias("instance"), "x.s", "x.e", "x.kind")


def confident_patterns(found: DataFrame, scratch: Scratch, *, rounds: int = 6, least_support: int = 5, least_confidence: float = 0.8) -> DataFrame:
    """(context, kind) of the patterns that end confident, by iterative scores on the pattern-instance graph."""
    edges = scratch.save("edges", found.groupBy("context", "instance").agg(F.max("kind").alias("seed")))
    seeds = scratch.save("seeds", edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0)))
    unseen = scratch.save("unseen", edges.join(seeds, "instance", "left_anti").select("context", "instance"))
    size = scratch.save("size", edges.groupBy("context").agg(F.count(F.lit(1)).alias("degree")))
    # what the seeds give is the same in every turn
    fixed = edges.join(seeds, "instance").groupBy("context", "kind").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("support"))
    fixed = scratch.save("fixed", fixed)
    degree = unseen.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    best, state, spread = F.max(F.struct("confidence", "support", "kind")), None, None
    for k in range(rounds):
        parts = fixed if spread is None else fixed.unionByName(unseen.join(spread, "instance").select("context", "kind", F.col("score").alias("total"), F.lit(0).cast("long").alias("support")))
        patterns = parts.groupBy("context", "kind").agg(F.sum("total").alias("total"), F.sum("support").alias("support")).join(size, "context")
        patterns = scratch.save(f"patterns-{k}", patterns.select("context", "kind", (F.col("total") / F.col("degree")).alias("confidence"), "support"))
        confident = patterns.where((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence)).groupBy("context").agg(best["kind"].alias("kind"))
        before, state = state, tuple(confident.agg(F.count(F.lit(1)), F.sum(F.xxhash64("context", "kind").cast("decimal(38,0)"))).first())
        scratch.drop(f"patterns-{k - 1}", f"spread-{k - 1}")
        if state == before or not state[0]:
            break
        total = unseen.join(patterns, "context").groupBy("instance", "kind").agg(F.sum("confidence").alias("total"))
        spread = scratch.save(f"spread-{k}", total.join(degree, "instance").select("instance", "kind", (F.col("total") / F.col("n")).alias("score")))
    return confident


def discover(spans: DataFrame, scratch: Scratch, **options) -> DataFrame | None:
    """(doc_id, h, more): arrays of (kind, s, e) that confident patterns add; None where there are none."""
    found = scratch.save("found", candidates(spans))
    patterns = scratch.save("confident", confident_patterns(found, scratch, **options))
    if patterns.isEmpty():
        return None
    unseen = found.where("kind is null").drop("kind").join(patterns, "context")
    return scratch.save("more", unseen.groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more")))


_MORE = "array<struct<kind: string, s: int, e: int>>"


def _with_more(spans: DataFrame, more: DataFrame | None) -> DataFrame:
    if more is None:
        return spans.withColumn("more", F.array().cast(_MORE))
    other = more.select(F.col("doc_id").alias("more_id"), F.col("h").alias("more_h"), "more")
    joined = spans.join(other, (spans["h"] == other["more_h"]) & spans["doc_id"].eqNullSafe(other["more_id"]), "left").drop("more_id", "more_h")
    return joined.withColumn("more", F.coalesce("more", F.array().cast(_MORE)))


def _all_of(kind: str, base: Column) -> Column:
    """Base and discovered spans of a kind as (s, e), sorted, each once."""
    more = F.transform(F.filter("more", lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return _bound(F.sort_array(F.concat(base, more)), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def _told(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _text(name: Column) -> Column:
    return F.coalesce(name.cast("string"), F.lit(""))


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    scratch = Scratch(docs.sparkSession, "pii")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(F.col("text")).alias("text"))
    spans = scratch.save("spans", picked.select("doc_id", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("found")))
    told = _with_more(spans, discover(spans, scratch, **options))
    base = F.array_join(F.concat(*[_told(F.col(f"found.{k}"), k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_told(_all_of(k, F.col(f"found.{k}")), k) for k in KINDS]), ",")
    return told.select("doc_id", *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


_BLOCK = 1024


def _masked(text: Column, spans: Column) -> Column:
    """The text with each maximal union of spans (s, e, kind), sorted, replaced by the first one's kind.

    The text is cut from blocks of ``_BLOCK`` code points, as finding a place in a string takes
    time in proportion to what lies before it.
    """

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first, last = (a / _BLOCK).cast("int"), (b / _BLOCK).cast("int")
        one = F.substr(F.get(blocks, first), a % _BLOCK + 1, b - a)
        many = F.concat(F.substr(F.get(blocks, first), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.coalesce(F.substr(F.get(blocks, last), F.lit(1), b % _BLOCK), F.lit("")))
        return F.coalesce(F.when(first == last, one).otherwise(many), F.lit(""))

    def of(b: Column) -> Column:
        spans, blocks, ends = b["spans"], b["blocks"], b["ends"]
        upto = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda x, i: F.when(x["s"] >= upto(i), F.concat(cut(blocks, upto(i), x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit("")))
        end = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(pieces, ""), cut(blocks, end, b["n"]))

    def bind(every: Column) -> Column:
        ends = _scan(F.transform(every, lambda x: x["e"]), F.greatest)
        return _bound(F.struct(every.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"), ends.alias("ends"), F.length(text).alias("n")), of)

    return _bound(spans, bind)


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents, own columns only, with every span replaced by its kind in brackets; overlapping spans become one."""
    scratch = Scratch(docs.sparkSession, "pii")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").alias("doc_id"), _text(F.col("text")).alias("text"))
    wide = wide.withColumn("h", F.xxhash64("text"))
    spans = wide.select("doc_id", "h", base_spans(F.col("text")).alias("found"))
    some = " or ".join(f"size(found.{k}) > 0" for k in (*KINDS, "instances"))
    kept = scratch.save("spans", spans.where(some))
    more = discover(kept, scratch, **options)
    every = _with_more(kept.dropDuplicates(["doc_id", "h"]), more).select(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), F.sort_array(F.concat(*[_tagged(_all_of(k, F.col(f"found.{k}")), k) for k in KINDS])).alias("spans"))
    every = scratch.save("every", every.where("size(spans) > 0"))
    # a merge join at every size: the documents with spans may be any share of all
    joined = wide.join(every.hint("merge"), (wide["h"] == every["of_h"]) & wide["doc_id"].eqNullSafe(every["of_id"]), "left")
    new = F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans"))).otherwise(F.col("own.text"))
    out = joined.select("own", new.alias("new"))
    columns = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        value = F.col("new") if c == "text" else F.length("new").cast(kind) if c == "n_chars" else F.col("own")[c]
        columns.append(value.alias(c))
    return out.select(*columns)
