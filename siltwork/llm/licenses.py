"""Licence scans by sparse TF-IDF cosine to templates, then inheritance down the directory tree.

Templates are the full texts, file headers, titles, statements and SPDX tags of ``licence_texts``.
A file's units are its lines, its sentences, its paragraphs (parted by lines without letters or
digits, so that comment marks do not matter) and its stretches of adjacent paragraphs that may
belong to a licence: a header, or the whole of a licence file.  The best unit decides.

Weights are term frequency times inverse document frequency over all files.  A term that no template
has weighs as if no file held it, so a text that merely mentions a licence stays below the
threshold.  By the prefix-filtering principle a unit can only reach the threshold if it holds one of
a template's anchor terms, its rarest ones that carry enough of its weight; nothing else is taken
apart.  Each distinct unit is scored once, under a hash of its words, so a header that thousands of
files repeat costs as much as one.  The template table, whose size is fixed with the templates, is
all that is broadcast or collected.

A file without a licence of its own inherits that of the nearest ancestor directory with a licence
file (LICENSE, COPYING, ...).  The join is between directories, grouped before, so that files are
only joined with their own.

Defined cases: rows that share id and path count as one file, with the best of their licences; null
text has no units and may only inherit; a null path is in the root; a unit that equals templates
of several licences has the first name, equal scores of units go to the first name, and those of a
directory's files to the first path; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch
from siltwork.llm.licence_texts import forms

LEAST = 0.75
_APART = "[^a-z0-9]+"


def terms_of(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _APART, -1), "")


class Templates:
    """Unit vectors of all forms for given document frequencies, and their anchor terms."""

    def __init__(self, texts: dict[str, list[str]], files: int, frequency: dict[str, int], least: float = LEAST):
        self.names = [n for n, t in sorted(texts.items()) for _ in t]
        counts = [terms_of(x) for _, t in sorted(texts.items()) for x in t]
        self.unseen = math.log(1 + files) + 1
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for c in counts for t in c}
        self.units = []
        for c in counts:
            raw = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.units.append({t: x / norm for t, x in raw.items()})
        self.anchors = sorted({t for u in self.units for t in self._rarest(u, least)})

    def _rarest(self, unit: dict[str, float], least: float) -> list[str]:
        """The rarest terms without which a cosine stays below the threshold."""
        out, rest = [], 1.0
        for term, w in sorted(unit.items(), key=lambda x: (-self.idf[x[0]], -x[1], x[0])):
            if rest < least * least * (1 - 1e-9):
                break
            out.append(term)
            rest -= w * w
        return out

    def rows(self) -> list[tuple]:
        held: dict[str, list[tuple[int, float]]] = {t: [] for t in self.idf}
        for k, unit in enumerate(self.units):
            for t, w in unit.items():
                held[t].append((k, w))
        return [(t, w, held[t]) for t, w in sorted(self.idf.items())]


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files with each template term; at most as many rows as terms reach the driver."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    found = F.concat(F.array_intersect(words(F.coalesce(F.col("text").cast("string"), F.lit(""))), known), F.array(F.lit("")))
    counts = {r.term: r.n for r in files.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def units_of(text: Column, anchors: list[str]) -> Column:
    """The words, joined by blanks, of every distinct line, sentence, paragraph and stretch with an anchor."""
    known = F.array(*[F.lit(t) for t in anchors])

    def may(x: Column) -> Column:
        return F.arrays_overlap(words(x), known)

    def stretches(flagged: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(flagged) - 1)
        on = lambda i: F.coalesce(F.get(flagged, i)["may"], F.lit(False))
        starts, ends = F.filter(index, lambda i: on(i) & ~on(i - 1)), F.filter(index, lambda i: on(i) & ~on(i + 1))
        return F.zip_with(starts, ends, lambda s, e: F.array_join(F.transform(F.slice(flagged, s + 1, e - s + 1), lambda x: x["text"]), "\n"))

    paragraphs = F.transform(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*+\n)++", -1), lambda x: F.struct(x.alias("text"), may(x).alias("may")))

    def all_units(flagged: Column) -> Column:
        whole = F.transform(F.filter(flagged, lambda x: x["may"]), lambda x: x["text"])
        sentences = F.filter(F.flatten(F.transform(whole, lambda x: F.split(x, r"(?<=[.!?])\s+", -1))), may)
        return F.concat(F.filter(F.split(text, "\n", -1), may), sentences, whole, stretches(flagged))

    # the flagged paragraphs are bound once, as a lambda's argument
    units = F.flatten(F.transform(F.array(paragraphs), all_units))
    return F.when(may(text), F.array_distinct(F.transform(units, lambda x: F.array_join(words(x), " "))))


def unit_scores(units: DataFrame, templates: Templates, least: float) -> DataFrame:
    """(k1, k2, licence, score) of the units (k1, k2, unit) that reach the threshold, with their best form."""
    table = units.sparkSession.createDataFrame(templates.rows(), "term string, idf double, held array<struct<k: int, w: double>>")
    keys = "k1", "k2"
    terms = units.select(*keys, F.explode(F.split("unit", " ", -1)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    own = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("w")))
    weighed = terms.join(F.broadcast(table), "term", "left").select(*keys, (F.col("tf") * F.coalesce("idf", F.lit(templates.unseen))).alias("w"), F.explode(F.concat(own, F.coalesce("held", F.array().cast("array<struct<k: int, w: double>>")))).alias("x"))
    sums = weighed.groupBy(*keys, "x.k").agg(F.sum(F.col("w") * F.when(F.col("x.k") < 0, F.col("w")).otherwise(F.col("x.w"))).alias("total"))
    best = sums.groupBy(*keys).agg(F.sqrt(F.max(F.when(F.col("k") < 0, F.col("total")))).alias("norm"), F.max(F.when(F.col("k") >= 0, F.struct(F.round("total", 9).alias("dot"), -F.col("k")))).alias("x"))
    scored = best.select(*keys, F.get(F.array(*[F.lit(n) for n in templates.names]), -F.col("x.col2")).alias("licence"), F.round(F.col("x.dot") / F.col("norm"), 6).alias("score"))
    return scored.where(F.col("score") >= least)


def scan(files: DataFrame, scratch: Scratch, *, texts: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(id, path, dir, licence, score): each file's own licence, null where no unit reaches the threshold."""
    texts = texts or forms()
    templates = Templates(texts, *frequencies(files, sorted({t for f in texts.values() for x in f for t in terms_of(x)})), least)
    path = F.concat(F.lit("/"), F.regexp_replace(F.coalesce(F.col("path").cast("string"), F.lit("")), "^/+", ""))
    units = units_of(F.coalesce(F.col("text").cast("string"), F.lit("")), templates.anchors)
    rows = scratch.save("units", files.select("id", path.alias("path"), units.alias("units")).withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")))
    held = rows.where(F.size("units") > 0).select("id", "path", F.explode("units").alias("unit")).select("id", "path", "unit", F.xxhash64("unit").alias("k1"), F.hash("unit").alias("k2"))
    scored = scratch.save("scored", unit_scores(held.groupBy("k1", "k2").agg(F.first("unit").alias("unit")), templates, least))
    best = held.drop("unit").join(scored, ["k1", "k2"]).groupBy("id", "path").agg(F.min(F.struct(-F.col("score"), "licence")).alias("best"))
    best = scratch.save("best", best.select(F.col("id").alias("of_id"), F.col("path").alias("of_path"), F.col("best.licence").alias("licence"), (-F.col("best.col1")).alias("score")))
    rows = rows.select("id", "path", "dir")
    joined = rows.join(best, rows["id"].eqNullSafe(best["of_id"]) & (rows["path"] == best["of_path"]), "left")
    return joined.select("id", "path", "dir", "licence", "score")


_LICENCE_FILE = r"(?i)/(?:licen[cs]e|copying|notice|unlicense)[^/]*$"


def inherit(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds how ('header', 'inherited' or null) and from_path; files named as licence files speak for their directory."""
    speaks = scanned.where("licence is not null").where(F.col("path").rlike(_LICENCE_FILE))
    first = F.min(F.struct("path", "licence", "score"))
    licensed = scratch.save("licensed", speaks.groupBy("dir").agg(first.alias("x")).select(F.col("dir").alias("ancestor"), F.col("x.path").alias("from_path"), F.col("x.licence").alias("up_licence"), F.col("x.score").alias("up_score")))
    parts = F.split("dir", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = scanned.where("licence is null").select("dir").distinct().select("dir", F.explode(ancestors).alias("ancestor"))
    nearest = dirs.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "from_path", "up_licence", "up_score")).alias("x"))
    nearest = scratch.save("nearest", nearest.select("dir", "x.from_path", "x.up_licence", "x.up_score"))
    joined = scanned.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return joined.select("id", "path", F.coalesce("licence", "up_licence").alias("licence"), F.when(own, "header").when(F.col("up_licence").isNotNull(), "inherited").alias("how"), F.coalesce("score", "up_score").alias("score"), F.when(own, F.col("path")).otherwise(F.col("from_path")).alias("from_path"))


def licences(files: DataFrame, *, texts: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """id, path, licence, how, score and from_path of every file (columns id, path, text)."""
    scratch = Scratch(files.sparkSession, "licences")
    scanned = scratch.save("scanned", scan(files, scratch, texts=texts, least=least))
    scratch.drop("units", "scored", "best")
    return inherit(scanned, scratch)
