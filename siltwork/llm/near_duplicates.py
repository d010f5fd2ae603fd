"""Near-duplicate documents by MinHash bands, odd sketches and confirmation on full sets.

A document's set holds its distinct 5-word shingles.  MinHash samples under 120 functions give bands
of rows; the bottom-k sample under one function folds into an odd sketch: each sample toggles one
bit of a bitmap, so that the population count of two sketches' XOR estimates high similarities
closely (Mitzenmacher, Pagh and Pham, 2014).  A set of at most k shingles is its own sample; then
the count never exceeds the number of shingles that differ, and the sketch drops no link.

1. Documents with equal sets are one class; only classes go on.
2. Each band's bucket links its members to the member with the smallest hash: as many candidates as
   members, whatever the bucket's size.  Sketches and set sizes drop most false ones; the others
   are confirmed on their full sets, and connected.
3. Buckets that still hold several components are open.  Their members outside the bucket's main
   component visit all chunks of the bucket's members, and each pair of different components that
   passes by sketch is confirmed there on its full sets, in the first band that it shares.  A task
   joins what it links at once and sends out only links between different components: a forest, no
   more rows than members.  So every pair that shares a bucket is either connected or compared, and
   no bucket is capped.

With 24 bands of 5 rows a pair of similarity 0.85 shares no bucket with probability below 1e-6.
Where a set has more than 1024 shingles, its sketch is of a sample: the bound then lies five
deviations out, and drops a link of similarity 0.85 with a probability of the same order.

Defined cases: null and empty texts, and those of white space only, have the empty set and link with
nothing; fewer words than a shingle are one shingle; a null doc_id keeps its row and links with
nothing; rows that repeat a doc_id share a component where any of them links, and each class of equal
sets is compared once however many rows have it; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.chunks import RunCache, hash_code, mix, parts
from siltwork.llm.common import Scratch, record, text_or_empty
from siltwork.llm.components import components

BANDS, ROWS, BITS, BOTTOM = 24, 5, 1024, 1024
_SAMPLES = BANDS * ROWS
_RNG = np.random.default_rng(90_210)
_FACTORS = _RNG.integers(0, 1 << 64, _SAMPLES, np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted, from the hashes of the words in order."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _PLACES[j]
    return np.unique(mix(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    """One sample per hash function: the least upper half of the products."""
    least = np.full(_SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(least, (found[k : k + 2048, None] * _FACTORS).min(0), out=least)
    return least >> np.uint64(32)


def bands(samples: np.ndarray) -> np.ndarray:
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for column in samples.reshape(BANDS, ROWS).T:
        total = mix(total ^ column)
    return total.view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bitmap of the parity of the bottom-k sample, from the sorted shingle hashes."""
    place = mix(found[:BOTTOM] ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    parity = (np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_differing(sizes, other, percent: int, m=np, deviations: float = 5.0):
    """Largest XOR population count that a linked pair of sets of these sizes has.

    Exact where both sets are their own sample, else short of so many deviations.  ``m`` has the
    functions: numpy's, or those of columns.
    """
    shared = m.ceil(percent * (sizes + other) / (100 + percent))
    exact = sizes + other - 2 * shared
    large = m.maximum(sizes, other)
    share = shared / large
    differ = m.minimum(sizes, BOTTOM) + m.minimum(other, BOTTOM) - 2 * BOTTOM * share + 2 * deviations * m.sqrt(2 * BOTTOM * m.maximum(share * (1 - share), 0.0))
    sampled = m.minimum(differ, BITS / 2 * (1 - m.exp(-2 / BITS * differ)) + 16)
    return m.where(large <= BOTTOM, exact, sampled)


class _Columns:
    ceil, sqrt, exp = F.ceil, F.sqrt, F.exp
    minimum = staticmethod(lambda a, b: F.least(a, b if hasattr(b, "cast") else F.lit(b)))
    maximum = staticmethod(lambda a, b: F.greatest(a, b if hasattr(b, "cast") else F.lit(b)))
    where = staticmethod(lambda test, a, b: F.when(test, a).otherwise(b))


def word_hashes(cache: RunCache, texts: list[str]) -> list[np.ndarray]:
    runs = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    return [np.frombuffer(raw, ">u8").astype(np.uint64) for raw in cache.join(runs)]


def _digest(found: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set hash, bands and sketch (both empty for the empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = RunCache(hash_code)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in parts(map(len, texts), 1_000_000):
                n, hi, lo, keys, bits = [], [], [], [], []
                for words in word_hashes(cache, texts[part]):
                    found = shingles(words, size)
                    digest = _digest(found)
                    n.append(len(found))
                    hi.append(digest[0])
                    lo.append(digest[1])
                    keys.append(bands(minhashes(found)) if len(found) else [])
                    bits.append(odd_sketch(found) if len(found) else [])
                yield record(schema, {"doc_id": batch.column(0)[part], "n_shingles": n, "hi": hi, "lo": lo, "bands": keys, "sketch": bits})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(hi, lo, shingles): each distinct set once, its sorted hashes as bytes."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = RunCache(hash_code)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in parts(map(len, texts), 1_000_000):
                sets = [shingles(words, size) for words in word_hashes(cache, texts[part])]
                digests = [_digest(s) for s in sets]
                yield record(schema, {"hi": [d[0] for d in digests], "lo": [d[1] for d in digests], "shingles": [s.tobytes() for s in sets]})

    found = docs.select("text").mapInArrow(run, "hi long, lo long, shingles binary")
    return found.groupBy("hi", "lo").agg(F.first("shingles").alias("shingles"))


class _Labels:
    """Union-find over component labels, as one task has seen them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while root in self.up:
            root = self.up[root]
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> None:
        self.up[x] = y


class _Chunk:
    """The homes of one chunk: an inverted index of their full sets, against which visitors come one by one."""

    def __init__(self, labels: _Labels, percent: int):
        self.labels, self.percent, self.homes, self.ready = labels, percent, [], False

    def add(self, row: tuple) -> None:
        self.homes.append(row)

    def _prepare(self) -> None:
        rep, label, n, sketch, bands, sets = zip(*self.homes)
        self.rep, self.n, self.sketch, self.bands = np.asarray(rep), np.asarray(n), np.stack(sketch), np.stack(bands)
        self.label = np.asarray([self.labels.find(x) for x in label])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(rep)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.known, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))
        self.homes, self.ready = [], True

    def _shared(self, found: np.ndarray) -> np.ndarray:
        """How many shingles each home shares with a visitor's set."""
        at = np.searchsorted(self.known, found)
        at[at == len(self.known)] = 0
        at = at[self.known[at] == found]
        low, times = self.starts[at], self.ends[at] - self.starts[at]
        places = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        return np.bincount(self.owner[places], minlength=len(self.rep))

    def visit(self, row: tuple, band: int) -> list[tuple[int, int]]:
        """Links that join the visitor's component to others; ``band`` is the bucket's own, -1 where pairs come but once."""
        if not self.ready:
            if not self.homes:
                return []
            self._prepare()
        rep, label, n, sketch, bands, found = row
        label = self.labels.find(label)
        at = np.flatnonzero((self.label != label) & (100 * np.minimum(n, self.n) >= self.percent * np.maximum(n, self.n)))
        if len(at):
            at = at[np.bitwise_count(self.sketch[at] ^ sketch).sum(1) <= most_differing(np.full(len(at), n), self.n[at], self.percent)]
        if len(at) and band > 0:
            at = at[~(self.bands[at, :band] == bands[:band]).any(1)]
        if not len(at):
            return []
        both = self._shared(found)[at]
        at = at[100 * both >= self.percent * (n + self.n[at] - both)]
        out = []
        for k in at.tolist():
            if self.label[k] != label:
                out.append((rep, int(self.rep[k])))
                old = int(self.label[k])
                self.labels.join(old, label)
                self.label[self.label == old] = label
        return out


_MEMBER = "rep long, label long, n long, sketch array<long>, bands array<long>, shingles binary"


def _linked(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v) links between homes and visitors of each (g, chunk) of different components; a forest per task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, labels = None, None, _Labels()
        for batch in batches:
            if not batch.num_rows:
                continue
            g, number, role, band, rep, label, n = (batch.column(i).to_pylist() for i in range(7))
            sketch = batch.column(7).flatten().to_numpy().reshape(-1, BITS // 64).view(np.uint64)
            keys = batch.column(8).flatten().to_numpy().reshape(-1, BANDS)
            links = []
            for k in range(batch.num_rows):
                if (g[k], number[k]) != now:
                    if len(labels.up) > 1_000_000:
                        labels = _Labels()
                    now, chunk = (g[k], number[k]), _Chunk(labels, percent)
                row = rep[k], label[k], n[k], sketch[k], keys[k], np.frombuffer(batch.column(9)[k].as_buffer(), np.uint64)
                if role[k] == 0:
                    chunk.add(row)
                else:
                    links += chunk.visit(row, band[k])
            if links:
                u, v = zip(*links)
                yield record(schema, {"u": u, "v": v})

    rows = dealt.select("g", "chunk", "role", "band", "rep", "label", "n", "sketch", "bands", "shingles")
    return rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "role").mapInArrow(run, "u long, v long")


def _differing(left: str, right: str):
    return sum(F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(BITS // 64))


def _chunks(chunk_rows: int, chunk_shingles: int):
    """Number of chunks of a group with columns m (members) and t (their shingles)."""
    return F.greatest(F.ceil(F.col("m") / chunk_rows), F.ceil(F.col("t") / chunk_shingles), F.lit(1)).cast("int")


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 85, chunk_rows: int = 2048, chunk_shingles: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch = Scratch(documents.sparkSession, "near")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    signed = scratch.save("signed", signatures(docs, shingle))
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    picked = signed.where(usable)
    classes = picked.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.save("classes", classes)
    own_chunk = F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("int").alias("chunk")

    rows = classes.select(F.posexplode("bands").alias("band", "bucket"), "hi", "lo", "rep", "n")
    order = F.struct(F.xxhash64("hi", "lo").alias("o"), "hi", "lo")
    leaders = rows.groupBy("bucket").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    leaders = scratch.save("leaders", leaders.select("bucket", "m", F.col("x.hi").alias("a_hi"), F.col("x.lo").alias("a_lo")))
    # full sets of the classes that share a bucket, from one row's text each; by merge join at every size, as they may be any share of all
    wanted = classes.join(rows.join(leaders.select("bucket"), "bucket").select("hi", "lo").distinct(), ["hi", "lo"], "left_semi")
    wanted = scratch.save("wanted", wanted)
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = scratch.save("sets", full_sets(texts, shingle).join(wanted.hint("merge"), ["hi", "lo"]))
    scratch.drop("wanted")
    stars = rows.join(leaders, "bucket").where("hi <> a_hi or lo <> a_lo").select("a_hi", "a_lo", "hi", "lo").distinct()
    side = lambda x: classes.select(F.col("hi").alias(f"{x}hi"), F.col("lo").alias(f"{x}lo"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    close = (100 * F.least("n_a_", "n_") >= percent * F.greatest("n_a_", "n_")) & (_differing("s_a_", "s_") <= most_differing(F.col("n_a_"), F.col("n_"), percent, _Columns))
    stars = stars.join(side(""), ["hi", "lo"]).join(side("a_"), ["a_hi", "a_lo"]).where(close)
    stars = scratch.save("stars", stars.select("a_hi", "a_lo", "hi", "lo", F.col("n_").alias("n")))

    sizes = stars.groupBy("a_hi", "a_lo").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    sizes = scratch.save("star-sizes", sizes.select("a_hi", "a_lo", _chunks(chunk_rows, chunk_shingles).alias("chunks")))
    leader = F.xxhash64("a_hi", "a_lo").alias("g")
    homes = sizes.select(leader, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.lit(-1).alias("band"), F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"))
    visitors = stars.join(sizes, ["a_hi", "a_lo"]).select(leader, own_chunk, F.lit(1).alias("role"), F.lit(-1).alias("band"), "hi", "lo")
    # a link of a bucket's star joins two classes whatever their components are, so labels are the classes' own
    dealt = sets.join(homes.unionByName(visitors).hint("merge"), ["hi", "lo"]).withColumn("label", F.xxhash64("hi", "lo"))
    links = scratch.save("star-links", _linked(dealt, percent).distinct())
    scratch.drop("stars", "star-sizes")
    labels = components(links, scratch, name="first")

    known = rows.join(leaders.where("m > 2").select("bucket"), "bucket").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    many = scratch.save("many", known.select("bucket", "band", "hi", "lo", "n", F.coalesce("component", "rep").alias("label")))
    unsettled = many.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_rows = scratch.save("open", many.join(unsettled, "bucket"))
    scratch.drop("many")
    if not open_rows.isEmpty():
        by_label = open_rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
        main = by_label.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("t").alias("t"), F.max(F.struct("c", "label"))["label"].alias("main"))
        main = scratch.save("main", main.select("bucket", "main", _chunks(chunk_rows, chunk_shingles).alias("chunks")))
        placed = open_rows.join(main, "bucket").withColumnRenamed("bucket", "g")
        columns = "band", "hi", "lo", "label"
        homes = placed.select("g", own_chunk, F.lit(0).alias("role"), *columns)
        visitors = placed.where("label <> main").select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), *columns)
        dealt = sets.join(homes.unionByName(visitors).hint("merge"), ["hi", "lo"])
        more = scratch.save("more", _linked(dealt, percent).distinct())
        scratch.drop("main")
        edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        labels = components(edges, scratch, name="second")
    known = classes.select("hi", "lo", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.save("known", known.select("hi", "lo", F.coalesce("component", "rep").alias("component_id")))
    scratch.drop("classes", "leaders", "open", "star-links", "more", "sets")
    plain = signed.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = picked.join(known, ["hi", "lo"]).select("doc_id", "n_shingles", "component_id").unionByName(plain)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that are the first of their component; repeated ids stay once each row."""
    dropped = near_duplicates(docs, **options).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
