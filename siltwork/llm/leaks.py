"""Benchmark decontamination by suffix arrays over shards of the training text.

Every shard, some megabytes of consecutive documents, gets the suffix array of all its words, whole
suffixes in order, by prefix doubling in which only groups that still tie are sorted again.
Documents end with signs of their own, so no match crosses them.  Every benchmark suffix is
binary-searched in every shard: its neighbours there have its longest verbatim matches, and the
ranges of its first eight words are the places where a window occurs.  Of a training position that
begins a window the longest match is with one of the two benchmark suffixes next to it in order.
Work is in proportion to words, whatever repeats: a position belongs to one range only.

The benchmark is cut into blocks of at most ``block_bytes`` of text.  One block is broadcast; where
there are several, each pass is written before the next one, so that the driver and a task hold one
block at a time.  Documents are never shuffled.

Defined cases: null text or item has no words and matches nothing; an item of fewer than eight
words, but not none, is one window; repeated items and documents count each; an empty benchmark or
table leaves every document clean; texts of any length are processed whole; the added column takes
a name that the documents do not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, text_or_empty

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD_CHARS = 6_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ITEM_END = -(1 << 40)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(array, rank, pairs) of all suffixes of ``ids``: places in order, its inverse, and the sorted first two ids.

    A rank is the place of its group's first member until the group is resolved, so groups keep
    their slots while they are split.
    """
    n = len(ids)
    shifted = (ids - ids.min() + 1) if n else ids
    pairs = shifted << 32
    pairs[:-1] |= shifted[1:]
    array = np.argsort(pairs, kind="stable")
    keys = pairs[array]
    rank = np.empty(n, np.int64)
    slots, at, step = np.arange(n), array, 2
    while True:
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        begin = slots[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        rank[at] = begin
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = slots[~alone]
        if not len(slots):
            return array, rank, pairs[array]
        at = array[slots]
        follow = at + step
        keys = (rank[at] << 32) | np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        array[slots] = at
        step *= 2


class _Text:
    """Ids with an end sign after each document, and what comparisons need: words left, and hashes of prefixes."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.ids, self.ends = ids, ends
        self._hash = None

    def left(self, at: np.ndarray) -> np.ndarray:
        """Words from each place to its document's end."""
        return self.ends[np.searchsorted(self.ends, at)] - at

    def prefix_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._hash is None:
            powers = np.ones(len(self.ids) + 1, np.uint64)
            powers[1:] = _BASE
            powers = np.cumprod(powers)
            spread = (self.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
            total = np.zeros(len(self.ids) + 1, np.uint64)
            np.cumsum((spread ^ (spread >> np.uint64(29))) * powers[:-1], out=total[1:])
            self._hash = total, powers
        return self._hash


def common_words(a: _Text, i: np.ndarray, b: _Text, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each pair of suffixes: word by word, then by prefix hashes."""
    out = np.zeros(len(i), np.int64)
    act = np.arange(len(i))
    for _ in range(16):
        act = act[a.ids[i[act] + out[act]] == b.ids[j[act] + out[act]]]
        if not len(act):
            return out
        out[act] += 1
    i, j = i[act], j[act]
    (ha, pa_), (hb, pb) = a.prefix_hashes(), b.prefix_hashes()
    low, high = out[act], np.minimum(a.left(i), b.left(j))
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (ha[i + middle] - ha[i]) * pb[j] == (hb[j + middle] - hb[j]) * pa_[i]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    out[act] = low
    return out


def _joined(texts: list[np.ndarray], sign) -> _Text:
    """The texts one after the other; text k ends with ``sign(k)``."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    ids = np.empty(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    mask = np.ones(len(ids), bool)
    mask[ends] = False
    if len(texts):
        ids[mask] = np.concatenate(texts)
    ids[ends] = sign(np.arange(len(ends)))
    return _Text(ids, ends)


class Benchmark:
    """The test side: vocabulary, its suffixes in order, and its windows with the items that have them."""

    def __init__(self, items: list[tuple], window: int = 8):
        self.window = window
        self.item_ids = [None if i is None else str(i) for i, _ in items]
        split = [words_of(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(split))), 1)}
        ranked = [np.asarray([self.vocabulary[w] for w in t], np.int64) for t in split]
        order = _joined(ranked, lambda k: -1 - k)
        array = suffix_array(order.ids)[0] if len(order.ids) else np.zeros(0, np.int64)
        self.suffixes = array[order.ids[array] > 0]
        self.item_of = np.searchsorted(order.ends, self.suffixes)
        self.starts = np.concatenate([[0], order.ends + 1])[:-1] if len(order.ends) else np.zeros(0, np.int64)
        ids = order.ids.copy()
        ids[order.ends] = _ITEM_END
        self.text = _Text(ids, order.ends)
        self.beside = common_words(order, self.suffixes[:-1], order, self.suffixes[1:]) if len(self.suffixes) else np.zeros(0, np.int64)
        #: length: (distinct windows, where the items of each begin, the items)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for k, r in enumerate(ranked):
            size = min(window, len(r))
            if size:
                found.setdefault(size, []).append((k, np.lib.stride_tricks.sliding_window_view(r, size)))
        for size, parts in found.items():
            rows, which = np.unique(np.concatenate([v for _, v in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.repeat([k for k, _ in parts], [len(v) for _, v in parts])]), axis=1)
            self.windows[size] = rows, np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pairs[1]

    def tied(self, near: int, length: int) -> list[tuple[str, int]]:
        """(item, its start) of every suffix that shares ``length`` words with the one at ``near`` in order."""
        low = high = near
        while low > 0 and self.beside[low - 1] >= length:
            low -= 1
        while high < len(self.suffixes) - 1 and self.beside[high] >= length:
            high += 1
        return [(self.item_ids[k], int(s - self.starts[k])) for k, s in zip(self.item_of[low : high + 1].tolist(), self.suffixes[low : high + 1].tolist())]


class _Words:
    """Ids of words: the benchmark's own, then others as they come; emptied between shards when full."""

    def __init__(self, vocabulary: dict[bytes, int], limit: int = 300_000):
        self.base = {w: k.to_bytes(4, "little") for w, k in vocabulary.items()}
        self.limit = limit + len(self.base)
        self.known = dict(self.base)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self.known) > self.limit:
            self.known = dict(self.base)
        known = self.known
        for k, w in enumerate(set(chain.from_iterable(split)).difference(known), len(known) + 1):
            known[w] = k.to_bytes(4, "little")
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, t)), "<u4").astype(np.int64) for t in split]


class Shard:
    """The training side: some documents and the suffix array of all their words."""

    def __init__(self, texts: list[np.ndarray]):
        self.text = _joined(texts, lambda k: -1 - k)
        self.array, self.rank, self.pairs = suffix_array(self.text.ids)
        self.shift = 1 - int(self.text.ids.min())

    def _pair_range(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (first + self.shift) << 32 | np.maximum(second + self.shift, 0)
        return np.searchsorted(self.pairs, low, "left"), np.searchsorted(self.pairs, low, "right")

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) of every occurrence of the windows: their ranges in the array, narrowed word by word."""
        if rows.shape[1] == 1:
            first = (rows[:, 0] + self.shift) << 32
            low, high = np.searchsorted(self.pairs, first), np.searchsorted(self.pairs, first + (1 << 32))
        else:
            low, high = self._pair_range(rows[:, 0], rows[:, 1])
        which = np.flatnonzero(high > low)
        low, high = low[which], high[which]
        for d in range(2, rows.shape[1]):
            word = rows[which, d]
            low, high = self._bound(low, high, d, word), self._bound(low, high, d, word + 1)
            some = high > low
            which, low, high = which[some], low[some], high[some]
        times = high - low
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return self.array[np.repeat(low, times) + within], np.repeat(which, times)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """First slot of each range whose suffix has at least ``word`` at ``depth``."""
        low, high = low.copy(), high.copy()
        while True:
            act = np.flatnonzero(low < high)
            if not len(act):
                return low
            middle = (low[act] + high[act]) // 2
            less = self.text.ids[self.array[middle] + depth] < word[act]
            low[act[less]] = middle[less] + 1
            high[act[~less]] = middle[~less]

    def search(self, bench: Benchmark) -> np.ndarray:
        """Slot at which each benchmark suffix, in order, would stand: the first one not before it."""
        at, ids = bench.suffixes, bench.text.ids
        low, high = self._pair_range(ids[at], ids[at + 1])
        high = np.where(ids[at + 1] > 0, high, low)
        while True:
            act = np.flatnonzero(low < high)
            if not len(act):
                return low
            middle = (low[act] + high[act]) // 2
            i, j = at[act], self.array[middle]
            same = common_words(bench.text, i, self.text, j)
            less = self.text.ids[j + same] < ids[i + same]
            low[act[less]] = middle[less] + 1
            high[act[~less]] = middle[~less]

    def longest(self, bench: Benchmark, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, benchmark suffix) of the longest match at each place, by its two neighbours in order."""
        slots = self.search(bench)
        before = np.searchsorted(slots, self.rank[places], "right") - 1
        best, near = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for k in (before, before + 1):
            ok = np.flatnonzero((k >= 0) & (k < len(bench.suffixes)))
            length = common_words(self.text, places[ok], bench.text, bench.suffixes[k[ok]])
            better = length > best[ok]
            best[ok[better]], near[ok[better]] = length[better], k[ok[better]]
        return best, near


def _scan(bench: Benchmark, words: _Words, texts: list[str], with_matches: bool) -> list[dict]:
    """Per text: number of words, hit bitmap, items found, longest match, and all matches that no longer one holds."""
    ranked = words.ids(texts)
    out = [{"n_words": len(r), "hits": b"", "items": [], "longest": None, "matches": []} for r in ranked]
    if not any(map(len, ranked)) or not bench.windows:
        return out
    shard = Shard(ranked)
    ends = shard.text.ends
    starts = np.concatenate([[0], ends + 1])[:-1]
    hit = np.zeros(len(shard.text.ids) + 1, np.int64)
    for size, (rows, bounds, items) in sorted(bench.windows.items()):
        place, row = shard.windows(rows)
        if not len(place):
            continue
        np.add.at(hit, place, 1)
        np.add.at(hit, place + size, -1)
        doc = np.searchsorted(ends, place)
        seen = np.unique(doc * len(rows) + row)
        of, row_of = seen // len(rows), seen % len(rows)
        for d, r in zip(of.tolist(), row_of.tolist()):
            out[d]["items"].append(items[bounds[r] : bounds[r + 1]])
        if size == bench.window:
            place = np.sort(place)
            doc = np.searchsorted(ends, place)
            length, near = shard.longest(bench, place)
            head = np.ones(len(place), bool)
            head[1:] = (place[1:] != place[:-1] + 1) | (length[1:] > length[:-1] - 1)
            best = np.lexsort((place, -length, doc))
            best = best[np.unique(doc[best], return_index=True)[1]]
            for k in best.tolist():
                item, start = min(bench.tied(int(near[k]), int(length[k])), key=lambda x: (x[0] or "", x[1]))
                d = int(doc[k])
                out[d]["longest"] = {"n_words": int(length[k]), "doc_start": int(place[k] - starts[d]), "item_id": item, "item_start": start}
            for k in np.flatnonzero(head).tolist() if with_matches else ():
                d = int(doc[k])
                out[d]["matches"] += [{"n_words": int(length[k]), "doc_start": int(place[k] - starts[d]), "item_id": i, "item_start": s} for i, s in bench.tied(int(near[k]), int(length[k]))]
            continue
        # longer windows come later and replace what shorter items give
        order = np.lexsort((place, doc))
        first = order[np.unique(doc[order], return_index=True)[1]]
        for k in first.tolist():
            d, r = int(doc[k]), int(row[k])
            item = min((bench.item_ids[i] for i in items[bounds[r] : bounds[r + 1]].tolist()), key=lambda x: x or "")
            out[d]["longest"] = {"n_words": size, "doc_start": int(place[k] - starts[d]), "item_id": item, "item_start": 0}
        for p, r in zip(place.tolist(), row.tolist()) if with_matches else ():
            d = int(np.searchsorted(ends, p))
            out[d]["matches"] += [{"n_words": size, "doc_start": int(p - starts[d]), "item_id": bench.item_ids[i], "item_start": 0} for i in items[bounds[r] : bounds[r + 1]].tolist()]
    mask = np.cumsum(hit) > 0
    for d, state in enumerate(out):
        if state["items"]:
            state["hits"] = np.packbits(mask[starts[d] : ends[d]]).tobytes()
            state["items"] = [bench.item_ids[i] for i in np.unique(np.concatenate(state["items"])).tolist()]
    return out


_MATCH = pa.struct([("n_words", pa.int64()), ("doc_start", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])
_STATE = pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("longest", _MATCH), ("matches", pa.list_(_MATCH))])
_MATCH_SQL = "struct<n_words: bigint, doc_start: bigint, item_id: string, item_start: bigint>"
_STATE_SQL = f"struct<n_words: bigint, hits: binary, items: array<string>, longest: {_MATCH_SQL}, matches: array<{_MATCH_SQL}>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, block_bytes: int = 16 << 20, with_matches: bool = True) -> DataFrame:
    """Every row and column of ``docs`` plus ``leak``: its words, hit words (a bitmap), items, longest match and all matches."""
    name = "leak"
    while name in docs.columns:
        name += "_"
    spark, keep = docs.sparkSession, list(docs.columns)
    items = benchmark.select(F.col(item_col).alias("item"), text_or_empty(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    if n == 1:
        shared = spark.sparkContext.broadcast(Benchmark([(r.item, r.text) for r in items.toLocalIterator()], window))
        return _scan_step(docs, shared, keep, text_col, name, first=True, with_matches=with_matches)
    scratch, out = Scratch(spark, "leaks"), docs
    items = scratch.save("items", items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))))
    for k in range(n):
        shared = spark.sparkContext.broadcast(Benchmark([(r.item, r.text) for r in items.where(F.col("block") == k).toLocalIterator()], window))
        out = scratch.save(f"pass-{k}", _scan_step(out, shared, keep, text_col, name, first=k == 0, with_matches=with_matches))
        shared.destroy()
        scratch.drop(f"pass-{k - 1}")
    scratch.drop("items")
    return out


def _merged(old: dict, new: dict) -> dict:
    if old["hits"] and new["hits"]:
        new["hits"] = (np.frombuffer(old["hits"], np.uint8) | np.frombuffer(new["hits"], np.uint8)).tobytes()
    new["hits"] = new["hits"] or old["hits"]
    new["items"] = old["items"] + new["items"]
    new["matches"] = old["matches"] + new["matches"]
    found = [m for m in (old["longest"], new["longest"]) if m]
    new["longest"] = min(found, key=lambda m: (-m["n_words"], m["doc_start"], m["item_id"] or "", m["item_start"])) if found else None
    return new


def _scan_step(docs: DataFrame, shared, keep: list[str], text_col: str, name: str, first: bool, with_matches: bool) -> DataFrame:
    column = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        words = _Words(bench.vocabulary)
        for whole in batches:
            texts = whole.column(column).cast(pa.string()).to_pylist()
            before = None if first else whole.column(len(keep)).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < SHARD_CHARS:
                    size += len(texts[end] or "")
                    end += 1
                states = _scan(bench, words, texts[start:end], with_matches)
                if before is not None:
                    states = [_merged(before[start + d], state) for d, state in enumerate(states)]
                part = whole.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(states, _STATE)], names=[*keep, name])
                start = end

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(keep)])
    return docs.mapInArrow(run, f"{fields}, `{name}` {_STATE_SQL}")


def contamination(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """The per-document digest: n_words, n_hit, n_items, items_sha256, contaminated; length and place of the longest match."""
    found = find_leaks(docs, benchmark, with_matches=False, **options)
    leak = F.col(f"`{found.columns[-1]}`")
    rest = [F.col(f"`{c}`") for c in found.columns[:-1]]
    bits = F.hex(leak["hits"])
    # a set bit per hit word: the digits of the bitmap's hexadecimal form, counted by weight
    n_hit = sum((F.length(bits) - F.length(F.regexp_replace(bits, f"[{digits}]", ""))) * w for w, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")))
    items = F.array_sort(leak["items"])
    return found.select(*rest, leak["n_words"].alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",", ""), 256).alias("items_sha256"), (F.size(items) >= min_items).alias("contaminated"), F.coalesce(leak["longest"]["n_words"], F.lit(0)).alias("longest_words"), leak["longest"]["doc_start"].alias("longest_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_items: int = 2, least_words: int | None = None, **options) -> DataFrame:
    """The documents, with their own columns, that hold windows of fewer than ``min_items`` items and no match of ``least_words``."""
    found = find_leaks(docs, benchmark, with_matches=False, **options)
    leak = F.col(f"`{found.columns[-1]}`")
    clean = F.size(leak["items"]) < min_items
    if least_words is not None:
        clean = clean & (F.coalesce(leak["longest"]["n_words"], F.lit(0)) < least_words)
    return found.where(clean).drop(found.columns[-1])
