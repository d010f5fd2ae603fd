"""Sum-of-squares online packing of token sequences into fixed windows.

A document longer than the window fills whole windows of its own; what remains is placed online
into the fill level that minimises the sum of squared counts of partially filled windows, as
tracked in a level array.  Each task packs its own partition in one pass, so there is no shuffle.
When a partition ends (or too many windows are open) the open windows are closed by cutting pieces
at window borders; the last one is cut into powers of two, which are not padded.

Defined cases: null text is empty; an empty text still has its end id; texts of any length are
processed whole; repeated rows are packed once each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.chunks import parts
from siltwork.llm.common import record, text_or_empty
from siltwork.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Online packing state: ``level[h]`` counts the open windows filled up to ``h``."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[int]] = {}
        self.n_open = 0

    def choose(self, size: int) -> int:
        """Level (0: a new window) where ``size`` more makes the least sum of squares; ties go to the fullest."""
        last = self.window - size
        before = self.level[: last + 1]
        after = 2 * self.level[size : self.window + 1] + 1
        after[-1] = 0
        cost = after - (2 * before - 1)
        cost[0] = after[0]
        cost[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def place(self, size: int, new_window) -> tuple[int, int]:
        """(window, offset) for a piece of 0 < size <= window."""
        h = self.choose(size)
        if h:
            self.level[h] -= 1
            self.n_open -= 1
            found = self.at[h].pop()
        else:
            found = new_window()
        full = h + size
        if full < self.window:
            self.level[full] += 1
            self.n_open += 1
            self.at.setdefault(full, []).append(found)
        return found, h


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Task:
    """Packing of one partition; rows of full windows leave at once, rows of open ones are held."""

    def __init__(self, window: int, base: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.next_id = base
        self.packer = LevelPacker(window)
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def new_window(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def emit(self, doc, start, ids: np.ndarray, total, window, offset) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, window, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.emit(doc, start, ids[start : start + self.window], total, self.new_window(), 0)
        if whole == total:
            return
        rest = ids[whole:]
        window, offset = self.packer.place(len(rest), self.new_window)
        held = self.open.setdefault(window, [])
        held.append((doc, whole, rest, total))
        if offset + len(rest) == self.window:
            self.close(window)
        elif self.packer.n_open > self.max_open:
            self.close_all(last=False)

    def close(self, window: int) -> None:
        offset = 0
        for doc, start, ids, total in self.open.pop(window):
            self.emit(doc, start, ids, total, window, offset)
            offset += len(ids)

    def close_all(self, last: bool) -> None:
        """Close open windows, fullest first, by cutting what follows at their borders."""
        sizes = {w: sum(len(p[2]) for p in held) for w, held in self.open.items()}
        pieces = [p for w in sorted(sizes, key=lambda w: (-sizes[w], w)) for p in self.open[w]]
        left = sum(sizes.values())
        self.open, self.packer = {}, LevelPacker(self.window)
        targets = [self.window] * (left // self.window) + (_powers(left % self.window) if last else [left % self.window])
        k, window, offset = 0, None, 0
        for doc, start, ids, total in pieces:
            done = 0
            while done < len(ids):
                if window is None:
                    window, offset = self.new_window(), 0
                take = min(len(ids) - done, targets[k] - offset)
                part = ids[done : done + take]
                if targets[k] < self.window and not last:
                    self.open.setdefault(window, []).append((doc, start + done, part, total))
                else:
                    self.emit(doc, start + done, part, total, window, offset)
                offset, done = offset + take, done + take
                if offset == targets[k]:
                    k, window = k + 1, None
        if self.open:
            (kept, held) = next(iter(self.open.items()))
            fill = sum(len(p[2]) for p in held)
            self.packer.level[fill] = self.packer.n_open = 1
            self.packer.at[fill] = [kept]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, max_open: int = 4096) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    ``max_open`` bounds a task's memory to ``max_open * window`` ids; beyond it open windows are
    closed early.  Sequence ids are unique across tasks: the partition number is the high half.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer.of_process(tokenizer_path)
        task = _Task(window, TaskContext.get().partitionId() << 32, max_open)
        end = np.asarray([end_id], "<u4").tobytes()

        def flush():
            columns = list(zip(*task.rows)) or [()] * len(names)
            task.rows = []
            return record(schema, dict(zip(names, columns)))

        for batch in batches:
            docs_in, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts(map(len, texts), 1_000_000):
                for doc, raw in zip(docs_in[part], tokenizer.raw(texts[part])):
                    task.add(doc, np.frombuffer(raw + end, "<u4"))
                if len(task.rows) >= 20_000:
                    yield flush()
        tokenizer.forget()
        task.close_all(last=True)
        if task.rows:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, SCHEMA)
