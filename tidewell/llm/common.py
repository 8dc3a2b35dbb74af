"""Shared pieces: Arrow text access, vectorised word splitting and hashing in numpy.

Words are the maximal runs of characters other than space and U+0009..U+000D.
Those separators are single bytes that never occur inside a longer UTF-8
sequence, so all splitting works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewell.session import ship

#: Bytes of text handled by one round of numpy work; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte; an odd base for polynomial hashes and its inverse.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Base for hashes of word sequences.
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` text bytes each; a longer text stands alone."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    n, at = batch.num_rows, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a run of texts: byte spans, the words of each text, 64-bit word hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = ~_SEPARATOR[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True  # a text starts here, so the byte before is of another text
        if n:
            before = np.empty(n, dtype=bool)
            before[0] = False
            before[1:] = inside[:-1]
            self.start = np.flatnonzero(inside & (~before | first[:n]))
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = inside[1:]
            self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.inside = inside
        #: words of text i are lo[i] .. lo[i+1]-1
        self.lo = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.lo)
        self._prefix: np.ndarray | None = None

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def last(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.lo[1:], self.count)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans: equal bytes, equal hash."""
        n = len(self.buf)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUE[self.buf] * powers(BASE, n), out=self._prefix[1:])
        back = powers(BASE_INVERSE, n + 1)
        return mix((self._prefix[end] - self._prefix[start]) * back[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.span_hash(self.start, self.end)

    def codepoints_before(self) -> np.ndarray:
        """For each byte position, the code points that begin before it."""
        out = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (over text borders too; mask those)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=prefix[1:])
    back = powers(np.uint64(pow(int(WORD_BASE), -1, 1 << 64)), m)
    return mix((prefix[n:] - prefix[:m]) * back)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a temporary one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewell-shared-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base if ":/" in base else f"file://{base}"


def own_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for one run inside the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/tidewell-{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    path = own_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, when nothing will read it again."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
