"""SentencePiece encoding and decoding that keeps every piece's original bytes.

A text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie followed by its replacement strings); for
every normalised byte the source byte it comes from is recorded.  Pieces are
laid over the normalised text by their byte lengths, and the recorded
alignment projects their borders to spans of the source text.

Segmentation is the library's; that its pieces cover exactly the text normalised
here is checked for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, text_chunks

SPACE_MARK = "▁".encode()


class CharsMap:
    """A compiled character map: longest-prefix lookups in its double array."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest mapped prefix of data[at:]."""
        if not self.units:
            return None

        def jump(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, found = jump(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class PieceCodec:
    """Encodes and decodes with a SentencePiece model file."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kinds = model.SentencePiece
        self.length = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.end_id = self.lib.eos_id()
        self.only_spaces = not self.map.units and not self.squeeze

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, the source byte of each and of the end), by longest prefixes."""
        space = SPACE_MARK if self.escape else b" "
        out, source = bytearray(), []
        at, blank = 0, self.squeeze  # blank: a space now would be the second, or stand in front
        pieces = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                step = 1
                while at + step < len(data) and data[at + step] & 0xC0 == 0x80:
                    step += 1
                hit = (step, data[at : at + step])
            pieces.append((at, hit[0], hit[1]))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            while pieces and not pieces[-1][2].strip(b" "):
                end = pieces.pop()[0]
            while pieces and not pieces[0][2].strip(b" "):
                pieces.pop(0)
        if self.prefix and pieces:
            out += space
            source += [pieces[0][0]] * len(space)
        for begin, _, text in pieces:
            for byte in text:
                if byte == 0x20:
                    if self.squeeze and blank:
                        continue
                    out += space
                    source += [begin] * len(space)
                else:
                    out.append(byte)
                    source.append(begin)
                blank = byte == 0x20
        return bytes(out), np.array([*source, end], dtype=np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, begins, ends): ids of all texts one after another without end ids; spans in source bytes of the text."""
        raw, n = buf.tobytes(), len(offsets) - 1
        lists = self.lib.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in range(n)], num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, n)
        ids = np.fromiter((i for each in lists for i in each), np.int32, int(counts.sum()))
        if self.only_spaces:
            source, norm = self._source_of_spaces(buf, offsets)
        else:
            found = [self.normalise(raw[offsets[i] : offsets[i + 1]]) for i in range(n)]
            source = np.concatenate([f[1] for f in found]) if n else np.zeros(0, np.int64)
            norm = np.array([len(f[0]) for f in found], dtype=np.int64)
        # the pieces of a text lie end to end over its normalised bytes; each text's source has one entry more, for its end
        size = self.length[ids]
        right = np.cumsum(size)
        first = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(norm, out=first[1:])
        total = np.append(0, right)[np.append(0, np.cumsum(counts))]
        if (total != first).any():
            raise ValueError("the pieces don't cover the normalised text")
        text = np.repeat(np.arange(n), counts)
        return ids, counts, source[right - size + text], source[right + text]

    def _source_of_spaces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``normalise`` for a map without entries, for many texts at once: only spaces get longer and a prefix is added."""
        n, length = len(offsets) - 1, np.diff(offsets)
        long = len(SPACE_MARK) if self.escape else 1
        prefix = np.where(length > 0, long if self.prefix else 0, 0)
        text = np.repeat(np.arange(n), length)
        inner = np.arange(len(buf)) - offsets[text] if len(buf) else np.zeros(0, np.int64)
        # per text: the prefix (from byte 0), each byte with its width, the end
        where = np.concatenate([np.zeros(n, np.int64), inner, length])
        width = np.concatenate([prefix, np.where(buf == 0x20, long, 1), np.ones(n, np.int64)])
        order = np.argsort(np.concatenate([np.arange(n) * 3, text * 3 + 1, np.arange(n) * 3 + 2]), kind="stable")
        norm = prefix + np.bincount(text, weights=np.where(buf == 0x20, long, 1), minlength=n).astype(np.int64) if n else prefix
        return np.repeat(where[order], width[order]), norm

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids (with the end id), the byte span of every id, the decoded text.

    ``begins`` and ``ends`` are offsets into the text's UTF-8 bytes; the end
    id's span is empty and stands at the end.  A null text counts as empty and
    has the end id alone.  Repeated rows give repeated results; other columns
    don't matter.  The model file is a path that every executor has (or one
    sent with ``SparkContext.addFile``).  No shuffle; memory is bounded by a text
    chunk.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for part in text_chunks(batch, text_col):
                buf, offsets = text_bytes(part.column(1))
                ids, counts, begins, ends = c.encode(buf, offsets)
                at = np.zeros(len(counts) + 1, dtype=np.int64)
                np.cumsum(counts + 1, out=at[1:])
                place = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)
                size = np.diff(offsets)
                full = np.full(at[-1], c.end_id, dtype=np.int32)
                full[place] = ids
                spans = []
                for side in (begins, ends):
                    span = np.zeros(at[-1], dtype=np.int32)
                    span[at[1:] - 1] = size
                    span[place] = side
                    spans.append(span)
                decoded = c.decode([full[at[i] : at[i + 1]].tolist() for i in range(len(counts))])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (full, *spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "begins", "ends", "decoded"])

    id_type = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return picked.mapInArrow(rows, f"`{id_col}` {id_type}, ids array<int>, begins array<int>, ends array<int>, decoded string")
