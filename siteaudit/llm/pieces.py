"""SentencePiece encoding and decoding over a table of distinct chunks.

If no piece of a BPE model goes on past a whitespace marker or holds a line feed, a text's segmentation
is that of its chunks: marked words, the unmarked start of a line, and line feeds. Each task
keeps a table of the distinct chunks it has met, has the library segment and decode each once, and joins
the results back by position. Tables stay with their tasks: a corpus-wide table would shuffle
every word twice to save what is a small share of the segmenting.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, sent, with_text

MARK = "▁"
#: Markers are spaces here, which take a byte each in most texts; the library turns them into markers itself.
_CHUNK = re.compile("\n| +[^ \n]*|[^ \n]+")
#: Chunks of a task's table (under 200 bytes each); beyond that it starts anew with those of the batch. Chunks over this many characters aren't kept in it.
TABLE, LONG = 100_000, 64
#: Bytes of text that are cut into chunks at once; a chunk at hand takes some 20 bytes for each of its own.
BATCH = 512 << 10

_models: dict = {}


def _model(data: bytes):
    if data not in _models:
        import sentencepiece

        _models.clear()
        _models[data] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _models[data]


def check_model(data: bytes) -> None:
    """Raise unless chunks can be segmented on their own: BPE without normalisation, pieces that end before a marker and hold no line feed."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto.FromString(data)
    n, t = m.normalizer_spec, m.trainer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not t.treat_whitespace_as_suffix
    crossing = [p.piece for p in m.pieces if MARK in p.piece.lstrip(MARK) or "\n" in p.piece or p.type == 4]
    if t.model_type != 2 or not plain or crossing or not any(p.type == 6 for p in m.pieces):
        raise ValueError(f"pieces of this model can cross chunks: {crossing[:3]}")


class Table:
    """Chunk -> its ids, packed; ``odd`` has the decoded text of those that it differs from."""

    def __init__(self, data: bytes):
        self.sp = _model(data)
        self.lead = self.sp.encode("\n")  # the marker that the library puts first, and the line feed
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """The table and the texts that differ, with all of ``chunks``."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > TABLE:
            self.known = {c: self.known[c] for c in chunks if c in self.known}
            self.odd = {c: self.odd[c] for c in self.known if c in self.odd}
        long, long_odd = {}, {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = [x[len(self.lead) :] for x in self.sp.encode(["\n" + c for c in part], num_threads=1)]
            texts = self.sp.decode([self.lead + x for x in ids], num_threads=1)
            for c, x, t in zip(part, ids, texts):
                table, odd = (self.known, self.odd) if len(c) <= LONG else (long, long_odd)
                table[c] = struct.pack(f"<{len(x)}I", *x)
                if t[1:] != c:
                    odd[c] = t[1:]
        return (self.known, self.odd) if not long else ({**self.known, **long}, {**self.odd, **long_odd})

    def encode(self, texts: list[str | None], first: bytes, last: bytes) -> tuple[list[bytes], list[str]]:
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        table, odd = self.learn(set().union(*cut)) if cut else ({}, {})
        ids, out = [], []
        for chunks in cut:
            ids.append(b"".join([first, *[table[c] for c in chunks], last]))
            out.append("".join([odd.get(c, c) for c in chunks] if odd else chunks)[1:])  # the library drops the marker that it put first
        return ids, out


def encode(docs: DataFrame, model: str, text: str = "text", begin: bool = True, end: bool = True, keep_text: bool = True) -> DataFrame:
    """Adds to each row of ``docs`` ``ids`` (binary: the ids of the whole text as little-endian unsigned 32-bit integers) and
    ``decoded`` (what the library's decode makes of them), both exactly as the library does for the whole text.

    ``model``: path of a model file, read by the driver and sent to the tasks (some hundred KB). A null text counts as empty: begin and end
    ids alone, decoded to "". Rows are encoded on their own, so repeated rows, null ids and
    other columns make no difference; columns called ids or decoded are replaced. Without ``keep_text`` the text goes to the tasks but does not come back.
    """
    with open(model, "rb") as f:
        data = f.read()
    check_model(data)
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded") and (keep_text or c.lower() != text.lower())]
    docs, at = with_text(docs, kept, text)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        table = Table(data)
        first, last = (struct.pack("<I", i) if on else b"" for on, i in ((begin, table.sp.bos_id()), (end, table.sp.eos_id())))
        for batch in pieces(batches, at, BATCH):
            ids, out = table.encode(batch.column(at).to_pylist(), first, last)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(ids, pa.binary()), pa.array(out, pa.string())], [*kept, "ids", "decoded"])
            del batch, ids, out  # a slice would keep the batch that it is of while the next one comes

    return sent(docs, run, schema)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of ints."""
    at = F.sequence(F.lit(0), (F.length(ids) / 4 - 1).cast("int"))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k, 1)), 16, 10).cast("int")
    whole = F.transform(at, lambda i: sum((byte(i, k) * (256 ** (k - 1)) for k in range(2, 5)), byte(i, 1)))
    return F.when(F.length(ids) == 0, F.array().cast("array<int>")).otherwise(whole)
