"""Secret scans: patterns, and the token-efficiency test for random strings.

Text that a tokenizer's vocabulary was made from packs several characters into a token; random strings
hardly do. Strings of token characters with few characters for each token are found, after
known digests and identifiers are taken out.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, sent, with_text

KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Strings that the token-efficiency test looks at: so long, of these characters.
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Most characters for each token of a string that counts as random.
EFFICIENCY = 2.1
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words and numbers joined by marks or by a change of case: names in programs, paths, dates.
_NAMED = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+)[+/_=-]+)*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+)[+/_=-]*")
_CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{0,4}")

#: Bytes of text that are scanned at once.
BATCH = 1 << 20

_vocabularies: dict = {}


def _vocabulary(data: bytes, pattern: str):
    if data not in _vocabularies:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _vocabularies[data] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[data]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each pattern that don't overlap others of its kind and are long enough."""
    out = []
    if _WORDS.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def identifier(s: str) -> bool:
    """Digests of a known length, UUIDs, and names made of words and numbers."""
    bare = s.strip("+/_=-")
    if len(bare) in DIGESTS and _DIGEST.fullmatch(bare):
        return True
    return bool(_UUID.fullmatch(bare) or _NAMED.fullmatch(s) or _CAMEL.fullmatch(bare))


def token_spans(text: str, vocabulary, efficiency: float = EFFICIENCY) -> list[tuple[int, int, str]]:
    out = []
    for m in _STRING.finditer(text):
        s = m[0]
        mixed = any(c.isdigit() for c in s) + any(c.isupper() for c in s[1:]) + any(c.islower() for c in s)
        if mixed < 2 or identifier(s):
            continue
        if len(s) <= efficiency * len(vocabulary.encode_ordinary(s)):
            out.append((m.start(), m.end(), "token"))
    return out


def spans_of(text: str, vocabulary, efficiency: float = EFFICIENCY) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of ``KINDS``. A string that overlaps a pattern's match isn't named again."""
    base = base_spans(text)
    extra = token_spans(text, vocabulary, efficiency)
    if base and extra:
        extra = [x for x in extra if not any(a < x[1] and x[0] < b for a, b, _ in base)]
    return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPANS = "array<struct<start:int,end:int,kind:string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, ranks: str, pattern: str, text: str = "text", efficiency: float = EFFICIENCY) -> DataFrame:
    """Adds ``secrets`` to each row of ``docs``: spans ``(start, end, kind)`` in code points, end exclusive, by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the patterns' matches; ``token`` are strings of 20 characters or more with at most
    ``efficiency`` characters for each token of the vocabulary in ``ranks`` (a tiktoken file, read by the driver and sent to the tasks: about
    1 MB), unless they are digests or identifiers, or hold only one of digits, capitals (but the first letter) and small letters, as long words and numbers do. A null or empty text has none. Rows are scanned whole and on their own:
    repeated rows, null ids and other columns make no difference; a column called secrets is replaced.
    """
    with open(ranks, "rb") as f:
        data = f.read()
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    docs, at = with_text(docs, kept, text)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast(_SPANS).alias("secrets")).schema

    def run(batches):
        vocabulary = _vocabulary(data, pattern)
        for batch in pieces(batches, at, BATCH):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t or "", vocabulary, efficiency)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, _ARROW)], [*kept, "secrets"])
            del batch, found

    return sent(docs, run, schema)


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, and each run of spans that overlap, replaced by ``mask``; spans go by start. Texts that are null, empty or without spans stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        return F.struct(F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
