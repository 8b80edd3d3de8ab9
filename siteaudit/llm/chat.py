"""Chat formatting over a prefix tree.

Conversations are sorted by their turns, so that those that begin alike are neighbours and the order is
that of a depth-first walk through the tree of turns. A pack is a stretch of that order; each turn
that the conversation before doesn't share is written once, with the positions it has in its own conversation and the
intervals of the pack that it may attend to: those of its ancestors.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; none can stand in what is written of a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(\\|n)?")
#: Characters of a pack at which it ends, after the conversation that reaches it.
PACK = 200_000
#: Role whose texts are trained on.
TRAINED = "assistant"


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, and one is put behind the first character of each control string."""
    return _STARTS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1] or "", ""), text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, ``<s>role``, line feed, text, ``</s>``, and where in it the text begins and ends."""
    head = "<s>" + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + "</s>", len(head), len(head) + len(body)


def parsed_turn(piece: str) -> tuple[str, str]:
    role, _, body = piece.removeprefix("<s>").removesuffix("</s>").partition("\n")
    return unescape(role), unescape(body)


_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("attend", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
PACKS = (
    "text string, nodes array<struct<start:long,end:long,position:long,parent:int,attend:array<struct<start:long,end:long>>,loss_start:long,loss_end:long>>, "
    "conversations array<struct<conv_id:long,node:int>>"
)


def _walk(limit: int):
    def run(batches):
        text, at, nodes, leaves = [], 0, [], []
        path: list[tuple[str, str]] = []  # turns of the conversation before
        spots: list[int] = []  # their nodes

        def out():
            nonlocal text, at, nodes, leaves, path, spots
            got = pa.RecordBatch.from_arrays([pa.array(["".join(text)], pa.string()), pa.array([nodes], pa.list_(_NODE)), pa.array([leaves], pa.list_(_LEAF))], ["text", "nodes", "conversations"])
            text, at, nodes, leaves, path, spots = [], 0, [], [], [], []
            return got

        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                same = 0
                while same < len(path) and same < len(turns) and path[same] == turns[same]:
                    same += 1
                del path[same:], spots[same:]
                for role, said in turns[same:]:
                    piece, a, b = formatted_turn(role, said)
                    parent = spots[-1] if spots else -1
                    attend, position = [], 0
                    if spots:
                        up = nodes[parent]
                        position = up["position"] + up["end"] - up["start"]
                        attend = [dict(x) for x in up["attend"]]
                        if attend and attend[-1]["end"] == up["start"]:
                            attend[-1]["end"] = up["end"]
                        else:
                            attend.append({"start": up["start"], "end": up["end"]})
                    trained = role == TRAINED
                    nodes.append({"start": at, "end": at + len(piece), "position": position, "parent": parent, "attend": attend, "loss_start": at + a if trained else at, "loss_end": at + b if trained else at})
                    text.append(piece)
                    at += len(piece)
                    path.append((role, said))
                    spots.append(len(nodes) - 1)
                leaves.append({"conv_id": conv, "node": spots[-1]})
                if at >= limit or len(leaves) >= limit:
                    yield out()
        if leaves:
            yield out()

    return run


def pack_conversations(turns: DataFrame, pack: int = PACK) -> DataFrame:
    """Packs of ``turns(conv_id, turn, role, text)``: ``text``, the template's text with shared initial turns once, depth first;
    ``nodes``, for each turn written its ``start`` and ``end`` in the text, the ``position`` of its first character in its
    conversation, its ``parent`` node (-1: none), ``attend``, the intervals of its ancestors, joined where they meet, and the loss interval (empty
    unless the role is assistant); ``conversations``, the last node of each. Units are code points.

    Equal prefixes share within a pack; a pack ends after the conversation with which it reaches ``pack`` characters, or at the end of a
    range of the sorted order, so a first turn or conversation that a third of all rows share goes to many packs and tasks.
    A conversation is one row here and never split.

    Turns go by turn (null first), role, text; repeated rows are turns of their own; null role and text count as empty;
    rows with a null conv_id make one conversation. Other columns are ignored. Empty in, empty out.
    """
    spoken = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", spoken.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"], x["text"]))
    # The order only brings equal beginnings together; what is shared is told by the turns themselves.
    order = F.transform("t", lambda x: F.xxhash64(x["role"], x["text"]))
    keyed = whole.select("conv_id", said.alias("turns"), order.alias("order"))
    sorted_ = keyed.repartitionByRange("order", "conv_id").sortWithinPartitions("order", "conv_id")
    return sorted_.select("conv_id", "turns").mapInArrow(_walk(pack), PACKS)


def _read(batches):
    """Each conversation of a pack, read back from the text by the intervals of its last node."""
    for batch in batches:
        rows = []
        for text, nodes, leaves in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for leaf in leaves:
                chain, k = [], leaf["node"]
                while k >= 0:
                    chain.append(nodes[k])
                    k = nodes[k]["parent"]
                chain.reverse()
                last = chain[-1]
                spans = [*last["attend"], {"start": last["start"], "end": last["end"]}]
                whole = "".join(text[s["start"] : s["end"]] for s in spans)
                pieces = [p + "</s>" for p in whole.split("</s>")[:-1]]
                lossy = [text[n["loss_start"] : n["loss_end"]] for n in chain]
                rows.append((leaf["conv_id"], [dict(zip(("role", "text"), parsed_turn(p))) for p in pieces], "".join(unescape(x) for x in lossy), len(whole)))
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], turn), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["conv_id", "turns", "loss_text", "formatted_chars"])


def read_back(packs: DataFrame) -> DataFrame:
    """A row for each conversation of ``packs``: ``conv_id, turns`` (role, text), ``loss_text`` (all text under the loss mask) and
    ``formatted_chars``, all read from the packed text."""
    return packs.select("text", "nodes", "conversations").mapInArrow(_read, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


TOKENS = (
    "ids array<int>, positions array<int>, nodes array<struct<start:int,end:int,parent:int,attend:array<struct<start:int,end:int>>,loss_start:int,loss_end:int>>, "
    "conversations array<struct<conv_id:long,node:int>>"
)
_TOKEN_NODE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("attend", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def token_packs(packs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``packs`` in tokens of the vocabulary in ``ranks`` (a tiktoken file, read by the driver and sent to the tasks: about 1 MB): ``ids`` and
    ``positions`` of the whole pack, and for each node its interval, its ancestors' and its loss interval in tokens.

    A turn is encoded as what stands before its text, the text, and what stands after, each on its own: shared turns have the same tokens in
    every conversation, and the loss interval ends where tokens do.
    """
    from .secrets import _vocabulary

    with open(ranks, "rb") as f:
        data = f.read()

    def run(batches):
        encode = _vocabulary(data, pattern).encode_ordinary
        for batch in batches:
            for text, nodes, leaves in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, positions, out, depth = [], [], [], []
                for n in nodes:
                    piece = text[n["start"] : n["end"]]
                    a = piece.index("\n") + 1
                    b = len(piece) - len("</s>")
                    head, body, tail = (encode(x) for x in (piece[:a], piece[a:b], piece[b:]))
                    start, parent = len(ids), n["parent"]
                    ids += head + body + tail
                    attend, base = [], 0
                    if parent >= 0:
                        up = out[parent]
                        base = depth[parent] + up["end"] - up["start"]
                        attend = [dict(x) for x in up["attend"]]
                        if attend and attend[-1]["end"] == up["start"]:
                            attend[-1]["end"] = up["end"]
                        else:
                            attend.append({"start": up["start"], "end": up["end"]})
                    positions += range(base, base + len(ids) - start)
                    depth.append(base)
                    trained = n["loss_start"] > n["start"]
                    at = start + len(head)
                    out.append({"start": start, "end": len(ids), "parent": parent, "attend": attend, "loss_start": at if trained else start, "loss_end": at + len(body) if trained else start})
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32())), pa.array([positions], pa.list_(pa.int32())), pa.array([out], pa.list_(_TOKEN_NODE)), pa.array([leaves], pa.list_(_LEAF))], ["ids", "positions", "nodes", "conversations"])

    return packs.select("text", "nodes", "conversations").mapInArrow(run, TOKENS)
