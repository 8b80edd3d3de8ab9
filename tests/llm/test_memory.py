"""What a task holds while it encodes."""

import struct
import tracemalloc

import pytest

from siteaudit.llm.pieces import Table

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_chunk_table_is_bounded():
    """Before, 200,000 chunks stayed, each with a second copy of its text: 60 MB."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    table, library = Table(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    tracemalloc.start()
    for k in range(38):
        text = " ".join(f"w{k}x{i}" for i in range(5000)) + f"\n{'long' * 20}{k} ▁ é\U0001f600 \x00"
        ids, out = table.encode([text, None, ""], b"", b"")
        if k % 12 == 0:
            want = library.encode(text)
            assert ids == [struct.pack(f"<{len(want)}I", *want), b"", b""] and out == [library.decode(want), "", ""]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 30e6, held
