"""Encoding by units against the tokenizers themselves."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from ferrule.llm import bytewise, tokens, units
from ferrule.llm.queries import tokenizer_path

ODD = ["Don't it's we'LL x'sy", "a<|endoftext|>b c", "É́ é  \t\r\nb 12a3", "ΣΑΣ. ﬁ ½ İstanbul", "x　y z", "(word), [Word]! _w_", "\x1cend", "«mot» l’été…", "中文字 test", "x" * 3000, "", None, "'", "a'é", "\x7f a\x00b"]


@pytest.mark.parametrize("name, alone", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_units_equal_whole_texts(name, alone):
    encoder = units.Encoder(public_tokenizers.path(name), known=300)  # small: it starts anew on the way
    assert encoder.by_units == alone
    rnd = random.Random(1)
    letters = list("abAB'’é́ 12.,-\t\n ßΣ中\x1c<|>½")
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        got = encoder.texts(*bytewise.utf8(pa.array(part, pa.string())))
        assert [g.tolist() for g in got] == [encoder.whole(t or "").tolist() for t in part]


def test_slices_bound_the_memory_of_encoding():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": [" ".join(rnd.choices(words, k=900)) for _ in range(800)]})
    encoder = units.Encoder(tokenizer_path())
    encoder.texts(*bytewise.utf8(batch.slice(0, 20).column(1)))  # units are known from here on
    tracemalloc.start()
    try:
        got = [len(x) for part in bytewise.slices(batch, 1, tokens.SLICE) for x in encoder.texts(*bytewise.utf8(part.column(1)))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 800 and peak < 40 << 20, peak
