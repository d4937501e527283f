"""What checking an encoding holds besides the texts does not grow with a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quern.llm import lattice, sentencepiece_scan


def test_decoder_holds_one_text():
    v = lattice.load(lattice.default_model())
    chunks, decoder = sentencepiece_scan.kept(tuple(v.pieces))
    texts = pa.array([f"one text of a batch, the {k}th of many " * 20 for k in range(1_300)] + [None, "", "▁ a literal one"])
    ids, bounds = chunks.memory.encode(texts.to_pylist())
    tracemalloc.start()
    ok = decoder.same(ids, bounds, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ok.all() and most < 10 << 20
    assert not decoder.same(np.roll(ids, 1), bounds, texts).all()
