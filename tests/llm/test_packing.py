import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


def check_sequences(rows, capacity):
    """Offsets gapless from 0, none over capacity; returns padded tokens."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pieces_give_back_every_document(spark):
    texts = ["", None, "a", "word " * 5000, "é" * 3000, "a" * 100000, "one two three", "one two three", " \n\t" * 900]
    df = spark.createDataFrame([(i if i != 6 else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = packing.pack(df.coalesce(1), JSON, RANKS).collect()
    digests = packing.digest(packing.pack(df.coalesce(1), JSON, RANKS)).collect()
    tokenizer = Tokenizer.from_file(JSON)
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == (i if i != 6 else None)), key=lambda r: r.start)
        got = np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist()
        assert got == want and all(r.doc_tokens == len(want) for r in mine)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in digests} == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}
    check_sequences(rows, 2048)


def test_both_encoders_agree(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["<|endoftext|> x", "don't  stop\n\n  now", "١٢٣ 日本語 👩‍👩‍👧", "\u0000​", "a" * 3000]
    fast, plain = packing.load_encoder(JSON, RANKS), packing.load_encoder(JSON, None)
    assert all((fast(t) == plain(t)).all() for t in texts)


def test_little_padding_and_unique_sequences(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    rows = packing.digest(packing.pack(df, JSON, RANKS)).collect()
    assert check_sequences(rows, 2048) < 0.02 * sum(r.length for r in rows)


@pytest.mark.parametrize("n", [*range(1, 80), 1023, 1024, 1025, 2000, 2047, 2048, 2049, 10_000])
def test_cuts(n):
    out = packing.cuts(n)
    assert sum(out) == n and all(0 < x <= 2048 for x in out)
    assert all(2048 // x >= packing.CLASSES or 2048 - (2048 // x) * x <= max(2048 // packing.TOLERANCE, 2048 // x) for x in out)  # a class size is rounded down


def test_a_class_holds_a_fixed_number_of_pieces():
    bins = packing.Bins(0)
    piece = lambda n: (1, 0, b"\0" * 4 * n, n)
    done = [bins.add(piece(682)) for _ in range(3)]
    assert done[0] == done[1] == [] and len(done[2]) == 3
    assert bins.add(piece(2048))[0][5] != done[2][0][5]
    assert bins.close() == []


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), JSON, RANKS).count() == 0
