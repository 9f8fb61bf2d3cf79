import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from cases import ODD
from tokenizers import Tokenizer

from dockline.llm.packing import Encoder, _pack_block, best_fit, pack, read_ranks, search

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, source, tokenizer, capacity=1024):
    by_doc, by_seq, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in source:
        ids = (tokenizer.encode(t, add_special_tokens=False).ids if t else []) + [2]
        total += len(ids)
        first, start = len(ids) % capacity or capacity, 0
        for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
            want[i].append((k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start = stop
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for i, x in by_doc.items()} == {
        i: sorted(x) for i, x in want.items()}
    for x in by_seq.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), -(-total // capacity)


def test_pieces_and_sequences(spark, small, small_texts, odd, empty, tokenizer):
    n, least = check(pack(small, RANKS).collect(), small_texts, tokenizer)
    assert n <= 1.03 * least + 1
    n, least = check(pack(small, RANKS, block=20).collect(), small_texts, tokenizer)  # several levels
    assert n <= 1.1 * least + 2
    check(pack(odd, RANKS).collect(), ODD, tokenizer)
    assert pack(empty, RANKS).count() == 0


def test_encoder_is_the_tokenizer(tokenizer):
    encode = Encoder(read_ranks(RANKS))
    for t in [" a", "a ", "a  b", "a \n b", "x'll don't \t ok 's", "  ", "a<|endoftext|>b<|endoftext|>", "日本 語 123",
              "\x1c a \x1f b", "é  x", "\r\n x \r\n", "　 q"]:
        assert list(np.frombuffer(encode(t), "<u4")) == tokenizer.encode(t, add_special_tokens=False).ids


def test_local_search_keeps_all_pieces_and_never_adds_bins():
    rng = random.Random(2)
    for draw in (lambda: rng.randint(1, 1023), lambda: rng.choice([600, 300, 500]), lambda: 600,
                 lambda: rng.randint(300, 400)):
        lengths = [draw() for _ in range(2000)]
        first = best_fit(lengths, 1024)
        bins = search(first, 1024)
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert max(map(sum, bins)) <= 1024 and len(bins) <= len(first)


def test_search_empties_a_bin_that_best_fit_leaves():
    # (7 3) (6 4): after 6 3 / 7 / 4 the swap makes two full bins
    assert sorted(map(sorted, search([[6, 3], [7], [4]], 10))) == [[3, 7], [4, 6]]


def test_sequence_numbers_of_high_levels():
    part = pd.DataFrame({"row": [1, 2], "length": [9, 8], "block": [(1 << 36) - 1] * 2})
    numbers = [_pack_block(10, level, False)(part)["sequence_id"].tolist() for level in (0, 8, 127)]
    assert len({n for level in numbers for n in level}) == 6 and all(0 <= n < 1 << 63 for level in numbers for n in level)
