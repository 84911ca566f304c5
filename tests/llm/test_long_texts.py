"""Texts that are long in awkward ways: linear time, and the same answers as the libraries."""

import random
import time

import pyarrow as pa
import public_tokenizers
import sentencepiece

from lectern.llm.token_counts import LONG_WORD, MODEL, TokenCounter


def test_runs_of_spaces_and_long_words():
    counter = TokenCounter(public_tokenizers.path(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    start = time.process_time()
    assert counter.count("a" + " " * 100_000 + "b") == len(sp.encode("a" + " " * 100_000 + "b"))
    assert time.process_time() - start < 3
    r = random.Random(6)
    for _ in range(60):
        t = "".join(r.choice("theanoinserß日") for _ in range(r.randint(LONG_WORD - 5, 4 * LONG_WORD))) + r.choice(["", "  ", " x"])
        assert counter.count(t, 50) == counter.count(t) == len(sp.encode(t)), t
    machine = counter.words.machine
    for _ in range(500):
        w = "".join(r.choice("▁▁▁▁abe,th") for _ in range(r.randint(1, 30)))
        assert machine.merged(w) == machine.merged_by_heap(w)


def test_pieces_are_cut_where_the_pattern_ends_a_match(monkeypatch):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from lectern.llm import byte_pairs, pieces, token_files

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec, memo = byte_pairs._codec(public_tokenizers.path(byte_pairs.RANKS))
    encode = token_files._library_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = "ab  \n\n\t'sétdl日²3.!0▁\x00\xa0　 “”—…¿«ª×÷\r\x0b\x1c\x85-\"()'рыá́ ​﻿"
    r = random.Random(8)
    for size, block in ((3, 4 << 20), (20, 4 << 20), (200, 300)):
        monkeypatch.setattr(pieces, "BLOCK_BYTES", block)
        for k in range(30):
            texts = ["".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(20)] + [None, "<|endoftext|> it's"]
            ids, ends = memo.encode(pa.array(texts).slice(2))
            whole, stops = encode(pa.array(texts))
            text, at = codec.decode(ids)
            for i, t in enumerate(t or "" for t in texts):
                if i >= 2:
                    assert ids[ends[i - 2] : ends[i - 1]].tolist() == one.encode_ordinary(t)
                    assert text[at[ends[i - 2]] : at[ends[i - 1]]].tobytes() == t.encode()
                assert whole[stops[i] : stops[i + 1]].tolist() == other.encode(t, add_special_tokens=False).ids


def test_codes_give_any_range():
    import numpy as np

    from lectern.llm.token_files import Codes, pack_codes

    r = np.random.default_rng(4)
    for n in (1, 511, 512, 513, 5000):
        ids = r.integers(0, [256, 60000, 2**32][n % 3], n, np.uint32)
        codes = Codes(pack_codes(ids))
        cuts = np.sort(np.append(r.integers(0, n + 1, 7), [0, n]))
        assert codes.slices(cuts[:-1], cuts[1:]).tolist() == ids.tolist()
        a, b = r.integers(0, n + 1, 2)
        a, b = sorted((int(a), int(b)))
        assert codes.slices(np.array([a, 0]), np.array([b, a])).tolist() == ids[a:b].tolist() + ids[:a].tolist()
        assert [codes.get(i) for i in range(0, n, 97)] == ids[::97].tolist()
