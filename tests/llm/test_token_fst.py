import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlake.llm import token_fst as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = F.Encoder(PATH)
HARD = ["", " ", "  ", "\n", "a\n\nb", "  x", " \n x", "\n \n", "it's  'tis we'll'll ''s 'r 're're 'vé", "'", "x'", "'s", " 's", "\n's", "'l", "'ll2", "a  ", "\t\tb  c　d", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "١٢ ½² _x_ 🙂🙂 日本語 é", "x" * 3000, "\x00\x1c\x85", "...'s !?'re"]


def same(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert ENCODER.count(raw).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in ENCODER.encode(raw)] == want


def test_hard_texts():
    same(HARD)
    for t in HARD:
        same([t])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    r = random.Random(seed)
    alphabet = "aeilrstvmd'' \n\t.,!0123é日<|>E_thingtion"
    same(["".join(r.choices(alphabet, k=r.randrange(0, 900))) for _ in range(150)])


def test_forgetting_changes_nothing():
    e = F.Encoder(PATH, max_states=50)
    texts = [f"thistle {i} ofthing erwhonti" * 3 for i in range(50)]
    want = [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert e.count([t.encode() for t in texts]).tolist() == want


def test_scan_composes_chunk_maps():
    symbols = np.random.default_rng(1).integers(0, 12, 4000).astype(np.uint8)
    assert all((F.word_starts(symbols, c) == F.word_starts(symbols, 5000)).all() for c in (1, 7, 256))


def test_query_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 6), (3, "x" * 40000, 7)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, F.count_tokens(df, PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 40000, len(LIBRARY.encode("x" * 40000).ids), len(LIBRARY.encode("x" * 40000).ids) > 1024)], key=str)
    assert F.count_tokens(df.limit(0), PATH).count() == 0


def test_long_words_by_chunk_maps():
    """Words of up to 2 MB in seconds, equal to the library."""
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from loomlake.llm.token_fst import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, r = Tokenizer.from_file(path), Encoder(path), random.Random(8)
    texts = ["x" * 5000, "ab" * 3001, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=80_000)), "\u00e9t\u00e9" * 2000, "=" * 4097, " " * 3000 + "end", "1234567" * 900, "aaab" * 700 + " short " + "z" * 1025]
    texts = [t + "<|endoftext|>" + t[:1500] for t in texts]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.count([t.encode() for t in texts]).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == want
    t0 = time.time()
    assert own.count([b"x" * 2_000_000])[0] == len(lib.encode("x" * 2_000_000, add_special_tokens=False).ids)
    assert time.time() - t0 < 30


def test_words_met_before_are_looked_up():
    """Short words are merged together without a compiled transition, those met before not again, and forgetting changes nothing."""
    r = random.Random(9)
    alphabet = "abcdefgh etaoin'  éß漢字0123456789.,-\n\U0001f600"
    texts = ["".join(r.choices(alphabet, k=r.randrange(200))) for _ in range(300)]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    raw = [t.encode() for t in texts]
    e = F.Encoder(PATH)
    assert [x.tolist() for x in e.encode(raw)] == want
    assert len(e.states) == 1
    merged, e.merged = e.merged, None
    assert [x.tolist() for x in e.encode(raw)] == want
    e.merged, e.max_words = merged, 5
    for t, ids in zip(raw, want):
        assert e.encode([t])[0].tolist() == ids
        assert e.known.n <= 5 + 200
    long = ["x" * n + " " + "yz" * n for n in (7, 8, 9, 31, 32, 33, 34, 1023, 1025, 3000)]
    assert [x.tolist() for x in e.encode([t.encode() for t in long])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in long]
