import hashlib
import random

from loomlake.llm import chat_grammar as C

PARTS = ["<|im_end|>", "<|im_start|>assistant ok", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "\n", "a", "é", "<|", "n"]


def test_round_trip_and_mask():
    r = random.Random(0)
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "x\ny", "<|im_end|>", "", "a\\n"]), "".join(r.choices(PARTS, k=r.randrange(8)))) for _ in range(r.randrange(4))]
        out, mask = C.format_conversation(turns)
        assert [(a, b) for a, b, _, _ in C.parse(out)] == turns
        cuts = sorted(r.choices(range(len(out) + 1), k=3))
        reader = C.Reader()
        assert [x for i, j in zip([0, *cuts], [*cuts, len(out)]) for x in reader.feed(out[i:j])] == C.parse(out)
        reader.close()
        assert [C.unescape(out[a:b]) for a, b in mask] == [t for role, t in turns if role == "assistant"]


def test_plain_text_is_left_alone():
    assert C.format_turn("user", "a | b < c \\| <b>") == "<|im_start|>user\na | b < c \\| <b><|im_end|>\n"


def test_parser_refuses():
    for bad in ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u<|im_end|>\n"]:
        assert C._read(bad) is None


def test_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, "x"), (2, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.digests(df).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert C.format_turns(df).count() == 5 and C.digests(df.limit(0)).count() == 0
