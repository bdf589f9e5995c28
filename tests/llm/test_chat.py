import random

from quadrille.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, set()).add((t, r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))] for c, v in convs.items()}
    out = set()
    for c, v in turns.items():
        equal = [d for d, w in turns.items() if w == v]
        if c == min(equal) and not any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            out.add((c, len(v), len(equal), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, hashes string, h int")


def test_snapshots(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):
        start = r.randrange(6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{start}-{t if r.random() < 0.9 else r.randrange(3)}") for t in range(r.randint(1, 6))]
    r.shuffle(rows)
    assert {tuple(x) for x in chat.format_chats(frame(spark, rows)).collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (2, 0, "user", ""), (2, 1, None, "b"), (None, 0, "user", "lost"), (3, None, "user", "n"), (3, 0, "user", "o"), (4, 0, "us", "er"), (5, 0, "user", ""), (6, 0, "u" * 100_000, "x")]
    assert {tuple(x) for x in chat.format_chats(frame(spark, rows)).collect()} == brute(rows)
    assert chat.format_chats(frame(spark, rows).limit(0)).count() == 0


def test_boundaries_are_part_of_the_hash(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (2, 1, "x", "y"), (3, 0, "1:a", "b"), (4, 0, "1", ":ab")]
    assert {x.conv_id for x in chat.format_chats(frame(spark, rows)).collect()} == {1, 2, 3, 4}
