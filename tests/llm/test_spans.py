import random

import numpy as np

from lexmill.llm import spans
from lexmill.session import cut

SCHEMA = "slug string, body string, name string, line bigint, text string"


def brute(rows, least):
    seen = {}
    for s, b in rows:
        for line in b.split("\n"):
            for i in range(len(line) - least + 1):
                seen.setdefault(line[i : i + least], set()).add(s)
    out = set()
    for s, b in rows:
        off = 0
        for line in b.split("\n"):
            cur = None
            for i in range(len(line) - least + 1):
                if len(seen[line[i : i + least]]) > 1:
                    if cur and i <= cur[1]:
                        cur[1] = i + least
                    else:
                        if cur:
                            out.add((s, off + cur[0], off + cur[1]))
                        cur = [i, i + least]
            if cur:
                out.add((s, off + cur[0], off + cur[1]))
            off += len(line) + 1
    return out


def test_windows_choose_the_same_symbols_in_any_surroundings():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))) for _ in range(300)] + ["𝔘𝔫𝔦", "é", "a" * 40, "x1y2" * 12]
    for case in range(400):
        w = " ".join(rnd.choice(words) for _ in range(60))[:200] if case % 4 else rnd.choice(["ab", "a", "xyz ", "é"]) * 200
        w = w[:200]
        if len(w) < 200:
            continue
        texts = []
        for _ in range(2):
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) + rnd.choice(["", " ", "b", "ab"]) + w + rnd.choice(["", " ", "a", ". End"]))
        got = spans.chosen_symbols(texts, 200)
        names = [set(got["name"][got["line"] == k].tolist()) for k in (0, 1)]
        assert names[0] & names[1], (case, w)


def test_names_do_not_depend_on_the_batch():
    text = " ".join(f"word{i} of number {i * 7}" for i in range(40))
    alone = spans.chosen_symbols([text], 200)["name"]
    among = spans.chosen_symbols(["x" * 300, "some other line " * 20, text], 200)
    assert np.array_equal(np.sort(alone), np.sort(among["name"][among["line"] == 2]))


def test_spans_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(f"s{i}", "\n".join(line(rnd.randrange(5, 90)) for _ in range(4))) for i in range(40)]
    for _ in range(30):
        a, b = rnd.randrange(40), rnd.randrange(40)
        src = rnd.choice(rows[a][1].split("\n"))
        k = rnd.randrange(150, 320)
        at = rnd.randrange(max(1, len(src) - k))
        rows[b] = (rows[b][0], rows[b][1] + "\n" + line(3) + src[at : at + k] + line(4))
    rows += [("r1", "ab" * 160), ("r2", "q" + "ab" * 140 + "é"), ("r3", "same line " * 30), ("r4", "same line " * 30), ("r5", "z" * 500 + "\n" + "z" * 260)]
    data = [(s, b, None, 1, "x") for s, b in rows] + [(rows[0][0], rows[0][1], "again", 2, None), (None, "n" * 400, "", 0, ""), ("null", None, "", 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = {tuple(r) for r in spans.shared_spans(df, cut).collect()}
    assert got == brute(rows, 200)
    # Names that many lines share are compared by windows instead; the result is the same.
    assert {tuple(r) for r in spans.shared_spans(df, cut, pairwise=1, small=0).collect()} == got
    shares = {r.slug: r for r in spans.shared_amounts(df, spans.shared_spans(df, cut)).collect()}
    assert shares["r3"].share == 1.0 and shares["null"].shared == 0


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spans.shared_spans(empty, cut).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", long, "", 0, ""), ("b", "pre " + long[1000:90_000], "", 0, "")], SCHEMA)
    back = next(k for k in range(5) if k == 4 or long[999 - k] != "pre "[3 - k])
    got = {(r.slug, r.span_start, r.span_end) for r in spans.shared_spans(df, cut).collect()}
    assert got == {("a", 1000 - back, 90_000), ("b", 4 - back, 89_004)}


def test_long_lines_that_share_no_symbol(spark):
    rows = [("a", "x" * 150 + "\n" + "y" * 199), ("b", "z" * 190 + "\nq" * 200)]
    df = spark.createDataFrame(rows, "slug string, body string").coalesce(1)
    assert spans.shared_spans(df, cut).count() == 0
