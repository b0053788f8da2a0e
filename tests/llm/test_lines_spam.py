import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import lines, spam
from lexmill.session import cut

ART = "slug string, site string, byline_verdict string, body string, line bigint, source string"


def brute(rows):
    groups, at = {}, {}
    for s, g, v, b in rows:
        groups.setdefault((g, v), set()).add(s)
        for i, x in enumerate((b or "").split("\n")):
            if x.strip():
                at.setdefault((g, v, lines.line_key(x)), set()).add((s, i))
    out = set()
    for (g, v, _), where in at.items():
        n = len({s for s, _ in where})
        if n >= 4 and n >= 0.04 * len(groups[g, v]):
            out |= where
    return out


def test_repeated_lines_equal_brute_force(spark):
    rnd = random.Random(2)
    stock = ["Share this story", "Posted  12 times", "By Some One", "The views expressed here are those of the author alone today", "nur hier", "© 2020 All Rights Reserved"]
    rows = []
    for i in range(160):
        body = []
        for _ in range(rnd.randrange(8)):
            x = rnd.choice(stock) if rnd.random() < 0.5 else f"unique line {i} {rnd.random()}"
            x = x.upper() if rnd.random() < 0.2 else x.replace(" ", "  ") + " \r" if rnd.random() < 0.2 else x.replace("12", str(rnd.randrange(999)))
            body.append(x)
        rows.append((f"s{i}", rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["v", None]), "\n".join(body)))
    data = [(*r, 1, "clash") for r in rows] + [(*rows[0], 2, None), (None, "a", "v", stock[0], 0, ""), ("nobody", "a", "v", None, 0, ""), ("blank", "a", "v", " \n\n", 0, "")]
    df = spark.createDataFrame(data, ART)
    want = brute([*rows, ("nobody", "a", "v", None), ("blank", "a", "v", "")])
    got = {tuple(r) for r in lines.repeated_lines(df, cut).collect()}
    assert got == want
    clean = {r.slug: r for r in lines.without_lines(df, lines.repeated_lines(df, cut)).collect()}
    s, _, _, b = rows[1]
    assert clean[s].body == "\n".join(x for i, x in enumerate(b.split("\n")) if (s, i) not in got) and clean["nobody"].body is None
    assert lines.repeated_lines(df.limit(0), cut).count() == 0


def test_near_duplicates_of_excessive_lines(spark):
    base = "Sign up for the daily letter of our desk and never miss a single story about the game again"
    rows = [(f"s{i}", "a", "v", base, 0, "") for i in range(8)] + [("t", "a", "v", base + " now", 0, ""), ("u", "a", "v", "something else entirely with many words in it today", 0, "")]
    df = spark.createDataFrame(rows, ART)
    assert {tuple(r) for r in lines.near_lines(df, cut).collect()} == {("t", 0)}


def test_near_duplicates_of_every_excessive_line_and_templates(spark):
    """Lines that no document repeats literally, and near-duplicates of each of two excessive lines that share a bucket."""
    first = ["Alda", "Bea", "Cleo", "Dora", "Edda", "Fay", "Gwen", "Hal"]
    photo = [(f"p{i}", "a", "v", f"Photo: {f} {'Mid ' * (i % 3)}Roe for {f} Agency\n{f} Roe\n{f} Stands {i}", 0, "") for i, f in enumerate(first)]
    sign = [(f"q{i}", "b", "v", f"{f} Roe writes about the local game for {f} Press", 0, "") for i, f in enumerate(first)]
    rnd, sig, same = random.Random(3), lines.Signatures(), False
    while not same:  # two lines of little similarity that share both buckets, with their near-duplicates
        head = " ".join(rnd.choices("come to great fair of our town on green this week".split(), k=10))
        text, far = f"{head} and bring all of your friends with you", f"{head} until every last lamp is out for us"
        same = all(len(set(c.tolist())) == 1 for c in sig.of([x.split() for y in (text, far) for x in (y, y + " now")]))
    pairs = []
    for j, base in enumerate((text, far)):
        pairs += [(f"{j}r{i}", "c", "v", base, 0, "") for i in range(8)] + [(f"{j}near", "c", "v", base + " now", 0, "")]
    df = spark.createDataFrame(photo + sign + pairs, ART)
    got = {tuple(r) for r in lines.near_lines(df, cut).collect()}
    assert got == {(r[0], 0) for r in photo + sign} | {("0near", 0), ("1near", 0)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 4), st.integers(1, 3))
def test_automaton_covers_what_repeated_windows_cover(tokens, repeats, span):
    windows = [tuple(tokens[i : i + span]) for i in range(len(tokens) - span + 1)]
    want = bytearray(len(tokens))
    for i, w in enumerate(windows):
        if windows.count(w) >= repeats:
            want[i : i + span] = b"\1" * span
    if len(tokens) < span + repeats - 1:
        want = bytearray(len(tokens))
    assert spam.repeated_cover(tokens, repeats, span) == want
    assert spam.repeated_cover(tokens, repeats, span, longest=5) == want


def test_spam(spark):
    prose = "The coach praised the young keeper after the long game, and nobody in the hall disagreed. " * 2
    other = "It rained all evening. Still the stands were full, because the town had waited for this match since spring. A boy sold tea near the gate. "
    cases = {
        1: "cheap red shoes | best shoes shop | " * 40,
        2: "\n".join(f"SKU {i} | shoe | size M | ${i}.99" for i in range(30)),
        3: "\n".join(f"- Some title number {i} https://a.example/{i}" for i in range(30)),
        4: "#one #two #three " * 30,
        5: "Looking for red shoes? Our red shoes is the red shoes that red shoes fans want. Order red shoes with red shoes and save on red shoes. " * 12,
        6: "\n".join(f"Town{i} scarf ({i})" for i in range(60)),
    }
    fine = {
        11: other * 3 + prose,
        12: "",
        13: "cheap shoes",
        14: "\n".join(f"Player {i}, {i} yards | {i}.5 pct | {i} snaps" for i in range(30)),
        15: "\n".join(f"- A title {i} https://a.example/{i}\n{other}" for i in range(6)),
        16: other * 4 + "Go Reds! Go Reds! Go Reds! Go Reds! Go Reds! " + other,
        17: "> Wrapped words of a quoted sentence that go on\n> over several lines without an end until here.\n" * 6 + other,
    }
    data = [(k, t, "x", 1) for k, t in {**cases, **fine}.items()] + [(1, cases[1], "y", 2), (None, cases[1], "", 0), (20, None, "", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, words string, d bigint")
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == sorted(cases)
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_very_long_page():
    n, repeated, _, either = spam.spam_share("buy cheap shoes now " * 60_000)
    assert n == 240_000 and repeated > 0.99 and either > 0.99


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 4), st.integers(1, 3), st.integers(0, 30))
def test_cover_by_mass_against_brute_force(tokens, repeats, span, mass):
    n, want = len(tokens), bytearray(len(tokens))
    for k in range(span, n + 1):
        windows = [tuple(tokens[i : i + k]) for i in range(n - k + 1)]
        for i, w in enumerate(windows):
            if (c := windows.count(w)) >= repeats and c * k >= mass:
                want[i : i + k] = b"\1" * k
    assert spam.repeated_cover(tokens, repeats, span, mass=mass) == want
    assert spam.repeated_cover(tokens, repeats, span, longest=5, mass=mass) == want


LEGAL = (
    "The seller shall, unless the parties have agreed otherwise in writing before the goods were handed to the carrier, bear the cost of any return that the buyer makes within the period laid down above, and "
    "neither a delay for which a third person answers nor a defect that could have been seen when the goods were taken over relieves the seller of this duty or gives the buyer a claim to more than the price that was paid. "
    "Where a court of competent jurisdiction holds that a provision of this agreement cannot be enforced, what remains is to be read as if that provision had never been part of it, provided always that the purpose which "
    "both sides pursued when they signed is still served and that nobody is thereby put in a worse position than the one in which performance as first promised would have left them."
)


@pytest.mark.parametrize(
    "text,bad",
    [
        ("One coach in a small town told us over a long lunch that nothing in football ever stays the way it was. " * 12, True),
        ("他说这场比赛对球队非常重要。球迷们一早就来到了球场，天气很冷。教练对结果表示满意，但他也指出了问题。门将扑出了两个点球。最后时刻球队攻入制胜一球。", False),
        ("監督は試合後に選手たちを称えた。雨の中で行われた試合は最後まで目が離せなかった。観客は長い拍手を送った。次の試合は来週の土曜日に行われる。", False),
        ("नई टीम ने मैच जीता और दर्शक खुश हुए। कोच ने कहा कि यह एक कठिन दिन था और सभी ने मेहनत की। अगला मैच रविवार को शहर में होगा और टिकट बिक चुके हैं।", False),
        (LEGAL, False),
        ("red shoes, blue shoes, running shoes, cheap boots, best sandals, shoe shop, outlet, sale, coupon, free delivery, new trainers, kids shoes, wide fit, leather, suede, laces, insoles, polish, winter boots, discount code.", True),
    ],
)
def test_spam_in_any_language(text, bad):
    n, _, _, either = spam.spam_share(text)
    assert n >= 30 and (either > 0.5) == bad


def test_rotating_phrases_on_a_long_page():
    words = [f"w{i}" for i in range(4000)]
    phrases = [f"buy {c} shoes online" for c in "red blue green black white".split()]
    clauses = [f"{phrases[i % 5]} {' '.join(words[3 * i : 3 * i + 3])} {phrases[(i + 1) % 5]}." for i in range(200)]
    assert spam.spam_share(" ".join(clauses))[1] > 0.6 and spam.spam_share(" ".join(clauses[:20]))[1] > 0.6
    assert spam.spam_share(" ".join(f"{' '.join(words[12 * i : 12 * i + 12])}." for i in range(300)))[1] == 0
