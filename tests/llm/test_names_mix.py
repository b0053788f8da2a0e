import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import mixing, names
from lexmill.session import cut


def test_bylines():
    p = names.parse_byline
    assert p("By Jane Q. Doe, Staff Writer")[:4] == ("person", "jane", "q", "doe")
    assert p("DOE, Jane")[:4] == ("person", "jane", "", "doe")
    assert p("JQ Doe")[:4] == ("person", "j", "q", "doe")
    assert p("A.K.P.") == ("acronym", "", "", "", ["akp"])
    assert p("The Daily Press")[0] == "org"
    for nobody in (None, "", "By", "N/A", "unknown", "http://x.example/author", "Jane Doe and Bob Roe", "Jane Doe & Bob Roe", "Jane Doe, Bob Roe"):
        assert p(nobody) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_edits_are_symmetric_and_bounded(a, b):
    assert names.edits(a, b, 2) == names.edits(b, a, 2) and (names.edits(a, b, 9) == 0) == (a == b)


def test_entities(spark):
    jane = ["Jane Mossbury", "By Jane Mossbury", "MOSSBURY, Jane", "J. Mossbury", "jane mossbury", "Jáne Mossbury", "Jane Mossbuyr", "Jane Mossbury, Staff Writer", "Jnae Mossbury", "Jane K. Mossbury"]
    rob = ["Robert Mossbury", "Bob Mossbury", "Mossbury, R.", "Rob Mossbury"]
    org = ["Daily Harbour Press Service", "Daily Harbour Press", "The Daily Harbour Press", "DHP", "Daily Harbour Prss"]
    other = ["Jane Mossbury and Robert Mossbury", "unknown", "", None, "http://x.example/a", "Jane Tillwood"]
    df = spark.createDataFrame([(v, "x", 1) for v in jane + rob + org + other + jane[:3]], "byline_raw string, value string, entity bigint")
    roster = spark.createDataFrame([("Robert", "Rob"), (None, "X")], "first_name string, football_name string")
    e = {}
    for r in names.entities(df, roster, cut).collect():
        e.setdefault(r.entity, set()).add(r.value)
    assert sorted(map(sorted, e.values())) == sorted(map(sorted, (set(jane), set(rob), set(org), {"Jane Tillwood"})))
    pairs = names.same_name_pairs(names.entities(df, roster, cut)).collect()
    assert len(pairs) == 45 + 6 + 10 and all(r.byline_a < r.byline_b for r in pairs)
    assert names.entities(df.limit(0), roster.limit(0), cut).count() == 0


def test_misspelt_tokens_by_ratio_not_number(spark):
    """A misspelling in four values, a right name in two, misspellings of misspellings, and as common names that stay apart."""
    forms = ["Jon {}", "By Jon {}", "J. {}", "{}, Jon", "jon {}", "Jon {}, Staff Writer", "JON {}", "Jon  {}"]
    often = [f.format("Smithers") for f in forms] + [f.format("Smtihers") for f in forms[:4]]
    rare = ["Kate Tillwood", "By Kate Tillwood", "Kate Tillwodo"]
    chain = [f.format(n) for n, k in (("Abcdefghijkl", 8), ("Bbcdefghijkl", 5), ("Bccdefghijkl", 3), ("Bcddefghijkl", 2), ("Bcdeefghijkl", 1)) for f in forms[:k]]
    apart = [[f.format(n) for f in forms] for n in ("Hansen", "Hanson")]
    df = spark.createDataFrame([(v,) for v in often + rare + chain + sum(apart, [])], "byline_raw string")
    e = {}
    for r in names.entities(df, None, cut, least=0.5).collect():
        e.setdefault(r.entity, set()).add(r.value)
    assert sorted(map(sorted, e.values())) == sorted(map(sorted, (often, rare, chain, *apart)))


def test_tokens_equal_the_public_tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = mixing.TokenCounter()
    for t in ["", "Hello  world's\n\n end   ", "naïve — Größe 123 4567 <|endoftext|>", "  \t a b", "𝔘nicode 日本語 " * 3, "x" * 5000]:
        assert c.count(t) == len(enc.encode_ordinary(t))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1000)), min_size=1, max_size=8), st.floats(1, 5000))
def test_water_fill(sources, budget):
    targets = {str(i): t for i, (t, _) in enumerate(sources)}
    caps = {str(i): c for i, (_, c) in enumerate(sources)}
    got = mixing.water_fill(targets, caps, budget)
    able = sum(caps[s] for s in targets if targets[s] > 0)
    assert sum(got.values()) == pytest.approx(min(budget, able), abs=1e-6 * (1 + budget))
    assert all(0 <= got[s] <= caps[s] * (1 + 1e-9) for s in got)
    free = [got[s] / targets[s] for s in got if targets[s] > 1e-9 and got[s] < caps[s] * (1 - 1e-9) and caps[s] > 0]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6)


def test_mix(spark):
    docs = [(i, "big" if i % 5 else "small", f"text number {i} " * (i % 7 + 1), "c") for i in range(1000)]
    docs += [docs[3], (5000, None, "lost", ""), (5001, "unwanted", "lost", ""), (5002, "big", None, ""), (None, "big", "x", ""), (5003, "zero", "some words", ""), (5004, "big", "", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("zero", 0.0, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix(df, t, budget=12_000, cut=cut)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big", "small", "zero", "gone"} and s["zero"].tokens == s["gone"].tokens == 0
    assert s["big"].tokens == pytest.approx(12_000 - s["small"].tokens, rel=0.02) and s["big"].actual_share == pytest.approx(s["big"].tokens / (s["big"].tokens + s["small"].tokens))
    rows = mix.collect()
    assert max(r.copies for r in rows if r.source == "small") <= 2 and {r.copies for r in rows if r.source == "big"} == {1} and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df, t, budget=12_000, cut=cut)[0].collect()))
    m0, s0 = mixing.mix(df.limit(0), t, cut=cut)
    assert m0.count() == 0 and s0.count() == 4
    assert mixing.mix(df, t.limit(0), cut=cut)[0].count() == 0
