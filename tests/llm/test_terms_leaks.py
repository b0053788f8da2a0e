import random
import unicodedata
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import leaks, terms

ART = "slug string, body string, term string, k string, occurrences bigint"
VOICE = "run_id string, term string, r string, z double"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcé1", min_size=0, max_size=6), max_size=300))
def test_trie_counts_like_a_counter(words):
    trie = terms.BurstTrie(burst=4)
    half = len(words) // 2
    for part in (words[:half], words[half:]):
        c = Counter(part)
        trie.add(c, Counter(set(part)))
    got = {t: (n, r) for t, n, r in trie.items()}
    want = Counter(words)
    assert {t: n for t, (n, _) in got.items()} == dict(want)
    assert all(r == (t in words[:half]) + (t in words[half:]) for t, (_, r) in got.items())


def test_words():
    assert terms.words_of("Ca­fé x​y_z ½ 3.5") == [unicodedata.normalize("NFC", "café"), "xy", "z", "½", "3", "5"]


def test_frequencies(spark):
    a = spark.createDataFrame([("a", "one two two", "t", None, 1), ("a", "one two two", "other", None, 2), ("b", "one three", "t", "", 3), ("c", "One", None, None, None), ("d", None, "t", None, 1), (None, "lost", "t", None, 1), ("e", "", "", "", 0)], ART)
    v = spark.createDataFrame([("r1", " A  b", "x", 1.0), ("r1", "a B", "x", 1.0), ("r2", "a b", None, None), ("r3", None, None, None), (None, "q", None, None), ("r3", "  ", None, None)], VOICE)
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(a, v).collect()}
    assert got[("articles.body", "one")] == (3, 3, None) and got[("articles.body", "two")] == (2, 1, "rare")
    assert got[("analysis_voice.term", "a b")] == (3, 2, "rare") and ("articles.body", "lost") not in got and len(got) == 4
    empty = terms.term_frequencies(a.limit(0), v.limit(0))
    assert empty.count() == 0
    # A small limit flushes the trie often and changes nothing.
    assert {tuple(r) for r in terms.count_words(a, "slug", "body", limit=1).collect()} == {("one", 3, 3), ("two", 2, 1), ("three", 1, 1)}


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 30)))) for i in range(12)]
    docs = []
    for d in range(80):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(60))]
        if d % 3 == 0:
            src = rnd.choice(items)[1].split()
            k = rnd.randrange(5, 16)
            at = rnd.randrange(max(1, len(src) - k))
            w[10:10] = [x.upper() for x in src[at : at + k]]
        docs.append((d, ", ".join(w), "x", d))
    n = 10
    want = set()
    for d, t, *_ in docs:
        w = leaks.words_of(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, s in items:
            v = leaks.words_of(s)
            if any(tuple(v[j : j + n]) in grams for j in range(len(v) - n + 1)):
                want.add((d, i))
    docs += [(None, "x", "", 0), (200, None, "", 0), (201, "", "", 0), docs[0], (300, "word " * 200_000, "", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, d bigint")
    ev = spark.createDataFrame([*items, (None, "a"), (99, None)], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(df, ev).collect()} == want
    assert {tuple(r) for r in leaks.leaks(df, ev, block_chars=150).collect()} == want
    assert leaks.leaks(df.limit(0), ev).count() == 0 and leaks.leaks(df, ev.limit(0)).count() == 0
