import numpy as np
import pytest

from lexmill.llm import boilerplate as bp

ART = "slug string, body string, selector string, line_no bigint"
PROV = "slug string, body_selector string, retrieved_at string, prov_id bigint, body string"


def test_trees_learn_and_repeat():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0)).astype(float)
    t = bp.fit_trees(x[:3000], y[:3000], rounds=80)
    assert ((t.log_odds(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.93
    assert np.array_equal(t.log_odds(x), bp.fit_trees(x[:3000], y[:3000], rounds=80).log_odds(x))
    assert bp.fit_trees(x[:0], y[:0]).log_odds(x[:5]).max() < 0
    assert bp.fit_trees(x[:50], np.ones(50)).log_odds(x[:5]).min() > 0


def test_blocks():
    body = "Home\nNews\nA first paragraph of the story that ends.\nMost Read\n- Team one beat team two in Town 3h ago\nA teaser stands here between.\n- Why the other lost their game (video)\nThe story goes on and on.\n12 comments\nfan12: Well said by all of us here.\nPoll: will they win?\n- Yes\n- No\n77 votes"
    _, lines = bp._read(body, {})
    got = [(lines[a].text.split()[0], e - a, k) for a, e, k in bp.blocks_of(lines)]
    assert ("Most", 4, "list") in got and ("12", 2, "thread") in got and ("Poll:", 4, "poll") in got
    assert sum(e - a for a, e, _ in bp.blocks_of(lines)) == len(lines)


def test_decoding_keeps_blocks_whole():
    blocks = [(0, 1, "line"), (1, 4, "list"), (4, 7, "run")]
    got = bp.decode(np.array([-1.0, 3.0, 4.0, -0.5, -4.0, -3.0, 1.0]), blocks)
    assert got.tolist() == [False, True, True, True, False, False, False]


def _pages(n):
    rnd = np.random.default_rng(7)
    own = ["The coach said the young side had earned the point.", "Rain fell over the ground until the second half began.", "Nope.", "## What we learned", "He never accepted all of it."]
    rows = []
    for i in range(n):
        body = [f"Paragraph {i} tells how the visitors went ahead in the ninth minute, and nobody was surprised by it."]
        body += [own[k] for k in rnd.integers(0, len(own), 3)]
        gone = []
        for extra in ("Share this story with your league", "We use cookies to remember your settings.", "© 2014 Some Media Group. All rights reserved.", "Back to top", "By Jane Doe"):
            if rnd.random() < 0.5:
                gone.append(len(body))
                body.append(extra)
        rows.append((f"s{i}", "\n".join(body), gone))
    return rows


def test_pages(spark):
    rows = _pages(300)
    data = [(s, b, "x", 1) for s, b, _ in rows] + [(rows[0][0], rows[0][1], "again", 2), (None, "x", "", 0), ("null", None, "", 0), ("empty", "", "", 0), ("blank", " \n \n", "", 0), ("long", "A very long line. " * 100_000, "", 0)]
    a = spark.createDataFrame(data, ART)
    p = spark.createDataFrame([(s, ".body", "2024", i, "x") for i, (s, _, _) in enumerate(rows[:50])] + [("s1", None, None, None, None), (None, "x", "", 1, "")], PROV)
    got = {tuple(r) for r in bp.boilerplate_lines(a, p).collect()}
    want = {(s, i) for s, _, gone in rows for i in gone}
    assert len(got & want) / len(got | want) > 0.98
    body = {r.slug: r.body for r in bp.main_bodies(a, p).collect()}
    assert body["null"] is None and body["empty"] == "" and "©" not in "".join(b or "" for b in body.values())
    assert bp.boilerplate_lines(a.limit(0), p.limit(0)).count() == 0


@pytest.mark.parametrize("text,bad", [("By Jane Doe | Some Post", True), ("By Friday, the coach had changed his mind about the plan.", False), ("Read more into it if you like, the coach shrugged.", False), ("1,234 votes", True)])
def test_labels(text, bad):
    _, lines = bp._read(text, {})
    assert bp.labels(lines, bp.blocks_of(lines)) == [bad]


@pytest.mark.parametrize("n", [1, 501])
def test_clean_pages_only(spark, n):
    a = spark.createDataFrame([(f"s{i}", f"The visitors went ahead in minute {i}, and nobody was surprised by it.", "", 0) for i in range(n)], ART).coalesce(1)
    p = spark.createDataFrame([], PROV)
    assert bp.boilerplate_lines(a, p).count() == 0
    bodies = bp.main_bodies(a, p).collect()
    assert len(bodies) == n and all("minute" in r.body for r in bodies)


def test_clean_slice_beside_others(spark):
    never = bp.Trees(-1.0, [])
    mixed = bp.Trees(-1.0, [(np.array([4, -1, -1], dtype=np.int32), np.array([3.5, 0, 0], dtype=np.float32), np.array([1, 0, 0], dtype=np.int32), np.array([0, -1.0, 5.0]), 1)])
    a = spark.createDataFrame([(f"s{i:04}", "One sentence of a page." if i < 600 else "a, b, c, d, e", "", 0) for i in range(700)], ART).coalesce(1)
    p = spark.createDataFrame([], PROV)
    assert bp.boilerplate_lines(a, p, never).count() == 0
    assert bp.boilerplate_lines(a, p, mixed).count() == 100


def test_all_pages_are_learned_from(spark):
    """A kind of line on 12 of 9,000 pages, none of which a sample of 6,000 by the slug's hash holds."""
    drawn = spark.range(9000).selectExpr("concat('s', id) as slug", "xxhash64(11, concat('s', id)) / 18446744073709551616D + 0.5D as part").collect()
    rare = [r.slug for r in drawn if r.part > 6000 / 9000][:12]
    rows = []
    for i, r in enumerate(drawn):
        body = [f"Paragraph {i} tells how the visitors went ahead in the ninth minute, and nobody was surprised by it."]
        body += ["Share this story with your league"] * (i % 3 == 0) + ["Rain fell over the ground until the half began."] * (i % 2) + ["The winger's zither quartet oboes"] * (i % 1800 == 1)
        rows.append((r.slug, "\n".join([*body, "Photograph: zq pool wire"] if r.slug in rare else body), "", 0))
    a = spark.createDataFrame(rows, ART)
    got = {tuple(r) for r in bp.boilerplate_lines(a, spark.createDataFrame([], PROV)).collect()}
    assert {(s, b.count("\n")) for s, b, *_ in rows if s in rare} <= got
    assert {(s, 1) for i, (s, *_) in enumerate(rows) if i % 3 == 0} <= got and not any(k == 0 for _, k in got)


def test_tasks_that_add_up_grow_the_same_trees(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(45_000, bp.N_FEATURES)).astype(np.float32)
    x = bp.value_of(bp.code_of(x))
    y = (x[:, 0] + x[:, 3] > 0.4) ^ (x[:, 7] > 1)
    salt = np.arange(len(x), dtype=np.uint32)
    df = spark.createDataFrame([(f"s{k}", bp.code_of(x[k : k + 500]).tobytes(), y[k : k + 500].tobytes(), salt[k : k + 500].tobytes()) for k in range(0, len(x), 500)], "slug string, x binary, y binary, salt binary")
    edges = [bp.edges_of(*np.unique(x[:, f], return_counts=True), 48) for f in range(bp.N_FEATURES)]
    two, one = bp.fit_rows(df, edges, len(x), int(y.sum()), rounds=6), bp.fit_trees(x, y.astype(float), rounds=6)
    assert all(np.array_equal(a, b) for t, u in zip(two.trees, one.trees) for a, b in zip(t[:3], u[:3]))
    assert np.abs(two.log_odds(x) - one.log_odds(x)).max() < 1e-5
