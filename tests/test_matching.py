"""Matching, syndication, discovery: gates, and agreement with plain loops on random data full of copies."""

import math
import random
from datetime import datetime, timedelta

import pytest

from tremorline.functions import constants as C
from tremorline.operators.corroboration import apply_corroboration, corroboration_counts, provenance_rows
from tremorline.operators.dedup import exact_dedup, merge_page
from tremorline.operators.discovery import discover_novel
from tremorline.operators import discovery, earlier, matching, syndication
from tremorline.operators.matching import best_match
from tremorline.operators.syndication import RULES, syndication_rules

T0 = datetime(2025, 3, 15, 12)
ARTICLE = ("ord long, title string, latitude double, longitude double, occurred_at timestamp, event_type string, "
           "confidence_score double, location_precision string")
EVENT = ("id long, title string, latitude double, longitude double, occurred_at timestamp, event_type string, "
         "is_active boolean")


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1, h)))


def words(t):
    return {w for w in t.lower().split() if len(w) > 2 and w not in C.STOP_WORDS}


def sim(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(articles, events, hours=48, radius=50.0, threshold=0.4):
    out = {}
    for o, t, la, lo, ts, k, *_ in articles:
        best = None
        for i, t2, la2, lo2, ts2, k2, on in events:
            apart = abs((ts - ts2).total_seconds()) / 3600
            if not on or apart > hours:
                continue
            d, s = miles(la, lo, la2, lo2), sim(t, t2)
            ok = k2 in C.COMPATIBLE_TYPES.get(k, [k])
            if d > radius or s < (threshold if ok else threshold + 0.2):
                continue
            score = 0.5 * s + 0.3 * max(0, 1 - apart / hours) + 0.2 * max(0, 1 - d / radius)
            if best is None or (score, -i) > (best[0], -best[1]):
                best = (score, i)
        if best:
            out[o] = best
    return out


def matched(spark, articles, events, **kw):
    rows = best_match(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(events, EVENT), **kw).collect()
    return {r["ord"]: (r["score"], r["event_id"]) for r in rows}


def one_headline(n, seed, kinds=("protest",)):
    """``n`` articles and ``n`` incidents of one headline, all at places and times of their own near each other."""
    rnd = random.Random(seed)

    def row():
        return (47.6 + rnd.gauss(0, 0.1), -122.3 + rnd.gauss(0, 0.15), T0 + timedelta(seconds=rnd.randrange(-80000, 80000)),
                rnd.choice(kinds))

    title = "Protest march downtown seattle"
    return ([(o, title, *row(), 0.5, "city") for o in range(n)], [(i, title, *row(), rnd.random() < 0.95) for i in range(n)])


def test_best_of_one_headline_in_split_blocks(spark):
    articles, events = one_headline(300, 3, ("protest", "unrest", "political_violence"))
    events += [(1000 + k, *events[k % 7][1:]) for k in range(60)] + [(2000 + k, *articles[k][1:6], True) for k in range(0, 300, 9)]
    want, got = brute(articles, events), matched(spark, articles, events)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_one_headline_at_many_points_gives_a_linear_number_of_candidates(spark):
    per_article = []
    for n in (250, 1000):
        articles, events = one_headline(n, n)
        sides = matching._sides(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(events, EVENT), "ord")
        per_article.append(matching.candidates(*sides, 48, 50.0, 0.4).count() / n)
    assert per_article[1] < 1.5 * per_article[0] and per_article[1] < 100


def test_articles_with_a_close_incident_of_their_own_title_meet_no_other_titles(spark, monkeypatch):
    """Variants of one title, each with its own incident: n x n similar pairs, none of which can win."""
    met = []

    def counted(*args, real=matching.similar_sets, **more):
        titles = real(*args, **more)
        met.append(titles.count())
        return titles

    monkeypatch.setattr(matching, "similar_sets", counted)
    n = 60
    titles = [f"gamma delta epsilon zeta word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
    articles = [art(k, t) for k, t in enumerate(titles)]
    events = [ev(100 + k, t, ts=T0 + timedelta(minutes=k)) for k, t in enumerate(titles)]
    assert {o: i for o, (_, i) in matched(spark, articles, events).items()} == {k: 100 + k for k in range(n)}
    assert sum(met) <= n
    # an incident of another title wins where the own one is far, and on a tie the lowest id
    events = [ev(9, titles[0]), ev(8, titles[1]), *(ev(100 + k, t, ts=T0 + timedelta(hours=47)) for k, t in enumerate(titles))]
    got = matched(spark, articles, events)
    assert {o: i for o, (_, i) in got.items()} == {o: i for o, (_, i) in brute(articles, events).items()}
    assert got[0][1] == 9 and got[1][1] == 8 and got[2][1] == 8


def art(o, title="Protest march downtown seattle", lat=47.6, lon=-122.3, ts=T0, kind="protest"):
    return (o, title, lat, lon, ts, kind, 0.54, "city")


def ev(i, title="Protest march downtown seattle", lat=47.6, lon=-122.3, ts=T0, kind="protest", on=True):
    return (i, title, lat, lon, ts, kind, on)


GATES = [
    (ev(1), True), (ev(1, on=False), False), (ev(1, ts=T0 - timedelta(hours=48)), True),
    (ev(1, ts=T0 + timedelta(hours=48, seconds=1)), False), (ev(1, lat=48.3), True), (ev(1, lat=48.4), False),
    (ev(1, title="Something else entirely different"), False), (ev(1, kind="political_violence"), True),
    # three of five words shared: 0.6 is below 0.4 + 0.2 in doubles, so incompatible types do not match
    (ev(1, title="Protest march downtown portland", kind="political_violence"), False),
    (ev(1, title="Protest march downtown portland", kind="unrest"), True), (ev(1, title=""), False)]


def test_few_articles_meet_titles_in_one_step_and_titles_do_not_travel_with_rows(spark, monkeypatch):
    """Fails if the titles of all incidents are sent out twice for few articles, or with every row."""
    rng = random.Random(8)
    names = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta"]
    events = [(i, " ".join(rng.sample(names, 5)), 40.0 + rng.random() / 2, -75.0, T0 + timedelta(minutes=37 * i % 3000), "riot", True)
              for i in range(200)]
    articles = [(i, " ".join(rng.sample(names, 5)), 40.2, -75.0, T0 + timedelta(hours=6 * i), "riot", 0.5, "city") for i in range(6)]
    steps, cuts = [], []
    similar, cut = matching.similar_sets, matching.cut_lineage
    monkeypatch.setattr(matching, "similar_sets", lambda *a, **k: steps.append(a[4]) or similar(*a, **k))
    monkeypatch.setattr(matching, "cut_lineage", lambda df: cuts.append(set(df.columns)) or cut(df))
    found, want = matched(spark, articles, events), brute(articles, events)
    assert {o: i for o, (_, i) in want.items()} == {o: (f if isinstance(f, int) else f[1]) for o, f in found.items()}
    assert steps == [0.4] and not any({"title", "latitude"} <= c for c in cuts)


def test_gates(spark):
    """Each case in its own part of the world, 10 degrees of longitude apart."""
    articles = [art(i, lon=-122.3 + 10 * i) for i in range(len(GATES))]
    events = [(i, e[1], e[2], -122.3 + 10 * i, *e[4:]) for i, (e, _) in enumerate(GATES)]
    got = matched(spark, articles, events)
    assert [i in got for i in range(len(GATES))] == [hit for _, hit in GATES]


def test_ties_go_to_the_lowest_id_and_nearest_time_wins(spark):
    events = [ev(5), ev(3), ev(9, ts=T0 + timedelta(hours=1))]
    assert matched(spark, [art(1), art(2, ts=T0 + timedelta(minutes=50))], events)[1][1] == 3
    assert matched(spark, [art(2, ts=T0 + timedelta(minutes=50))], events)[2][1] == 9
    both = [ev(7, ts=T0 - timedelta(hours=20)), ev(6, ts=T0 + timedelta(hours=20))]
    assert matched(spark, [art(1)], both)[1][1] == 6


@pytest.mark.parametrize("seed,threshold", [(1, 0.4), (2, 0.2), (3, 0.75)])
def test_agrees_with_loops(spark, seed, threshold):
    rnd = random.Random(seed)
    vocabulary = [f"word{chr(97 + i)}" for i in range(14)]
    places = [(47.6, -122.3), (47.61, -122.2), (48.1, -122.3), (45.5, -122.6), (0.0, 179.9), (0.1, -179.9), (47.6, -121.3)]
    kinds = list(C.COMPATIBLE_TYPES)

    def title():  # a third of all rows share one headline
        return "worda wordb wordc wordd" if rnd.random() < 0.33 else " ".join(rnd.sample(vocabulary, rnd.randint(1, 6)))

    def when():
        return T0 + timedelta(seconds=rnd.choice([0, 60, 3600]) * rnd.randint(-200, 200))

    articles = [(o, title(), *rnd.choice(places), when(), rnd.choice(kinds), 0.5, "city") for o in range(150)]
    events = [(i, title(), *rnd.choice(places), when(), rnd.choice(kinds), rnd.random() < 0.9) for i in range(400)]
    want = brute(articles, events, threshold=threshold)
    got = matched(spark, articles, events, threshold=threshold)
    assert {o: i for o, (_, i) in got.items()} == {o: i for o, (_, i) in want.items()}
    assert all(got[o][0] == pytest.approx(want[o][0]) for o in want)


SOURCE = ("event_id long, position long, source_name string, source_url string, source_title string, "
          "source_published_at timestamp, event_uri string")


def src(position, name=None, url=None, title=None, ts=None, uri=None, event=1):
    return (event, position, name, url, title, ts, uri)


def rules(spark, rows):
    got = syndication_rules(spark.createDataFrame(rows, SOURCE)).collect()
    return {(r["event_id"], r["position"]): {k for k in RULES if r[k]} for r in got}


TITLE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


RULE_CASES = [
    (src(1, "Seattle Times"), src(2, "seattle times"), {"same_outlet"}),
    (src(1, ""), src(2, ""), set()), (src(1), src(2), set()),
    (src(1, "AP News"), src(2, "Associated Press"), {"same_family"}),
    (src(1, "AP News", uri="eng-1"), src(2, "Associated Press", uri="eng-1"), {"same_family", "same_upstream_event"}),
    (src(1, "A1", uri="eng-1"), src(2, "B2", uri="eng-1"), set()),
    (src(1, url="https://apnews.com/a"), src(2, url="https://www.apnews.com/b"), {"same_wire_domain"}),
    (src(1, url="https://local.com/a"), src(2, url="https://local.com/b"), set()),
    (src(1, title=TITLE), src(2, title=TITLE.upper()), {"near_identical_title"}),
    (src(1, title=TITLE), src(2, title=TITLE + " lambda"), {"near_identical_title"}),
    (src(1, title=TITLE), src(2, title=TITLE + " lambda omicron"), set()),                       # 10 of 12
    (src(1, title=TITLE, ts=T0), src(2, title=TITLE + " lambda omicron", ts=T0 + timedelta(minutes=30)), {"rapid_rewrite"}),
    (src(1, title=TITLE, ts=T0), src(2, title=TITLE + " lambda omicron", ts=T0 - timedelta(minutes=29)), {"rapid_rewrite"}),
    (src(1, title=TITLE, ts=T0), src(2, title=TITLE + " lambda omicron", ts=T0 + timedelta(minutes=31)), set()),
    (src(1, "Reuters", event=1), src(2, "Reuters", event=2), set())]


def test_rules(spark):
    """Each case with incidents of its own."""
    rows = [(100 * i + r[0], *r[1:]) for i, (a, b, _) in enumerate(RULE_CASES) for r in (a, b)]
    got = rules(spark, rows)
    for i, (first, second, want) in enumerate(RULE_CASES):
        assert got[(100 * i + first[0], 1)] == set(), i
        assert got[(100 * i + second[0], 2)] == want, i


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_agree_with_loops(spark, seed):
    rnd = random.Random(seed)
    base = [w for w in TITLE.split()]
    rows = []
    for position in range(120):
        event = 1 if rnd.random() < 0.4 else rnd.randint(2, 5)
        title = " ".join(rnd.sample(base, rnd.randint(6, 10))) if rnd.random() < 0.9 else None
        ts = T0 + timedelta(minutes=rnd.randint(0, 300)) if rnd.random() < 0.9 else None
        rows.append(src(position, None, None, title, ts, None, event))
    got = rules(spark, rows)
    for n in rows:
        earlier = [e for e in rows if e[0] == n[0] and e[1] < n[1]]
        close = [e for e in earlier if e[5] and n[5] and abs((e[5] - n[5]).total_seconds()) <= 1800]
        want = set()
        if any(sim(e[4] or "", n[4] or "") > 0.85 for e in earlier):
            want.add("near_identical_title")
        if any(sim(e[4] or "", n[4] or "") > 0.70 for e in close):
            want.add("rapid_rewrite")
        assert got[(n[0], n[1])] == want, n


def test_corroboration(spark):
    judged = syndication_rules(spark.createDataFrame(
        [src(1, "Times"), src(2, "times"), src(3, "Herald"), src(4, "Globe"), src(5, "Reuters", event=2)], SOURCE))
    rows = provenance_rows(judged, "2025-03-15")
    counts = corroboration_counts(rows)
    assert {r["event_id"]: (r["independent"], r["syndicated"]) for r in counts.collect()} == {1: (3, 1), 2: (1, 0)}
    events = spark.createDataFrame([(1, 1, 0.5), (2, None, 0.99), (3, 2, 0.333)],
                                   "id long, source_count int, confidence_score double")
    got = {r["id"]: (r["source_count"], r["confidence_score"]) for r in apply_corroboration(events, counts).collect()}
    assert got[1] == (4, pytest.approx(0.74)) and got[2] == (2, 1.0) and got[3] == (2, 0.333)


def sequential_discovery(articles, events, cap):
    known, opened, result = list(events), [], {}
    for a in articles:
        hit = brute([a], known).get(a[0])
        if hit:
            result[a[0]] = hit[1]
        elif len(opened) < cap:
            new = 1000 + len(opened) + 1
            opened.append((new, a[0]))
            known.append((new, a[1], a[2], a[3], a[4], a[5], True))
    return opened, result


def variants(n, times=True):
    """One incident with ``n`` variants of a headline: three of fourteen words differ from one to the next."""
    rnd = random.Random(n)
    words = [f"w{a}{b}" + "x" for a in "abcdefgh" for b in "abcdefgh"]
    base = rnd.sample(words, 14)
    out = []
    for position in range(n):
        title = list(base)
        for at in rnd.sample(range(14), 2):
            title[at] = rnd.choice(words)
        ts = T0 + timedelta(seconds=rnd.randrange(4 * 3600)) if times else None
        out.append(src(position, None, None, " ".join(title), ts))
    return out


def test_variants_of_one_headline_agree_with_loops(spark):
    rows = variants(160) + [src(500 + i, title=f"other{chr(97 + i % 9)} headline{chr(97 + i // 9)} about something quite new") for i in range(40)]
    got = rules(spark, rows)
    for n in rows:
        earlier = [e for e in rows if e[1] < n[1]]
        close = [e for e in earlier if e[5] and n[5] and abs((e[5] - n[5]).total_seconds()) <= 1800]
        want = {"near_identical_title"} if any(sim(e[4], n[4]) > 0.85 for e in earlier) else set()
        want |= {"rapid_rewrite"} if any(sim(e[4], n[4]) > 0.7 for e in close) else set()
        assert got[n[0], n[1]] == want


def test_words_of_sources_travel_as_numbers_and_incidents_stay_apart(spark, monkeypatch):
    kinds = []

    def seen(rows, *args, real=earlier.with_earlier):
        kinds.append(dict(rows.dtypes))
        return real(rows, *args)

    monkeypatch.setattr(syndication, "with_earlier", seen)
    near = TITLE + " lambda"
    got = rules(spark, [src(1, title=TITLE, ts=T0), src(2, title=near, ts=T0, event=2), src(3, title=near, ts=T0),
                        src(4, title=TITLE, ts=T0, event=2), src(5, title=TITLE, ts=T0, event=3)])
    both = {"near_identical_title", "rapid_rewrite"}
    assert got == {(1, 1): set(), (2, 2): set(), (1, 3): both, (2, 4): both, (3, 5): set()}
    assert len(kinds) == 2 and all(k["ordered"] == "array<bigint>" and "string" not in k.values() for k in kinds)


def test_variants_of_one_headline_are_compared_a_few_times_each(spark, monkeypatch):
    compared = []

    def counted(*args, real=earlier._compared):
        pairs = real(*args)
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(earlier, "_compared", counted)
    each = {}
    for n in (200, 800):
        sets = [(i, 1, i, sorted(words(r[4]))) for i, r in enumerate(variants(n))]
        df = spark.createDataFrame(sets, "k long, event_id long, position long, ordered array<string>")
        assert earlier.with_earlier(df, ["event_id"], 0.7).count() > 0.9 * n
        each[n] = sum(compared) / n
        compared.clear()
    assert each[800] < 2 * each[200] and each[800] < 100


@pytest.mark.parametrize("cap", [3, 50])
def test_discovery_agrees_with_the_sequential_rule(spark, cap):
    rnd = random.Random(cap)
    vocabulary = [f"word{chr(97 + i)}" for i in range(9)]
    places = [(47.6, -122.3), (45.5, -122.6)]

    def row():
        return (" ".join(rnd.sample(vocabulary, 4)), *rnd.choice(places), T0 + timedelta(hours=rnd.randint(0, 60)), "protest")

    articles = [(o, *row(), 0.8, "city") for o in range(1, 41)]
    events = [(i, *row(), True) for i in range(8)]
    want_opened, want = sequential_discovery(articles, events, cap)
    leaders, matches = discover_novel(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(events, EVENT),
                                      max_new=cap, id_offset=1000)
    rows = leaders.orderBy("id").collect()
    assert [(r["id"], r["ord"]) for r in rows] == want_opened
    assert all(r["confidence_score"] == pytest.approx(0.58) for r in rows)
    assert {r["ord"]: r["event_id"] for r in matches.collect()} == want


def test_a_bounded_discovery_takes_up_heads_of_the_feed(spark, monkeypatch):
    """Head after head of the feed, until enough have opened or all of it was taken: the same as without heads."""
    monkeypatch.setattr(discovery, "HEAD", 2)
    monkeypatch.setattr(discovery, "GROWTH", 2)
    asked = []

    def counted(waiting, real=discovery.openers):
        asked.append(waiting.count())
        return real(waiting)

    monkeypatch.setattr(discovery, "openers", counted)
    titles = ["red green blue", "red green blue", "one two three", "red green blue", "north south east", "lion tiger bear"]
    articles = [art(o, t) for o, t in enumerate(titles, 1)]
    for cap, parts, want in ((2, [4], [1, 3]), (3, [6], [1, 3, 5]), (9, [6], [1, 3, 5, 6])):
        leaders, matches = discovery.discover_novel(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame([], EVENT), cap)
        assert [r["ord"] for r in leaders.orderBy("id").collect()] == want and asked == parts
        assert {r["ord"] for r in matches.collect()} == {2, 4}
        asked.clear()


def test_exact_dedup(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, ""), (6, ""), (7, "b"), (8, "c")],
                                  "ord int, source_id string")
    stored = spark.createDataFrame([("b",), (None,), ("",)], "source_id string")
    assert sorted(r["ord"] for r in exact_dedup(batch, stored, ["ord"]).collect()) == [1, 3, 4, 5, 6, 8]


def test_merge_page(spark):
    a = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "id long, v string")
    assert {(r["id"], r["v"]) for r in merge_page(a, b).collect()} == {(1, "old"), (2, "old"), (3, "new")}


def test_no_pairing_in_the_plan(spark):
    """No Cartesian product or nested loop in the matching plan."""
    a = spark.createDataFrame([art(1)], ARTICLE)
    e = spark.createDataFrame([ev(1)], EVENT)
    plan = best_match(a, e)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
