"""Preference pairs against a loop."""

import random

from tremorline.llm.chat import preference_pairs


def plain(chosen, rejected, segment):
    def turns(table, pair):
        rows = [(t, r or "", x or "") for p, t, r, x in table if p == pair]
        return [(r, x) for t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))]

    def text(rows):
        return "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in rows)

    def mask(rows):
        at, out = 0, []
        for r, x in rows:
            start = at + len(r) + 5
            if r == "assistant":
                out.append(f"{start}-{start + len(x) + 8}")
            at = start + len(x) + 8
        return ",".join(out)

    result = []
    for pair in {p for p, *_ in chosen + rejected}:
        c, r = turns(chosen, pair), turns(rejected, pair)
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        parts = (c[:n], c[n:], r[n:])
        for s in range(max(-(-len(p) // segment) for p in parts)):
            a, b, d = (p[s * segment:(s + 1) * segment] for p in parts)
            result.append((pair, s, n, text(a), text(b), text(d), mask(b), mask(d)))
    return sorted(result, key=str)


def test_against_loop(spark):
    rng = random.Random(12)
    chosen, rejected = [], []
    for pair in [*range(25), None]:
        base = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "", None, "é€", "long text"])) for k in range(rng.randint(0, 9))]
        cut = rng.randint(0, 9)
        other = base[:cut] + [(k, "assistant", f"no {k}") for k in range(cut, cut + rng.randint(0, 3))]
        chosen += [(pair, *t) for t in base]
        rejected += [(pair, *t) for t in other]
    chosen += [(77, 1, "user", "a"), (77, 1, "user", "a"), (77, None, "assistant", "b"), (78, 5000, "user", "late"), (78, 1, "user", "early")]
    schema = "pair_id long, turn long, role string, text string"
    c, r = spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)
    for segment in (2, 4096):
        got = preference_pairs(c.selectExpr("*", "1 AS place", "'x' AS side"), r, segment)
        assert got.columns[:3] == ["pair_id", "segment", "n_prompt_turns"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == plain(chosen, rejected, segment)
    assert preference_pairs(c.limit(0), r.limit(0)).count() == 0
