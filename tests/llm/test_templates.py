"""Line templates against dictionaries."""

import collections

import xxhash

from tremorline.llm.templates import FIELD, _tokens, drop_recurring_lines


def plain(docs, depth=3, least=3, constant=0.5, similarity=0.6, agree=0.8):
    leaves, counts = collections.defaultdict(set), collections.defaultdict(collections.Counter)
    for row, (_, t) in enumerate(docs):
        seen = set()
        for line in (t or "").encode().split(b"\n"):
            if k := _tokens(line):
                leaf = (len(k), *k[:depth])
                leaves[leaf].add(row)
                if tuple(k) not in seen:
                    seen.add(tuple(k))
                    for j, x in enumerate(k):
                        counts[leaf, j][x] += 1
    templates = {}
    for leaf, where in leaves.items():
        fields, support = [], []
        for j in range(leaf[0]):
            c = counts[leaf, j]
            top = max(c, key=lambda x: (c[x], xxhash.xxh32_intdigest(x)))
            fields.append(top if c[top] > constant * sum(c.values()) and top != FIELD else None)
            support += [c[top]] * (fields[-1] is not None)
        if len(where) >= least and len(support) >= similarity * leaf[0] and min(support) >= least:
            templates[leaf] = fields
    out = []
    for d, t in docs:
        kept, dropped = [], []
        for n, line in enumerate((t or "").encode().split(b"\n")):
            k = _tokens(line)
            fields = templates.get((len(k), *k[:depth])) if k else None
            fixed = [(a, b) for a, b in zip(k, fields) if b is not None] if fields else []
            if fields and sum(a == b for a, b in fixed) >= agree * len(fixed):
                dropped.append(n)
            else:
                kept.append(line)
        out.append((str(d), b"\n".join(kept).decode(), dropped))
    return sorted(out)


def test_against_dictionaries(spark):
    lines = ["user {} logged in from host {}", "All rights reserved.", "The quick brown fox jumps over the {} dog today", "", "  "]
    docs = []
    for i in range(12):
        text = [lines[(i + k) % 5].format(i if k % 2 else "x" * (i % 4 + 1), f"10.0.0.{i}") for k in range(i % 5 + 1)]
        docs.append((i, "\n".join([*text, f"own line number of document {'abcdefghijkl'[i]} only", *(["a b c d e f"] * (i == 3) * 5)])))
    docs += [(20, None), (21, ""), (None, docs[2][1]), docs[4], (4, "another text\nAll rights reserved."), (22, "w " * 4000 + "\nAll rights reserved.")]
    df = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, n_lines int").repartition(4)
    got = drop_recurring_lines(df, min_docs=3)
    rows = sorted((str(r["doc_id"]), r["text"], r["dropped"]) for r in got.collect())
    assert rows == plain(docs)
    assert any(r[2] for r in rows) and any("another text" in r[1] for r in rows)
    assert not any("number of document" in r[1] for r in rows)  # one varying field is generalised
    assert drop_recurring_lines(df.limit(0)).count() == 0
