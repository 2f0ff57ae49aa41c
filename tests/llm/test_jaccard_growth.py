"""What keeps op9's shuffles in proportion to what sets share."""

import io
import random
from contextlib import redirect_stdout

from microtide.llm import jaccard


def stars(spark, sets, pivot, roots):
    full = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "cid long, set array<long>")
    pairs = spark.createDataFrame([(pivot, k, roots.get(k, k)) for k in sets if k != pivot], "a long, b long, r long")
    return jaccard._differences(pairs, full, jaccard.THRESHOLD)


def test_members_that_cannot_link_leave_no_tokens(spark):
    shared = set(range(40))
    sets = {0: shared | set(range(100, 160))}
    sets |= {k: shared | set(range(1000 * k, 1000 * k + 60)) for k in range(1, 6)}  # share only what the pivot has
    sets |= {8: shared | set(range(8000, 8060)), 9: shared | set(range(8001, 8061))}  # link to each other
    sets |= {10: shared | set(range(9000, 9060)), 11: shared | set(range(9001, 9061))}  # link, and are known to
    got = {x.b: x for x in stars(spark, sets, 0, {11: 10}).collect()}
    assert set(got) == {8, 9}
    assert all(x.far and x.alone == 120 - len(x.ordered) and x.alone < x.ends for x in got.values())


def test_sets_that_share_too_little_leave_before_any_difference(spark, monkeypatch):
    r, made, real = random.Random(9), [], jaccard._differences
    line = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    texts = [line("hot", 60) + " " + line(f"own{k}", 30) for k in range(30)]  # a third of each is its own
    texts += [line("hot", 60) + " " + line("pair", 30) + f" end{k}" for k in range(2)]
    monkeypatch.setattr(jaccard, "_differences", lambda stars, full, t: made.extend(stars.collect()) or real(stars, full, t))
    r.shuffle(texts)
    rows = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pair = {i for i, x in enumerate(texts) if "pair" in x}
    assert not made and {x.doc_id: x.component_id for x in rows} == {i: min(pair) if i in pair else i for i in range(32)}


def test_sharing_keeps_all_that_link(spark):
    r, t = random.Random(6), jaccard.THRESHOLD
    base = [r.sample(range(10_000), 150) for _ in range(12)]
    sets = {0: set(base[0])}
    for k in range(1, 90):
        sets[k] = set(base[k % 12]) ^ set(r.sample(range(10_000), r.choice([2, 10, 30, 90])))
    sets |= {k: sets[k - 90] | set(base[0][:100]) | set(range(200_000 + 300 * k, 200_000 + 300 * k + 200)) for k in range(90, 120)}
    roots = {k: k % 12 for k in range(1, 60)}
    link = lambda x, y: t.denominator * len(x & y) >= t.numerator * len(x | y)
    root = lambda k: roots.get(k, k)
    want = {k for a in sets for b in sets if 0 < a < b and root(a) != root(b) and link(sets[a], sets[b]) for k in (a, b)}
    full = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "cid long, set array<long>")
    members = spark.createDataFrame([(0, k, root(k)) for k in sets if k], "a long, b long, r long")
    kept = {x.b for x in jaccard._sharing(members, full, t).collect()}
    assert want and want <= kept and not kept & set(range(90, 120))


def test_no_link_between_components_is_lost(spark):
    r, t = random.Random(5), jaccard.THRESHOLD
    base = [r.sample(range(10_000), 200) for _ in range(4)]
    sets = {0: set(base[0])}
    for k in range(1, 120):
        own, part = base[k % 4], r.choice([0, 40, 120])
        of = set(own[part:]) | set(r.choice(base)[:part])
        for _ in range(r.choice([2, 8, 14, 20, 40])):
            of ^= {r.choice(own + r.sample(range(20_000), 20))}
        sets[k] = of
    for k in range(120, 140, 2):  # one that links to the pivot, and one that only links to that
        gone = r.sample(base[0], 28)
        sets[k] = set(base[0]) - set(gone[:14]) | {100_000 + 100 * k + i for i in range(14)}
        sets[k + 1] = sets[k] - set(gone[14:]) | {200_000 + 100 * k + i for i in range(14)}
    link = lambda x, y: t.denominator * len(x & y) >= t.numerator * len(x | y)
    near = {k for k in sets if link(sets[k], sets[0])}
    roots = {k: 0 for k in near}
    want = {(a, b) for a in sets for b in sets if 0 < a < b and roots.get(a, a) != roots.get(b, b) and link(sets[a], sets[b])}
    found = {(x.a, x.b) for x in jaccard._across(stars(spark, sets, 0, roots), t).collect()}
    assert want <= found and len(near) > 5 and {a in near or b in near for a, b in want} == {True, False}


def test_prefix_tokens_are_counted_and_kept_in_one_shuffle(spark):
    reps = spark.createDataFrame([(1, 3, [1, 2, 5]), (2, 2, [2, 5]), (3, 1, [5]), (4, 1, [9])], "cid long, n int, prefix array<long>")
    rows, out = jaccard._prefix_rows(reps), io.StringIO()
    with redirect_stdout(out):
        rows.explain()
    assert "Join" not in out.getvalue()
    assert {x.cid: [tuple(s) for s in x.shared] for x in rows.collect()} == {1: [(2, 2, 1), (3, 5, 2)], 2: [(2, 2, 0), (3, 5, 1)], 3: [(3, 5, 0)]}
