"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Shingles are 64-bit hashes (equal hashes count as equal shingles), ordered by hash. Texts with
the same set form one class; from there on each class is one row.

Two sets of Jaccard similarity >= t share, for any l, at least l of the tokens in their
l-prefixes: the n - ceil(t * n) + l first tokens of each. So each set leaves out the l - 1 most
frequent tokens of its l-prefix, and every such pair still meets in the rarest token that it
shares. A longer prefix costs rows, but passages that many documents share drop out of it.
Every set picks the l (of LEVELS) with the fewest estimated candidates and looks up the
larger sets' l-prefixes; its own may be shorter, since the overlap with a set at least as large
is at least 2 * t / (1 + t) of its tokens. Pairs found that share at least l prefix tokens, for
the largest l that both have, are verified on the whole sets.

Where many sets meet in one token, pairs aren't all made: all members are compared with the
most central one, the pivot. What these links and all others leave in different components is
then compared by differences from the pivot: if x and y link and one of them doesn't link to p,
the symmetric differences of x and p and of y and p overlap, the more so the further off both
are. So the same prefix filter runs on the differences, which for near copies are small and
hardly shared, and whose tokens are ordered by frequency within the pivot's members.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microtide.llm.common import ascii_lower, free, identity, materialize, release, table, words

SHINGLE = 4
THRESHOLD = Fraction(85, 100)
#: Multi-match levels. A level may be SHORT_SHARE of a set's size up to SHORT_LEVEL, beyond that LEVEL_SHARE.
LEVELS = (1, 2, 4, 8, 16, 32, 64, 256, 1024, 4096)
SHORT_LEVEL, SHORT_SHARE, LEVEL_SHARE = 64, 0.2, 0.05
#: A token that more sets meet in is compared by way of a central member.
STAR = 12
#: Parts by hash in which the tokens of the members of large buckets are gone through.
PARTS = 4


def shingle_set(w: Column, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the shingles of an array of words; fewer words make one shingle; none, none."""
    at = lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, shingle)])
    full = F.slice(F.transform(w, at), F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(0)))
    short = F.array(F.aggregate(w, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    made = F.when(F.size(w) >= shingle, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<long>"))
    return F.sort_array(F.array_distinct(made))


def _need(n: Column, t: Fraction) -> Column:
    """ceil(t * n)."""
    return F.floor((n * t.numerator + (t.denominator - 1)) / t.denominator).cast("int")


def _cap(n: Column) -> Column:
    """The largest level for a set of n; it never falls as n grows, so larger sets have every level of smaller ones."""
    out = F.lit(LEVELS[0])
    for level in LEVELS[1:]:
        out = F.when(n * (SHORT_SHARE if level <= SHORT_LEVEL else LEVEL_SHARE) >= level, F.lit(level)).otherwise(out)
    return out


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, cid (class: hash of the set; null for an empty one) and set."""
    w = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    s = w.select("doc_id", shingle_set(F.col("w"), shingle).alias("set"))
    return s.select("doc_id", F.size("set").alias("n"), F.when(F.size("set") > 0, F.xxhash64("set", F.size("set"))).alias("cid"), "set")


def _prefix_rows(reps: DataFrame) -> DataFrame:
    """(cid, n, shared: array of (df, token, rank)) of the sets that share a prefix token."""
    rows = reps.select("cid", "n", F.posexplode("prefix").alias("rank", "token"))
    packed = rows.select("token", "cid", (F.col("n").cast("long") * (1 << 32) + F.col("rank")).alias("nr"))
    # A window counts and keeps the rows in one shuffle, where a count and a join take two.
    counted = packed.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    shared = counted.select("cid", F.shiftright("nr", 32).cast("int").alias("n"), F.struct("df", "token", F.col("nr").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rank")).alias("s"))
    return shared.groupBy("cid", "n").agg(F.sort_array(F.collect_list("s")).alias("shared"))


def _kept(level: Column, share: Fraction) -> Column:
    """The tokens at a level for an overlap of ``share`` of the set: the l-prefix's shared tokens without its l - 1 most frequent ones.

    Tokens that no other set has are rarer than all shared ones, so of f shared tokens in the
    prefix the first f - (l - 1) in order of frequency stay.
    """
    base = F.col("n") - _need(F.col("n"), share) + 1
    inside = F.filter("shared", lambda s: s["rank"] < base + (level - 1))
    # One element, so that the filter runs once.
    return F.get(F.transform(F.array(inside), lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - (level - 1), F.lit(0)))), F.lit(0))


def _levels(shared: DataFrame, t: Fraction) -> DataFrame:
    """(cid, n, tokens, central, ask, per) of the sets that may link: all shared prefix tokens, their mean frequency, the probe of least cost, and the entries per level."""
    least = 2 * t / (1 + t)
    # A set and any that it links to share as many prefix tokens as the smaller one's largest level, and that one has t * n tokens or more.
    shared = shared.where(F.size("shared") >= _cap(_need(F.col("n"), t)))
    df_sum = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s["df"])
    token = lambda s: s["token"]
    at = lambda make: F.filter(F.array(*[F.when(_cap(F.col("n")) >= level, make(F.lit(level))) for level in LEVELS]), lambda x: x.isNotNull())
    per = at(lambda level: F.struct(level.alias("level"), F.transform(_kept(level, t), token).alias("kept")))
    costs = at(lambda level: F.struct(df_sum(_kept(level, least)).alias("cost"), level.alias("level")))
    central = df_sum(F.col("shared")) / F.col("n")
    priced = shared.select("cid", "n", "shared", F.transform("shared", token).alias("tokens"), central.alias("central"), F.array_min(costs)["level"].alias("level"), per.alias("per"))
    ask = F.struct("level", F.transform(_kept(F.col("level"), least), token).alias("kept"))
    return priced.select("cid", "n", "tokens", "central", ask.alias("ask"), "per")


def _buckets(levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes at the level of least cost, and the index entries of all levels that any probe looks up."""
    # A level without probe tokens costs nothing and proves that no set of that size or more links: such a set has no probes.
    probes = levels.select("cid", "n", "ask.level", F.explode("ask.kept").alias("token"))
    entries = levels.select("cid", "n", "central", F.explode("per").alias("p")).select("cid", "n", "central", "p.level", F.explode("p.kept").alias("token"))
    return probes, entries.join(probes.select("level", "token").distinct(), ["level", "token"], "left_semi")


def _multi_match(pairs: DataFrame, levels: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose largest prefixes share enough tokens.

    That is the largest level that both have, and the overlap that sets of their sizes need less
    what can lie behind the prefixes: of two prefixes the one that ends first in hash order
    leaves out as many tokens of its set as it is short of it.
    """
    of = lambda c: levels.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    behind = lambda n: _need(n, t) - _cap(n)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    least = F.greatest(_cap(F.least(n_a, n_b)), _need(n_a + n_b, t / (1 + t)) - F.greatest(behind(n_a), behind(n_b)))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(F.size(F.array_intersect("t_a", "t_b")) >= least).select("a", "b")


def _with_sets(pairs: DataFrame, full: DataFrame, heavy: int = 500) -> DataFrame:
    """pairs (a, b, ...) with set_a and set_b. An ``a`` of many pairs is spread over salts."""
    deg = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > heavy))
    salts = F.coalesce(F.ceil(F.col("deg") / heavy).cast("int"), F.lit(1))
    left = pairs.join(deg, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("deg")
    right = full.join(deg, F.col("cid") == F.col("a"), "left").select("cid", "set", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    with_b = left.join(full.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
    return with_b.join(right.select(F.col("cid").alias("a"), "salt", F.col("set").alias("set_a")), ["a", "salt"]).drop("salt")


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and the sets' overlap."""
    return _with_sets(pairs, full).select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), F.size(F.array_intersect("set_a", "set_b")).alias("o"))


def _sharing(stars: DataFrame, full: DataFrame, t: Fraction) -> DataFrame:
    """The rows (a, b, r) of stars whose member b may link to one of another component.

    The two share t of b's tokens, so b leaves once too many are its component's alone among the
    members. Tokens are gone through once a member, not once a pivot, and in parts: what has left
    brings no more tokens, and those that may link lose none by that.
    """
    members = stars.select(F.col("b").alias("cid"), "r").distinct()
    left = materialize(members.join(full.select("cid", F.size("set").alias("n")), "cid").withColumn("alone", F.lit(0)))
    same = Window.partitionBy("token")
    for part in range(PARTS):
        some = full.select("cid", F.filter("set", lambda x: F.pmod(x, F.lit(PARTS)) == part).alias("some"))
        rows = some.join(left.select("cid", "r"), "cid").select("cid", "r", F.explode("some").alias("token"))
        own = rows.select("cid", (F.min("r").over(same) == F.max("r").over(same)).alias("own")).where("own").groupBy("cid").agg(F.count(F.lit(1)).cast("int").alias("more"))
        alone = F.col("alone") + F.coalesce("more", F.lit(0))
        now = materialize(left.join(own, "cid", "left").select("cid", "r", "n", alone.alias("alone")).where(F.col("alone") <= F.col("n") - _need(F.col("n"), t)))
        release(left)
        left = now
    kept = stars.join(left.select(F.col("cid").alias("b")), "b", "left_semi").select("a", "b", "r")
    several = kept.groupBy("a").agg((F.min("r") != F.max("r")).alias("several")).where("several").select("a")
    out = materialize(kept.join(several, "a", "left_semi"))
    release(left)
    return out


def _differences(stars: DataFrame, full: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, r, n, far, size, half, least, ends, alone, ordered) of the members b of pivots a that may link: the symmetric difference in order of frequency.

    |x ^ y| = |dx| + |dy| - 2 |dx & dy| for the differences dx, dy from one pivot p, and x and y
    link if |x ^ y| <= w (|x| + |y|) with w = (1 - t) / (1 + t). ``far`` members, which don't link
    to p, have |d| > w (|d's set| + |p|). So a far y shares more than
    (|dx| + w (|p| - |x|)) / 2 tokens of dx with any x that it links to: ``half`` tokens of dx
    include one of them. If x is far too and |dy| >= |dx|, |x| <= |y| / t or the like leaves
    out w (|x| + |y|) / 2 tokens at most, so ``least`` tokens do. Of any dx, all tokens but
    w (|x| + |y|), which is (1 - t) / t * |x| at most, are in dy: one token more, ``ends`` of them,
    include a common one. Frequencies are those among far members: the others are only compared with these.
    """
    up, low = t.numerator, t.denominator
    n, p, size = F.size("set_b"), F.size("set_a"), F.size("diff")
    both = _with_sets(stars, full).withColumn("diff", F.concat(F.array_except("set_b", "set_a"), F.array_except("set_a", "set_b")))
    half = size - F.floor(((up + low) * size + (low - up) * (p - n)) / (2 * (up + low)))
    least = F.least(half, F.floor((low - up) * n / (2 * up)) + 1)
    made = materialize(both.select("a", "b", "r", n.alias("n"), (size * (up + low) > (low - up) * (n + p)).alias("far"), size.alias("size"), half.cast("int").alias("half"), least.cast("int").alias("least"), "diff"))
    same = Window.partitionBy("a", "token")
    rows = made.select("a", "b", "r", "far", F.explode("diff").alias("token"))
    met = rows.select("a", "b", "token", F.sum(F.col("far").cast("int")).over(same).alias("df"), (F.min("r").over(same) != F.max("r").over(same)).alias("met")).where("met")
    # Tokens that no members of different components share come first in order; only their number, ``alone``, counts.
    ordered = met.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    ends = (F.floor((low - up) * F.col("n") / up) + 1).cast("int")
    whole = made.drop("diff").join(ordered, ["a", "b"]).withColumn("ends", ends).withColumn("alone", F.col("size") - F.size("ordered"))
    out = materialize(whole.where("alone < ends").select("a", "b", "r", "n", "far", "size", "half", "least", "ends", "alone", "ordered"))
    release(made)
    return out


def _across(diffs: DataFrame, t: Fraction) -> DataFrame:
    """Candidate pairs (a, b) of members of one pivot that are in different components, from ``_differences``.

    The first common token of two differences that share c, at places i and j, has
    i <= |dx| - c and j <= |dy| - c: most pairs that meet later in order fail that.
    """
    up, low = t.numerator, t.denominator
    own = lambda df, k: df.select("a", "b", "r", "n", "size", "alone", F.posexplode(F.slice("ordered", F.lit(1), F.greatest(F.lit(0), F.least(F.size("ordered"), F.least(k, "ends") - F.col("alone"))))).alias("at", "s")).select("a", F.col("s.token").alias("token"), F.col("s.df").alias("df"), "b", "r", "n", "size", (F.col("at") + F.col("alone")).alias("at"))
    other = lambda df: df.select("a", "token", *[F.col(c).alias(f"{c}_y") for c in ("b", "r", "n", "size", "at")])
    far, near = diffs.where("far"), diffs.where("not far")
    apart = (F.col("r") != F.col("r_y")) & (F.least("n", "n_y") * low >= F.greatest("n", "n_y") * up)
    # 2 (up + low) times the least number of tokens that the differences of linked sets share.
    share = (up + low) * (F.col("size") + F.col("size_y")) - (low - up) * (F.col("n") + F.col("n_y"))
    room = 2 * (up + low) * F.least(F.col("size") - F.col("at"), F.col("size_y") - F.col("at_y"))
    # A token of one far member meets no other far one.
    one = own(far, "least").where("df > 1").join(other(own(far, "half").where("df > 1")), ["a", "token"]).where(apart & (F.col("size_y") >= F.col("size")) & (room >= share))
    two = own(near, "half").join(other(own(far, "size")), ["a", "token"]).where(apart & (room >= share))
    pair = [F.least("b", "b_y").alias("a"), F.greatest("b", "b_y").alias("b")]
    return one.select(*pair).union(two.select(*pair)).distinct()


def _linked(o: str, t: Fraction) -> Column:
    return t.denominator * F.col(o) >= t.numerator * (F.col("na") + F.col("nb") - F.col(o))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, root): the least vertex of each vertex's component, by least labels and pointer jumping.

    Each round replaces the edges by edges between labels, so stars and chains shrink fast;
    it ends when no edge joins two labels.
    """
    vertices = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    labels = materialize(vertices.withColumn("root", F.col("v")))
    now = materialize(edges.select("a", "b").where("a != b").distinct())
    for _ in range(most):
        if now.isEmpty():
            return labels
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        up = materialize(up)
        twice = up.join(up.select(F.col("v").alias("to"), F.col("to").alias("to2")), "to", "left").select("v", F.coalesce("to2", "to").alias("to"))
        twice = materialize(twice)
        labels = materialize(labels.join(twice.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root")))
        a = twice.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        b = twice.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        now = materialize(now.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a != b").distinct())
    raise RuntimeError(f"components: edges between labels are left after {most} rounds")


def linked(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents with their classes (doc_id, n, cid), and the components (v, root) of linked classes.

    Not all links are made, but enough that whatever set links to another is in its component.
    """
    t = threshold
    n = F.col("n")
    prefix = F.slice("set", F.lit(1), (n - _need(n, t) + _cap(n)).cast("int"))
    made = materialize(_sets(docs.select("doc_id", "text"), shingle).select("doc_id", "n", "cid", prefix.alias("prefix")))
    sets = materialize(made.select("doc_id", "n", "cid"))
    # The class of empty sets has no prefix and leaves no rows.
    reps = materialize(made.groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    release(made)
    levels = materialize(_levels(_prefix_rows(reps), t))
    release(reps)
    probes, entries = _buckets(levels)

    at = ["level", "token"]
    sizes = materialize(entries.groupBy(*at).agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", "cid")).alias("top")).where("m > 1").select(*at, "m", F.col("top.cid").alias("pivot")))
    close = (n <= F.col("nb")) & (n * t.denominator >= F.col("nb") * t.numerator)
    # Few sets in a bucket: all pairs of a probe and an entry. Many: each with the central one.
    few = sizes.where(F.col("m") <= STAR).select(*at)
    few = probes.join(few, at).join(entries.select(*at, F.col("cid").alias("b"), F.col("n").alias("nb")), at).where(close & (F.col("cid") != F.col("b")))
    pair = [F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")]
    big = materialize(entries.join(sizes.where(F.col("m") > STAR).select(*at, "pivot"), at).select(*at, "pivot", "cid"))
    star = big.where("cid != pivot").select("cid", F.col("pivot").alias("b")).distinct()
    todo = materialize(_multi_match(few.select(*pair).union(star.select(*pair)).distinct(), levels, t))
    release(levels, sizes)
    full = _full_sets(docs, sets, todo, shingle)
    found = materialize(_overlaps(todo, full).where(_linked("o", t)).select("a", "b"))
    release(full, todo)
    roots = components(found)

    # Large buckets with members in several components: their pairs by differences from the pivot.
    of = lambda v, r: roots.select(F.col("v").alias(v), F.col("root").alias(r))
    member = materialize(big.join(of("cid", "r"), "cid", "left").join(of("pivot", "p"), "pivot", "left").select(*at, "pivot", "cid", F.coalesce("r", "cid").alias("r"), (F.coalesce("r", "cid") != F.coalesce("p", "pivot")).alias("outer")))
    mixed = member.groupBy(*at).agg(F.max("outer").alias("mixed")).where("mixed").select(*at)
    stars = materialize(member.join(mixed, at, "left_semi").where("cid != pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"), "r").distinct())
    release(big, member)
    if stars.isEmpty():
        return sets, roots
    full = _full_sets(docs, sets, stars, shingle)
    stars = _sharing(stars, full, t)
    if stars.isEmpty():
        release(full)
        return sets, roots
    diffs = _differences(stars, full, t)
    rest = materialize(_across(diffs, t))
    release(full, diffs)
    full = _full_sets(docs, sets, rest, shingle)
    more = _overlaps(rest, full).where(_linked("o", t)).select("a", "b")
    up = lambda c: F.coalesce(f"r_{c}", c).alias(c)
    between = materialize(more.join(of("a", "r_a"), "a", "left").join(of("b", "r_b"), "b", "left").select(up("a"), up("b")).distinct())
    release(full, rest)
    if between.isEmpty():
        return sets, roots
    tops = components(between)
    ends = roots.union(tops.join(roots, "v", "left_anti").select("v", F.col("v").alias("root")))
    top = tops.select(F.col("v").alias("root"), F.col("root").alias("top"))
    return sets, materialize(ends.join(top, "root", "left").select("v", F.coalesce("top", "root").alias("root")))


def _full_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(cid, set) of the classes in ``pairs``, made again from one document of each."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    which = sets.join(wanted, F.col("cid") == F.col("c"), "left_semi").groupBy("cid").agg(F.min("doc_id").alias("d"))
    text = docs.select("doc_id", "text").join(materialize(which.select("d").distinct()), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return materialize(_sets(text, shingle).groupBy("cid").agg(F.first("set").alias("set")))


def join(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links).

    A-Z are lower-cased; words are runs of non-white-space. A text with fewer words than a
    shingle has one shingle, all of them. Texts without words (null, empty) are linked with
    nothing and are their own component; a null doc_id reaches the least id of its links; rows
    with equal doc_ids are reported each; an empty table gives no rows.
    """
    sets, roots = linked(docs, shingle, threshold)
    classes = sets.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, F.col("cid") == F.col("v"), "left").select("cid", F.coalesce("root", "cid").alias("root"), "least")
    rooted = materialize(rooted)
    grouped = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("group_least"))
    named = rooted.join(grouped, "root", "left").select(F.col("cid").alias("c"), F.coalesce("group_least", "least").alias("component_id"))
    out = sets.join(named, F.col("cid") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, shingle: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id, with all its columns.

    Rows are told apart by doc_id and text: a reused doc_id goes only with the texts that have a
    copy, null doc_ids come after all others, and of equal rows one stays, the least by all
    columns written as JSON. Texts without words stay.
    """
    d, gone, row = free(docs, "__d", "__gone", "__row")
    rows = join(docs.select(identity().alias("doc_id"), "text"), shingle, threshold)
    marks = rows.where("n_shingles > 0").groupBy(F.col("doc_id").alias(d)).agg(F.max(F.col("component_id") != F.col("doc_id")).alias(gone), F.count(F.lit(1)).alias("rows"))
    marks = materialize(marks.where(F.col(gone) | (F.col("rows") > 1)).select(d, gone))
    marked = docs.join(marks, identity() == F.col(d), "left")
    whole = F.struct(*docs.columns)
    repeated = marked.where(~F.col(gone)).groupBy(d).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return marked.where(F.col(gone).isNull()).select(*docs.columns).unionByName(repeated.select(f"{row}.*"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
