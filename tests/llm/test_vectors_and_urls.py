"""Hard negatives, whitening and url verdicts against brute force, with nulls, ties, repeated rows and clashing names."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from microtide.llm import hard_negatives, url_filter, whitening

VECTORS = "vec_id long, embedding array<float>, label int, row long, vector string, mean int, cell_a int, x string, anchor int"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "v", 2, 3, "x", 4) for r in rows], VECTORS)


@pytest.fixture(scope="module")
def some_vectors():
    r = np.random.default_rng(2)
    middle = r.normal(0, 0.2, (4, 20))
    rows = [(i, [float(x) for x in np.float32(middle[i % 4] + r.normal(0, 0.1, 20))], int(r.integers(0, 3))) for i in range(240)]
    rows += [(300 + i, rows[3][1], i % 3) for i in range(40)]  # ties: copies under all labels
    rows += [(400, None, 1), (401, rows[0][1], None), (402, [float("nan")] * 20, 1), (403, [None] * 20, 1), (404, [float("inf")] + [0.0] * 19, 2), (405, [], 1), (None, rows[1][1], 1)]
    return rows


def mined(rows, step):
    """Brute force over all pairs."""
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int), c) for i, v, c in rows if i is not None and v and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, c in {(i, tuple(v), c): (i, v, c) for i, v, c in ok if i % step == 0}.values():
        scored = sorted(((int(v @ w), -j, e) for j, w, e in ok if j != i), reverse=True)
        for p, j, _ in [s for s in scored if s[2] == c][:5]:
            under = [s for s in scored if s[2] != c and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, -j, n + 1, -u, p, s) for n, (s, u, _) in enumerate(under)]
    return sorted(out)


def found(spark, rows, step):
    got = vectors(spark, rows).where(F.col("label").isNotNull() & hard_negatives.usable(F.col("embedding")))
    got = hard_negatives.mine(got.select("vec_id", "label", hard_negatives.quantized(F.col("embedding"), 256.0).alias("vector")), F.col("vec_id") % step == 0)
    return sorted(map(tuple, got.collect()))


def test_hard_negatives_equal_brute_force(spark, some_vectors, monkeypatch):
    want = mined(some_vectors, 10)
    assert len(want) > 100
    assert found(spark, some_vectors, 10) == want
    # The same over a grid of cells and several tiles each.
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    assert found(spark, some_vectors, 10) == want
    assert found(spark, some_vectors + some_vectors[:3], 10) == mined(some_vectors + some_vectors[:3], 10)
    assert found(spark, [], 10) == []
    assert found(spark, [(0, [1.0], 1)], 10) == []


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, [float(x)] * 3, i % 2) for i, x in enumerate([1e12, 2e12, -3e12, 1.7e12, 1e12, 1.1e12])]
    assert found(spark, rows, 2) == mined(rows, 2)
    assert found(spark, [(i, [3e38] * 2, i % 2) for i in range(6)], 5) == []  # all scores saturate at one value


def test_segment_bounds_hold_and_prune():
    r = np.random.default_rng(4)
    x = np.cumsum(r.normal(0, 40, (60, 64)), 1).astype(int)
    seg = x.reshape(60, -1, 2).astype(float)
    mean = seg.mean(2)
    levels = hard_negatives._levels(mean, np.sqrt(((seg - mean[:, :, None]) ** 2).sum(2)))
    exact, width = x @ x.T, []
    for length, m, d in levels:
        middle, spread = length * (m @ m.T), d @ d.T
        assert (np.abs(exact - middle) <= spread * (1 + 1e-9) + 1e-6).all()
        width.append(spread.mean())
    assert [n for n, _, _ in levels] == list(hard_negatives.LENGTHS) and width == sorted(width, reverse=True)


def test_tiles_are_scored_where_bounds_leave_pairs(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(5)
    x = np.repeat(r.integers(-300, 300, (4, 4)), [5, 2500, 2500, 5], 0).repeat(16, 1) + r.integers(-2, 3, (5010, 64))
    rows = pa.table({"vec_id": np.arange(5010), "label": np.zeros(5010, np.int64), "vector": list(x)})
    rows = pa.Table.from_batches(hard_negatives._summaries(iter(rows.to_batches())))
    scored = []
    old = hard_negatives._exact
    monkeypatch.setattr(hard_negatives, "_exact", lambda a, b: scored.append(len(a) * len(b)) or old(a, b))
    anchors = rows.slice(0, 5).rename_columns(["anchor_id", "label", "vector", "mean", "dev"]).append_column("anchor_row", pa.array(np.arange(5)))
    got = hard_negatives._positives(5)[0](anchors, rows).to_pylist()
    s = x[:5] @ x.T
    for a in range(5):
        order = sorted((-s[a, j], j) for j in range(5010) if j != a)[:5]
        assert [(-g["positive_score"], g["positive_id"]) for g in got if g["anchor_row"] == a] == order
    assert sum(scored) < 0.8 * 5 * 5010  # all of the first tile, then what may enter


def whitened(spark, rows, components=8):
    got = vectors(spark, rows).where(whitening.usable(F.col("embedding")))
    x = F.transform(whitening.quantized(F.col("embedding"), 1024.0), lambda v: v + 100000)
    return whitening.whiten(got.select("vec_id", x.alias("x")), components).toPandas()


@pytest.mark.parametrize("dims", [3, 20, 90])
def test_whitening_equals_eigh(spark, dims):
    r = np.random.default_rng(dims)
    data = r.normal(0, 1, (500, dims)) * np.linspace(1, 0.3, dims)
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(data)]
    junk = [(900, None, 0), (901, [None] * dims, 0), (902, [float("nan")] * dims, 0), (903, [1.0], 0), (904, [], 0)]
    got = whitened(spark, rows + junk + [rows[0], (None, *rows[1][1:])])
    x = np.floor(1024 * np.array([v for _, v, _ in rows + [rows[0], rows[1]]], float)).astype(int) + 100000
    n, c = len(x), x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    k = min(8, dims)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.allclose(got[got.vec_id == 7].explained, e / np.trace(c.T @ c / n), rtol=1e-9)
    for i in (0, 7, 499):
        mine = got[got.vec_id == i].drop_duplicates()
        want = c[i] @ u / np.sqrt(e)
        signs = np.sign(u[np.abs(u).argmax(0), np.arange(k)])
        assert np.allclose(mine.whitened, want * signs, atol=1e-8)
        assert set(mine.deviation) == {int(((n * x[i] - x.sum(0)) ** 2).sum())}
    assert len(got[got.vec_id == 0]) == 2 * k and got.vec_id.isna().sum() == k


def test_whitening_without_variance_and_huge_entries(spark):
    assert len(whitened(spark, [])) == 0
    assert len(whitened(spark, [(1, [1.0, 2.0], 0)] * 3)) == 0
    flat = whitened(spark, [(i, [float(i), 2.0, float(i)], 0) for i in range(9)])
    assert set(flat.component) == {1} and abs(flat.explained.iloc[0] - 1) < 1e-9
    huge = whitened(spark, [(i, [1e30 * i, -5.0 * i], 0) for i in range(5)])
    assert set(huge.component) == {1} and huge.deviation.max() == 2**63 - 1  # the other is below rounding
    c = whitening._Centre(10**9, [3 * 10**9 + 7, -(10**9) + 1])
    x = np.array([[40, -90], [3, -1]])
    assert list(c.deviation(x)) == [min(sum((10**9 * int(a) - s) ** 2 for a, s in zip(row, c.sums)), 2**63 - 1) for row in x]


def test_chebyshev_takes_fewer_passes_than_plain_iteration(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(r.normal(0, 1, (800, 64)))]
    passes, old = [], whitening._added
    monkeypatch.setattr(whitening, "_added", lambda *a: passes.append(1) or old(*a))
    got = whitened(spark, rows)
    assert got.identity_error.max() < 1e-10 and len(passes) < 60


PAGES = "page_id long, url string, html string, host string, key string, id int, rule string, v int, root int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "k", 1, "r", 2, 3) for r in rows], PAGES)


def canonical(url):
    return f'<html><head><LINK href="{url}" data-x="1" rel="canonical"></head>'


def judged(rows, rules, default, extra=()):
    """Brute force: union-find over keys, every rule tried on every url."""
    def parts(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        query = re.match(r"[^#]*", rest[len(host) + len(path) :]).group()
        low = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        return low, path, low + path + query if low else None

    def rule(host, path):
        fits = [(len(h + p), v == "allow", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    up = {}
    def top(k):
        up.setdefault(k, k)
        while up[k] != k:
            k = up[k]
        return k

    links = [(u, t) for _, u, h in rows for t in re.findall(r'rel="canonical" href="([^"]*)"|<LINK href="([^"]*)"|url=([^"]*)"', h or "") for t in t if t] + list(extra)
    for a, b in links:
        a, b = parts(a)[2], parts(b)[2]
        if a and b:
            up[top(a)] = top(b)
    by = collections.defaultdict(set)
    for k in list(up):
        by[top(k)].add(rule(*parts("://" + k)[:2])[0])
    out = []
    for i, u, _ in rows:
        host, path, key = parts(u)
        allow, name = rule(host, path)
        group = by[top(key)] if key in up else set()
        allow = allow if allow is not None else True if True in group else False if False in group else default == "allow"
        out.append((i, host, path, name, "allow" if allow else "block"))
    return out


def test_urls_equal_brute_force(spark):
    r = random.Random(3)
    url = lambda: f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'a.b.'])}{r.choice(['x.com', 'example.com', 'Y.net', 'z.org', 'q.org'])}/{r.choice(['en', 'es', 'fr'])}/{r.randint(0, 30)}{r.choice(['', '/', '?p=1', '#top', '.html'])}"
    rows = [(i, url(), canonical(url()) if r.random() < 0.4 else "<p>text</p>") for i in range(150)]
    chain = [f"http://c{i}.org/p" for i in range(12)] + ["http://m.net/es/1"]
    rows += [(200 + i, a, f'<meta http-equiv="refresh" content="0; url={b}">') for i, (a, b) in enumerate(zip(chain, chain[1:]))]
    rows += [(300 + i, f"http://s{i}.org/", f'<link rel="canonical" href="http://hub.net/fr/">') for i in range(40)]  # noqa: F541
    rows += [(400, None, None), (401, "no scheme", canonical("http://m.net/es/1")), (402, "http://", ""), (403, "ftp://X.NET", None), (404, "http://c0.org/p#x", None), (405, "http://a.org/" + "y" * 50_000, None), rows[0], rows[0], (None, "http://x.net/fr/?q", None)]
    extra = [("http://r1.org/", "http://m.net/es/9"), ("http://r1.org/", "http://w.com/ok"), (None, "http://x.com/"), ("http://r2.org/", None), ("http://r3.org/", "http://m.net/es/9/")]
    rows += [(500, "http://r1.org/", None), (501, "http://r2.org/", None), (502, "http://r3.org/", None)]
    redirects = spark.createDataFrame(extra, "source string, target string")
    for default in ("allow", "block"):
        got = url_filter.judge(pages(spark, rows), redirects=redirects, default=default)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(judged(rows, url_filter.RULES, default, extra))
    verdict = {x.page_id: x.verdict for x in url_filter.judge(pages(spark, rows), redirects=redirects).collect()}
    assert all(verdict[200 + i] == "block" for i in range(12)) and all(verdict[300 + i] == "block" for i in range(40))
    assert verdict[500] == "allow" and verdict[404] == "block"
    assert url_filter.judge(pages(spark, [])).count() == 0


def test_links_of_pages(spark):
    cases = {
        '<link rel=canonical href=/a/b?x=1&amp;y=2>': ["http://h.org/a/b?x=1&y=2"],
        "<link rel='alternate canonical' href='//O.org/z'>": ["http://O.org/z"],
        '<link rel="canonical" href="other">': ["http://h.org/dir/other"],
        '<link rel="canonical" href="?p=2">': ["http://h.org/dir/page?p=2"],
        '<META HTTP-EQUIV="Refresh" CONTENT="5;URL=\'https://n.org/\'">': ["https://n.org/"],
        '<link rel="canonical" href=""><link rel="canonical" href="#x"><link rel="canonical" href="mailto:a@b">': [],
        '<link rel="stylesheet" href="/s.css"><link rel="noncanonical" href="/t"><meta http-equiv="refresh" content="30">': [],
        "<link rel=canonical href=/a <p>": [],
        "": [],
    }
    df = spark.createDataFrame([(h,) for h in cases] + [(None,)], "html string")
    got = {x.html: x.a for x in df.select("html", url_filter.aliases(F.lit("http://h.org/dir/page?q#f"), F.col("html")).alias("a")).collect()}
    assert got == cases | {None: []}


def test_query_and_sql_agree_on_links(spark, tmp_path):
    import duckdb

    r = random.Random(9)
    url = lambda: f"https://{r.choice(['x.com', 'www.example.com', 'example.com', 'y.net', 'z.org', 'q.org'])}/{r.choice(['en', 'es', 'fr'])}/{r.randint(0, 20)}"
    rows = [(i, url(), canonical(url()) if i % 2 else f'<meta http-equiv="refresh" content="0; url={url()}">') for i in range(120)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    got = url_filter.op13_url_filter(spark, d)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({url_filter.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")  # noqa: F541
    got = hard_negatives.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({hard_negatives.ORACLE_SQL})").fetchall())
