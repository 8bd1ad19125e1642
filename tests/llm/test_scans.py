"""Decontamination, exact top-k, URL filter, secrets, pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import decontaminate as D
from barwright.llm import secrets as S
from barwright.llm import topk as K
from barwright.llm import url_filter as U


def test_masks_find_any_fifth_of_substituted_words():
    for n in range(5, 17):
        masks = [[i for i, c in enumerate(m) if c == "1"] for m in D.masks_for(n)]
        places = [{i + o for o in m} for m in masks for i in range(n - m[-1])]
        assert all(any(not p & set(gone) for p in places) for gone in itertools.combinations(range(n), n // 5)), n


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_leaks(spark, monkeypatch):
    rng = random.Random(1)
    items = [words(rng, n) for n in (40, 20, 16, 7, 4)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (None, ""), (0, " ".join(items[0]))], "item_id long, text string")
    swap = lambda w, at: [f"z{i}" if i in at else x for i, x in enumerate(w)]
    docs = {
        1: words(rng, 50) + swap(items[0], {3, 11, 19, 30}) + words(rng, 9), 2: [x.upper() for x in items[1]], 3: words(rng, 200), 4: items[0][10:24], 5: items[0][10:20],
        6: swap(items[2], {1, 6, 12}), 7: items[3] + items[2], 8: items[4] * 3, 10: swap(items[1], set(range(0, 20, 2))), 11: items[3][:4] + ["q"] + items[3][5:], 12: items[2][8:] + ["x"] + items[2][:8],
    }
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(20, None), (21, ""), (None, " ".join(items[1])), (2, " ".join(items[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit(1))
    monkeypatch.setattr(D, "LEAST_BITS", 15)
    for most in (27, 15):  # with few bits many texts go on to the join
        monkeypatch.setattr(D, "MOST_BITS", most)
        got = sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(df, bench).collect())
        assert got == sorted([("1", 0), ("2", 1), ("2", 1), ("4", 0), ("6", 2), ("7", 2), ("7", 3), ("11", 3), ("None", 1)])
    one = D.find_leaks(df, bench).where("doc_id = 1").first()
    assert (one.start_word, one.end_word, one.matched, one.item_start) == (50, 90, 36, 0)
    assert {r.doc_id for r in D.find_leaks(df, bench, min_item_words=1).where("item_id = 4").collect()} == {8}
    assert D.find_leaks(df.where("false"), bench).count() == 0 and D.find_leaks(df, bench.where("false")).count() == 0
    kept = D.without_leaks(df.withColumn("text_hash", F.lit("x")), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "12", "20", "21", "3", "5", "8"] and kept.columns == ["doc_id", "text", "leaks", "text_hash"]


def leaked(text, items, min_words=13):
    """Brute force: every alignment of every item."""
    out = set()
    for i, item in items:
        for begin in range(1 - len(item), len(text)):
            lo, hi = max(begin, 0), min(begin + len(item), len(text))
            same = np.array([x == y for x, y in zip(text[lo:hi], item[lo - begin :], strict=False)])
            if D.measure(same, np.ones(len(same), bool), len(item), min_words, 0.5):
                out.add(i)
    return out


def test_seeds_that_many_items_share(spark, monkeypatch):
    """What is asked beside a shared seed takes no alignment away: items of all lengths, templates, repeated words, parts of items."""
    rng = np.random.default_rng(11)
    some = lambda k, of=3000: [f"w{i}" for i in rng.integers(0, of, k)]
    templates = [some(8), some(14), ["so"] * 6]
    items = [templates[i % 3] + some(int(rng.integers(0, 30))) for i in range(60)] + [some(int(rng.integers(1, 40)), 5) for _ in range(40)]
    texts = [some(10) + templates[i % 3][: int(rng.integers(3, 15))] + some(20) for i in range(30)] + [some(60, 5) for _ in range(10)] + [["so"] * 40, [], None]
    for item in items[::2]:
        own = list(item)
        for i in rng.integers(0, len(own), len(own) // 6):
            own[i] = "changed"
        cut = int(rng.integers(0, 4))
        texts.append((some(3) + own)[cut:] + some(2))
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    sent = []
    shared = D._shared
    monkeypatch.setattr(D, "_shared", lambda table, *rest: sent.append(table.count()) or shared(table, *rest))
    for options in ({}, {"min_item_words": 1}, {"min_words": 6, "min_item_words": 3}):
        plain = sorted(D.find_leaks(docs, bench, hot=10**9, **options).collect())
        assert not sent and len(plain) > 40
        for hot in (0, 5):
            assert sorted(D.find_leaks(docs, bench, hot=hot, **options).collect()) == plain
            assert sent.pop() > 100


def test_a_template_is_not_looked_up(spark, monkeypatch):
    """Texts that have most of a template meet none of its items but those that leaked."""
    rng = np.random.default_rng(12)
    some = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 10**6, k))
    head = "what is the capital of the country named"
    items = [(i, f"{head} {some(7)}") for i in range(400)]
    texts = [(i, f"{some(9)} {head[:-6]} {some(30)}") for i in range(400)] + [(400 + i, f"{some(3)} {items[i][1]} {some(3)}") for i in range(5)]
    met, shared = [], D._shared
    monkeypatch.setattr(D, "_shared", lambda *given: met.append(shared(*given)) or met[-1])
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == [(400 + i, i) for i in range(5)]
    assert met[0].distinct().count() == 5


def test_leaks_against_all_alignments(spark):
    rng = random.Random(11)
    items = [(i, words(rng, n)) for i, n in enumerate(n for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 30, 45) for _ in range(8))]
    docs, planted = [], []
    for i, item in items:
        for s in (0, 1, 2, 3):
            if s <= len(item) // 5:
                gone = set(rng.sample(range(len(item)), s))
                text = words(rng, rng.randrange(12)) + [f"q{j}" if j in gone else x for j, x in enumerate(item)] + words(rng, rng.randrange(12))
                planted.append((len(docs), i))
                docs.append(text)
    for i in range(60):  # heavier damage: recall is measured
        item = items[rng.randrange(64, len(items))][1]
        docs.append([x if rng.random() < 0.78 else "q" for x in item] + words(rng, 5))
    docs.append(words(rng, 40000) + items[100][1] + words(rng, 40000))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect()}
    assert set(planted) <= got and (len(docs) - 1, 100) in got  # all of these, at any length
    some = [*range(0, len(planted), 12), *range(len(planted), len(docs) - 1, 3)]
    want = {(d, i) for d in some for i in leaked(docs[d], items)}
    assert {x for x in got if x[0] in some} <= want and len(got & want) >= 0.98 * len(want)


def test_topk_equals_all_products(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(int(i), [0.5] * 6) for i in range(300, 420)]
    rows += [(500, None), (550, [1.0, None, 0, 0, 0, 0]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6), (50, [9.0] * 6), (7, rows[7][1]), (700, [1.0])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, np.pad(v, (0, 6 - len(v)))) for i, v in fine]
    want = []
    for q in sorted({i for i, _ in fine if i % 50 == 0}):
        own = np.array(min(v.tolist() for i, v in fine if i == q))
        ranked = sorted(((-int(own @ v), i) for i, v in fine if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    monkeypatch.setattr(K, "LEAST_SHARDS", 1)
    for sizes in ({}, {"shard": 40, "slab": 3, "leaf": 4, "block": 2}):
        got = sorted(tuple(r) for r in K.top_inner_products(df, **sizes).collect())
        assert got == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.top_inner_products(few).collect()] == [(0, 1, 1, 131072)]
    assert K.top_inner_products(few.where("false")).count() == 0
    big = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (3, [])], "vec_id long, embedding array<double>")
    score = lambda a, b: (256 * 10**6) ** 2 + 256 * a * 256 * b
    assert [tuple(r)[2:] for r in K.top_inner_products(big).orderBy("rank").collect()] == [(1, score(3, 3)), (2, score(3, 2)), (3, 0)]  # beyond what doubles hold


def test_a_tree_visits_little():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(20000, 3)).round(3)
    tree = K.Tree(np.arange(20000), points, 32)
    assert all((points[tree.ids[a:b]] >= lo).all() and (points[tree.ids[a:b]] <= hi).all() for a, b, lo, hi in zip(tree.lo, tree.hi, tree.low, tree.high, strict=True))
    queries = np.array([[1.0, -2.0, 0.5], [1.0, -2.0, 0.4], [-3.0, 0.1, 0.1]])
    scores, ids = tree.search(queries, np.array([-1, -1, -1]), np.full(3, K.NOTHING), 5)
    for q, i in zip(queries, ids, strict=True):
        assert sorted(i.tolist()) == sorted(np.argsort(-(points @ q))[:5].tolist())
    assert tree.visited < 0.1 * len(points) * len(queries)
    scores, _ = tree.search(queries[:1], np.array([-1]), np.array([1e9]), 5)  # a floor that nothing reaches
    assert (scores == K.NOTHING).all()


def test_urls(spark):
    pages = [
        (1, "https://x.com/de/1", ""), (2, "http://y.net/a?utm_source=1", "<LINK rel='canonical' href='https://x.com/de/1'>"), (3, "http://y.net/b", '<meta http-equiv="refresh" content="0; url=/a">'),
        (4, "http://z.net/q", '<link href="http://x.com/fr/2" rel=canonical>'), (5, None, None), (6, "noscheme", None), (7, "HTTP://EXAMPLE.ORG?x://y/z", ""), (8, "https://y.net/a/#t", None),
        (9, "ftp://A.Example.org/en/12/x#f", ""), (10, "http://xexample.org/es/", ""), (11, "http://org", ""), (None, "http://free.net/", None), (12, "http://m.net/1", "<link rel=canonical href=http://m.net/2>"),
        (13, "http://m.net/2", ""), (14, "http://v.net/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "label": F.lit(1)})
    redirects = spark.createDataFrame([("http://m.net/2", "http://x.com/de/9"), ("http://m.net/1", "http://example.org/x"), ("http://v.net/", None)], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, redirects=redirects).collect()}
    assert got[1] == ("x.com", "/de/1", "com/de/", "block") and got[2] == ("y.net", "/a", None, "block")
    assert got[3][3] == "block" and got[8] == ("y.net", "/a/", None, "block") and got[4][3] == "allow"
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("example.org", "", None, "allow")
    assert got[9] == ("a.example.org", "/en/12/x", "example.org/en/1", "block") and got[10][2] == "org/" and got[11] == ("org", "", None, "allow")
    assert got[12][3] == got[13][3] == "allow"  # an allowed alias goes before a blocked one
    assert got[None] == ("free.net", "/", None, "allow")
    assert {r.page_id: r.verdict for r in U.judge_urls(df).collect()}[13] == "allow"
    assert U.judge_urls(df.where("false")).count() == 0


def judged(pages, rules, redirects):
    """Brute force: every rule at every page, and aliases by walking the links."""

    def parts(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]

    def rule(url):
        host, path = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return min(fits, key=lambda r: (-len(r.name), not r.allow, r.name), default=None)

    key = lambda url: parts(url)[0] + parts(url)[1].rstrip("/") if parts(url)[0] else None
    beside, said = {}, {}
    for url in {u for _, u in pages} | {u for pair in redirects for u in pair}:
        if key(url) is not None and rule(url):
            said.setdefault(key(url), set()).add(rule(url).allow)
    for x, y in redirects:
        if key(x) is not None and key(y) is not None:
            beside.setdefault(key(x), set()).add(key(y))
            beside.setdefault(key(y), set()).add(key(x))
    out = []
    for i, url in pages:
        seen, todo = set(), [key(url)]
        while todo:
            if (k := todo.pop()) is not None and k not in seen:
                seen.add(k)
                todo += beside.get(k, ())
        found, own = set().union(*(said.get(k, set()) for k in seen)), rule(url)
        allow = own.allow if own else True in found or not found
        out.append((str(i), *parts(url), own.name if own else None, "allow" if allow else "block"))
    return sorted(out, key=str)


def test_urls_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    path = lambda n: "".join("/" + rng.choice("xy") for _ in range(rng.randrange(n)))
    rules = [U.Rule(rng.random() < 0.5, host(), path(4)) for _ in range(25)]
    url = lambda: rng.choice(["http://", "https://"]) + (host().upper() if rng.random() < 0.2 else host()) + path(5) + rng.choice(["", "/", "#t"])
    long = "http://" + "a." * 3000 + "b/" + "x/" * 5000
    pages = [(i, url()) for i in range(120)] + [(3, "http://a/x"), (3, "http://a/x"), (None, url()), (900, None), (901, "none"), (902, long), (903, "://")]
    redirects = [(url(), url()) for _ in range(30)]
    df = spark.createDataFrame([(i, u, None if i == 5 else "<p>" * 50000 if i == 6 else "") for i, u in pages], "page_id long, url string, html string")
    moved = spark.createDataFrame(redirects, "source string, target string")
    table = spark.createDataFrame([(r.allow, r.host, r.path) for r in rules] + [(None, "a", "/"), (True, None, "/")], "allow boolean, host string, path string")
    want = judged(pages, rules, redirects)
    for most in (500, 10):  # written into the plan, and joined
        monkeypatch.setattr(U, "PLAN_RULES", most)
        for given in (tuple(rules), table):
            got = [(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, given, moved).collect()]
            assert sorted(got, key=str) == want
    assert all(r.verdict == "allow" for r in U.judge_urls(df, table.where("false")).collect())


BASE = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_base_secrets(spark):
    rng = random.Random(5)
    parts = ["token: ", "Password='", "abc123", "AKIA", "QWERTY0123456789", "AKIAAKIA", "0123456789abcdef", "é𝒳", " ", "\n", '"', "=", "api_key", "secret", ":", "deadbeef" * 3, "short", "ſecret=abcdefgh", "x" * 50]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(300)] + [(900, None), (901, ""), (None, "token=abcdefg"), (902, "a" * 100_000), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "spans": F.lit(1), "m_hex": F.lit(2)})
    got = sorted((str(r.doc_id), S_text(r.base)) for r in S.find_secrets(df).collect())
    want = []
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        want.append((str(i), ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found)))
    assert got == sorted(want)
    assert S.find_secrets(df.where("false")).count() == 0


def S_text(spans):
    return ",".join(f"{S.KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def battery(token, pairs=None):
    """The p-value of the tests, in plain Python."""
    import math

    tail = lambda z: 1 / (1 + math.exp(min(700.0, max(-700.0, 0.07056 * z**3 + 1.5976 * z))))
    u = token.rstrip("=").translate(str.maketrans("-_", "+/"))
    if u.isdigit():
        k, alphabet = 10, "0123456789"
    elif set(u) <= set("0123456789abcdef") or set(u) <= set("0123456789ABCDEF"):
        k, alphabet, u = 16, "0123456789abcdef", u.lower()
    elif set(u) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        k, alphabet = 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    else:
        k, alphabet = 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    v = [alphabet.index(c) for c in u]
    n, up = len(v), [2 * x >= k for x in v]
    chi = (sum(v.count(x) ** 2 for x in set(v)) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    h = sum(up)
    turns = 1 + sum(a != b for a, b in itertools.pairwise(up))
    runs = 40.0 if h in (0, n) else (turns - (2 * h * (n - h) / n + 1)) / math.sqrt(max(1e-9, 2 * h * (n - h) * (2 * h * (n - h) - n) / (n * n * (n - 1))))
    serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in itertools.pairwise(v)) / math.sqrt(n - 1) / ((k * k - 1) / 12)
    if pairs is None:
        return min(1, 3 * min(tail(chi), 2 * tail(abs(runs)), 2 * tail(abs(serial))))
    letters = range(6 if k == 16 else 26)
    own = [pairs[a * 26 + b] for a in letters for b in letters]
    seen = [pairs[(ord(a) - 97) * 26 + ord(b) - 97] for a, b in itertools.pairwise(u.lower()) if "a" <= a <= "z" and "a" <= b <= "z"]
    mean = sum(own) / len(own)
    sd = math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))
    words = 1.0 if len(seen) < 6 else tail((sum(seen) - len(seen) * mean) / (math.sqrt(len(seen)) * sd))
    return min(1, 4 * min(tail(chi), 2 * tail(abs(runs)), 2 * tail(abs(serial)), words))


def keys_and_plain(rng, n):
    import base64

    kinds = [lambda: base64.b64encode(rng.randbytes(30)).decode(), lambda: rng.randbytes(16).hex().upper(), lambda: base64.b32encode(rng.randbytes(25)).decode(), lambda: base64.urlsafe_b64encode(rng.randbytes(48)).decode()]
    nouns = ["configuration", "documentation", "directories", "repositories", "possibilities", "internal", "external", "customer", "Settings", "Manager", "release", "version"]
    some = lambda k: rng.sample(nouns, k)
    plain = [
        lambda: "_".join([*some(3), str(rng.randrange(100))]), lambda: "".join(x.capitalize() for x in some(4)), lambda: "/".join(["usr", "lib", "python3", *some(3)]), lambda: "-".join(["2024", "01", *some(2), str(rng.randrange(9))]),
        lambda: "ab12" * rng.randrange(5, 12), lambda: "a" * 25 + "1", lambda: "A1" * 15, lambda: "2024" * 6, lambda: "0" * 30,
    ]
    return [kinds[i % len(kinds)]() for i in range(n)], [plain[i % len(plain)]() for i in range(n)]


def test_the_battery_in_sql_equals_the_plain_one(spark):
    keys, plain = keys_and_plain(random.Random(3), 60)
    tokens = [*keys, *plain, "01234567890123456789", "a1" * 4000]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").selectExpr("t", S.randomness("t") + " as p").collect()
    assert all(abs(r.p - battery(r.t)) < 1e-9 for r in got)
    pairs = [random.Random(i).gauss(0, 1) for i in range(676)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").selectExpr("t", S.randomness("t", pairs) + " as p").collect()
    assert all(abs(r.p - battery(r.t, pairs)) < 1e-9 for r in got)


def test_runs_told_by_their_letters_alone(spark):
    rng = random.Random(8)
    keys, plain = keys_and_plain(rng, 200)
    names = [x[:n] for n in S.CLASSES for _ in range(100) for x in ["".join(w.capitalize() for w in rng.choices(WORDS, k=32)), "_".join(rng.choices(WORDS, k=32)).upper(), "-".join(rng.choices(WORDS, k=32)), "/".join(rng.choices(WORDS, k=32))]]
    pairs = [random.Random(i).gauss(0, 1) for i in range(676)]
    df = spark.createDataFrame([(t,) for t in [*keys, *plain, *names, "ab" * 12 + "==", "Q" * 30 + "=", "a" * 30, "A1" * 20]], "t string")
    n, letters = S.told_by("t")
    got = {r.t: r.told for r in df.selectExpr("t", f"{n} as n", f"{letters} as letters").selectExpr("t", S.unlike_chance("t", "n", "letters", 0.005) + " as told").collect()}
    # what is told is so in the battery, whatever the letter pairs; keys are left to it, and most names are not
    assert all(battery(t, pairs) < 0.005 for t, told in got.items() if told)
    assert not any(got[t] for t in keys)
    assert all(sum(got[t] for t in names if len(t) == k) >= share * 400 for k, share in ((20, 0.3), (32, 0.7), (64, 0.9)))


WORDS = "the of and key scan alpha node stream config merge sort cache write table user token reader index value handler request session manager storage bucket local remote update delete insert column window number result buffer thread memory public private final static factory builder service client server socket channel message queue worker task".split()


def identifier(rng):
    some = [rng.choice(WORDS) for _ in range(rng.randrange(4, 7))]
    title = "".join(x.capitalize() for x in some)
    return rng.choice([title, some[0] + "".join(x.capitalize() for x in some[1:]), "-".join(some) + str(rng.randrange(99)), f"{title}-{rng.randrange(99):02}", f"{title[0].lower()}{title[1:]}/v{rng.randrange(9)}", "_".join(some) + "_2", "/".join(some) + "/a1"])


def texts_with(rng, n, each, more=()):
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return [(i, " ".join([prose(40), *[f"{identifier(rng)} {prose(3)}" for _ in range(each)], *[x for j, x in enumerate(more) if j == i], prose(40)])) for i in range(n)]


def test_identifiers_without_any_key(spark):
    for n in (60, 500):
        rows = texts_with(random.Random(n), n, 4)
        got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sum(s.kind == 3 for r in got for s in r.spans) <= n * 4 / 1000


def test_a_key_among_a_thousand_identifiers(spark):
    import base64

    rng = random.Random(12)
    keys = [base64.b64encode(rng.randbytes(n)).decode() for n in (24, 30, 48)]
    rows = texts_with(rng, 750, 4, keys)
    got = [s.token for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() for s in r.spans if s.kind == 3]
    assert len(set(got) & set(keys)) >= 2 and len(got) <= 5


def test_letter_pairs_of_whole_texts(spark):
    import math

    rng = random.Random(21)
    texts = [" ".join(rng.choice(("Alpha", "beta-7", "x" * 25, "ga_mma", "é𝒳delta", "q", "12")) for _ in range(700)) + " zebra jumping" * 40 for _ in range(5)] + ["", None, "AB", "kV" * 30]
    seen = [p for t in texts for w in re.findall("[A-Za-z]+", re.sub("[A-Za-z0-9+/_-]{20,}", " ", t or "")) for p in itertools.pairwise(w.lower())]
    after = {a: sum(x == a for x, _ in seen) for a in "abcdefghijklmnopqrstuvwxyz"}
    want = [math.log(26 * (sum(p == (a, b) for p in seen if p[0] == a) + 0.5) / (n + 13)) for a, n in after.items() for b in after]
    got = S.letter_pairs(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-12


def test_decoys_of_whole_texts(spark):
    rng = random.Random(22)
    texts = {i: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(600)] for i in range(30)}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(90, ""), (91, "one"), (92, "two words"), (93, "A1" * 20)]
    got = {r.i: r.d for r in spark.createDataFrame(rows, "i long, text string").selectExpr("i", S._decoys("text") + " as d").collect()}
    assert not any(got[i] for i in (90, 91, 92, 93))
    assert {len(d) for i in texts for d in got[i]} == set(S.CLASSES)
    # words at any place of a text are in decoys, but where these have neither digits nor cases or cut a word in two
    letters = {i: re.sub("[^a-z]", "", "".join(d).lower()) for i, d in got.items()}
    for part in (slice(0, 200), slice(200, 400), slice(400, 600)):
        assert sum(w in letters[i] for i in texts for w in texts[i][part]) > 0.6 * 200 * len(texts)


def test_false_discoveries_among_what_is_reported(spark):
    rng = random.Random(7)
    syllables = ["tion", "the", "ing", "er", "and", "on", "an", "re", "st", "en", "of", "to"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    keys, plain = keys_and_plain(rng, 200)
    rows = [(i, f"{prose(60)} see {k} here {prose(60)}") for i, k in enumerate(keys + plain)]
    got = {r.doc_id: [s.token for s in r.spans if s.kind == 3] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    true = sum(got[i] == [k] for i, k in enumerate(keys))
    false = sum(len(got[i]) for i in range(len(keys), len(rows)))
    assert true >= 0.9 * len(keys)
    assert false <= 0.1 * (true + false)
    # runs alone, with no ordinary text to compare with: nothing is known, nothing is reported
    few = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, text string")
    assert not any(s.kind == 3 for r in S.find_secrets(few).collect() for s in r.spans)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdef{i} {'x1Y2' * 6}" for i in range(6000))
    (r,) = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.start, s.end) for s in r.base] == [m.span() for m in BASE[0][0].finditer(text)]
    (out,) = S.redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert out.text == BASE[0][0].sub("[secret]", text)


def test_redaction(spark):
    rows = [(1, "é token: abc123x end " + "a1b2c3d4" * 5, 99), (2, "clean", 5), (3, None, None)]
    out = S.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "é [secret] end [secret]", 23), (2, "clean", 5), (3, None, None)]
    assert hashlib.sha256(b"").hexdigest()


def test_pipeline_equals_its_parts(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    rng = random.Random(9)
    item = words(rng, 30)
    good = lambda: " ".join(words(rng, 60)).capitalize() + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in words(rng, 60))
    texts = {i: good() for i in range(60)} | {i: junk() for i in range(60, 100)}
    twin = texts[3].split()
    twin[30] = "changed"
    texts |= {100: texts[3], 101: " ".join(twin), 102: " ".join(words(rng, 30) + item + words(rng, 10)), 103: good() + " password = hunter2hunter2"}
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(60)) | {103}
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    stages = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in C.STAGES[:-1]:
        stages = f(spark, stages, str(tmp_path))
        assert stages.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stages.where("doc_id = 103").first().text.endswith("[secret]")


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    rng = random.Random(10)
    one, two, three = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, one, "x"), (1, one, "x"), (1, two, "x"), (2, one + " end", "y"), (None, two, "z"), (None, None, "z"), (3, None, "z"), (3, None, "z"), (4, "", "z"), (5, three, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"many": F.lit(1), "lang": F.lit("en")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = C.one_of_each_group(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text)
    assert [t for _, t in got].count(three) == 1 and len(got) == 3 and sum(t in (one, one + " end") for _, t in got) == 1 and sum(t == two for _, t in got) == 1
    assert sorted(str(r.doc_id) for r in kept.collect() if not r.text) == ["3", "4", "None"]
    for _, f in C.STAGES[:-1]:
        assert f(spark, df.where("false"), str(tmp_path)).count() == 0 and f(spark, df, str(tmp_path)).columns == df.columns
    assert C.good_quality(spark, df, str(tmp_path)).count() == len(rows) == C.no_leaks(spark, df, str(tmp_path)).count()


def test_the_stage_of_secrets_reads_whole_texts(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    rng = random.Random(31)
    syllables = ["tion", "the", "ing", "er", "and", "on", "an", "re", "st", "en", "of", "to"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    keys, plain = keys_and_plain(rng, 200)
    # words stand only in some hundredths of each text, behind numbers
    rows = [(i, f"{'1 2 3 ' * 5000}{prose(60)} see {k} here {prose(60)}") for i, k in enumerate(keys + plain)]
    out = {r.doc_id: r.text for r in C.no_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    true = sum("see [secret] here" in out[i] for i in range(len(keys)))
    false = sum("[secret]" in out[i] for i, p in enumerate(plain, len(keys)) if not re.search("[0-9a-f]{24}", p))  # (these are hex of the fixed patterns)
    assert true >= 0.9 * len(keys) and false <= 0.1 * (true + false)


def test_bits_mark_every_row_of_an_id(spark):
    from barwright.plans.bits import may_be_among

    rng = random.Random(32)
    own = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    others = [rng.randrange(-(2**63), 2**63) for _ in range(9000)]
    df = spark.createDataFrame([(x, "t") for x in own[:1500] + others] + [(None, "n"), (own[0], "again")], "k long, t string").repartition(3)
    ids = spark.createDataFrame([(x,) for x in own] + [(None,)], "id long")
    for most, share in ((27, 0.06), (15, 0.2)):
        got = may_be_among(df, "k", ids, "m", most)
        assert got.columns == ["k", "t", "m"]
        got = got.collect()
        assert len(got) == 10502 and all(r.m for r in got if r.k in set(own)) and not any(r.m for r in got if r.k is None)
        assert sum(r.m for r in got if r.k in set(others)) < share * len(others)
    assert not any(r.m for r in may_be_among(df, "k", ids.where("false"), "m").collect())


def test_texts_that_stay_are_not_shuffled(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C

    rng = random.Random(33)
    texts = [" ".join(words(rng, 30)) for _ in range(3000)]
    for i in range(10, 3000, 30):
        texts[i] = texts[i - 7]
    ids = [i * 1009 % 3001 for i in range(3000)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # the ids of what stays are more
    try:
        got = [r.doc_id for r in C.one_of_each_group(spark, df, "").select("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted(set(ids) - {max(ids[i], ids[i - 7]) for i in range(10, 3000, 30)})
    # rows that are not shuffled come in the order in which they are read
    place = {d: i for i, d in enumerate(ids)}
    assert sum(0 < place[b] - place[a] < 9 for a, b in itertools.pairwise(got)) > 0.8 * len(got)
