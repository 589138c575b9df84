"""WARC, URL filters, nearest neighbours and the pipeline."""

import base64
import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lectern.llm import ann, queries, url_filter, warc  # noqa: E402
from lectern.llm.common import Scratch  # noqa: E402
from tests.compare import connection, rows as sorted_rows  # noqa: E402
from tests.llm.test_dedup import passages  # noqa: E402
from tests.llm.test_near_copies import brute  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def page_rows():
    rng = random.Random(1)
    rows = [(i, f"https://h{i % 7}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de'])}/{i}?a=1#x", f"<p>{i % 12}</p>") for i in range(40)]
    rows += [(100, None, None), (101, "no scheme", ""), (102, "http://x\r\ny/ z", "a\r\n\r\nWARC/1.1\r\nb"), (103, "http://é/ü", "é" * 50_000)]
    return rows + [(104, "http://d/", "same row"), (104, "http://d/", "same row"), (None, "http://n/", "<p>1</p>"), (105, "http://big/", "a" * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1, None) for i, u, h in rows], "page_id long, url string, html string, sha string, size long, page string")


def test_warc_round_trip(spark):
    rows = page_rows()
    out = warc.round_trip(pages(spark, rows)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        lead = first[h or ""] == i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if lead else "revisit", None if lead else first[h or ""]))
    assert Counter(tuple(r)[:5] for r in out) == Counter(want)
    assert all(r.requests == 1 for r in out)


def test_warc_least_bytes_and_empty(spark):
    out = warc.round_trip(pages(spark, [(1, "http://a/", "xy"), (2, "http://b/", "xy")]), min_bytes=3).collect()
    assert {r.record_type for r in out} == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_assembly_keeps_orphans(spark):
    row = lambda name, kind, beside: (name, kind, beside, None, None, None, None, None, None)
    records = spark.createDataFrame([row("a", "response", None), row("b", "request", "a"), row("c", "request", "a"), row("d", "metadata", "gone")], warc.FIELDS)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert [x.record_id for x in got["a"].requests] == ["b", "c"] and got["a"].metadata is None
    assert got["gone"].main is None


def test_parse_skips_what_is_no_record():
    data = b"junk\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\ncut"
    assert [(h["warc-type"], b) for h, b in warc.parse(data)] == [("response", b"abc"), ("x", b"")]


def brute_rules(labelled, support, confidence):
    """Association rules of up to three tokens by counting every set."""
    n, sets, hits = len(labelled), Counter(), Counter()
    for items, verdict in labelled:
        for size in (1, 2, 3):
            for part in combinations(sorted(items), size):
                sets[part] += 1
                hits[part, verdict] += 1
    rules = {(p, v): (round(c / sets[p], 9), round(c / n, 9)) for (p, v), c in hits.items() if c >= support * n and round(c / sets[p], 9) >= confidence}
    return {
        (p, v): x for (p, v), x in rules.items()
        if not any((part, v) in rules and rules[part, v][0] >= x[0] for size in range(1, len(p)) for part in combinations(p, size))
    }


def test_url_rules(spark):
    rows = page_rows() + [(200 + i, f"http://m.site{i % 3}.example.{d}/{p}/{i}.html", "") for i, (d, p) in enumerate([(d, p) for d in ("com", "net", "org") for p in ("en", "de", "fr", "es")] * 8)]
    out = url_filter.judge(pages(spark, rows)).collect()
    assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)

    def split(url):
        if "://" not in (url or ""):
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:]
        return rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]

    def rule(host, path):
        fits = [(v, r) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=lambda x: len(x[1])) if fits else (None, None)

    read = spark.createDataFrame([(u,) for _, u, _ in rows], "url string")
    F = url_filter.F
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    tokens = {r.url: r.t for r in read.select("url", url_filter.tokens(F.col("url"), host, path).alias("t")).collect()}
    labelled = [(tokens[u], rule(*split(u))[0]) for _, u, _ in rows if rule(*split(u))[0]]
    mined = brute_rules(labelled, 0.01, 0.8)
    by_url = {u: i for i, u, _ in rows}
    for r in out:
        urls = [u for i, u, _ in rows if i == r.page_id]
        assert (r.host, r.path) in [split(u) for u in urls]
        verdict, name = rule(r.host, r.path)
        assert r.rule == name
        if verdict is None:
            fired = [(-c, -s, " ".join(p), v) for (p, v), (c, s) in mined.items() if set(p) <= set(tokens[urls[0]])]
            verdict = min(fired)[3] if fired else "allow"
        assert r.verdict == verdict, (by_url, r)


@pytest.mark.parametrize("sample_rows", [10_000, 260])
def test_rules_of_long_baskets_against_all_combinations(spark, sample_rows):
    """Thirty tokens that always come together, and others: the rules of all sets of up to three tokens, counted over all rows."""
    rng = random.Random(14)
    together = [f"p:t{i:02}" for i in range(30)]
    rows = []
    for i in range(300):
        own = rng.sample([f"p:w{j}" for j in range(6)], 3)
        rows.append((i, sorted(own + (together if i % 3 == 0 else rng.sample(together, 2))), "block" if "p:w1" in own or i % 9 == 0 else "allow"))
    table = spark.createDataFrame(rows, "page_id long, tokens array<string>, verdict string")
    counts, totals = Counter(), Counter()
    for _, tokens, verdict in rows:
        for size in (1, 2, 3):
            for found in combinations(tokens, size):
                counts[found, verdict] += 1
                totals[found] += 1
    want = {(s, v): (round(c / totals[s], 9), round(c / 300, 9)) for (s, v), c in counts.items() if c >= 30 and c / totals[s] >= 0.8}
    want = {(s, v): x for (s, v), x in want.items() if not any(x[0] <= want.get((part, v), (-1,))[0] for n in range(1, len(s)) for part in combinations(s, n))}
    got = url_filter.mine(table, Scratch(spark, "test"), min_support=0.1, sample_rows=sample_rows).collect()
    assert {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in got} == want


def test_url_filter_empty(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0
    assert url_filter.judge(pages(spark, [(1, "http://a.com/x", None)])).first()["verdict"] == "allow"


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    same = [(1000 + i, base[20][1]) for i in range(40)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [1.0, 2.0]), (None, base[1][1]), (2100, [float("inf")] * 16), (2120, [])]
    rows = base + same + odd
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cell int")
    out = ann.nearest(df).collect()
    ids = np.array([i for i, _ in base + same])
    matrix = np.array([v for _, v in base + same])
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == query)
        assert [r for r, _, _ in own] == list(range(1, 21)) and query not in [v for _, v, _ in own]
        assert own == sorted(own, key=lambda x: (-x[2], x[1])) or all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(own, own[1:]))
        scores = matrix @ matrix[ids == query][0]
        scores[ids == query] = -np.inf
        hits += len({v for _, v, _ in own} & set(ids[np.lexsort((ids, -np.round(scores, 9)))[:20]].tolist()))
        total += 20
    assert {r.query_id for r in out} == set(ids[ids % 20 == 0].tolist())
    assert hits >= 0.9 * total


def test_neighbours_of_few(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann.nearest(make([])).count() == 0
    assert ann.nearest(make([(20, [1.0, 0.0])])).count() == 0
    got = ann.nearest(make([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.0]), (3, [-1.0, 0.0])])).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (2, 0.5), (3, -1.0)]


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(i % 3 + 1) * 4).tolist()) for i in range(240)] + [(1000, [1.0]), (1001, [2.0]), (1002, [-1.0]), (1020, [1.0, 1.0]), (1040, [3.0, 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[1000]) == [(1, 1001, 2.0), (2, 1002, -1.0)] and got[1020] == [(1, 1040, 4.0)] and got[1040] == [(1, 1020, 4.0)]
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    known = dict(rows)
    for query, own in got.items():
        assert all(len(known[v]) == len(known[query]) for _, v, _ in own) and len(own) == min(20, sum(len(v) == len(known[query]) for v in known.values()) - 1)


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op10_nearest_neighbours(spark, folder).toPandas()
    data = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    matrix, ids = np.stack(data.embedding).astype(float), data.vec_id.to_numpy()
    hits = 0
    for query, own in out.groupby("query_id"):
        scores = matrix @ matrix[ids == query][0]
        scores[ids == query] = -9
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits >= 0.9 * len(out)


def test_walk_visits_every_cell_in_order():
    rng = np.random.default_rng(5)
    book = ann.Codebook(rng.normal(size=(500, 8)), 6, 0.95, 20)
    query = rng.normal(size=8)
    a, b = book.closeness(query)
    cells = list(book.walk(query))
    assert sorted(cells) == list(range(36))
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert all(x >= y - 1e-12 for x, y in zip(sums, sums[1:]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = connection(FOLDER)
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLE[name])
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == sorted_rows(want.columns, want.fetchall())


def test_pipeline(spark):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    read = lambda df: [(r.doc_id, r.text, r.lang) for r in df.collect()]
    scratch = Scratch(spark, "test")
    before = read(docs)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, FOLDER), name)
        if name != "best_fit_packing":
            assert out.columns == columns
        rows = read(out) if name != "best_fit_packing" else None
        if name == "language_id":
            assert {i for i, _, _ in rows} == {i for i, t, _ in before if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            last = {}
            for i, t, _ in before:
                low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                last[low] = max(last.get(low, i), i)
            assert {i for i, _, _ in rows} == set(last.values())
        elif name == "simhash_near_dedup":
            assert {i for i, _, _ in rows} == set(brute(before))
        elif name == "suffix_array_dedup":
            removed = {i: n for i, _, n, _, _ in passages(before, corpus_pipeline.PASSAGE_BYTES)}
            assert Counter(i for i, _, _ in rows) == Counter(i for i, _, _ in before)
            was = {i: len(t.encode()) for i, t, _ in before}
            assert all(0 <= len(t.encode()) - (was[i] - removed[i]) <= 6 * 10 for i, t, _ in rows)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            assert {r.doc_id for r in out.collect()} == {i for i, _, _ in before}
        before, docs = rows, out
        kept.append(name)
    assert kept == [n for n, _ in corpus_pipeline.STAGES]
