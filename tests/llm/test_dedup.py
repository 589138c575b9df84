"""Exact, near and passage dedup against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, simhash, suffix_dedup
from lectern.llm.common import Scratch, ascii_lower
from lectern.llm.components import connected_components
from tests.llm.data import awkward, wide, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def exact(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    out = []
    for i, t, _ in rows:
        body = (t or "").translate(UP)
        ids = [x for x in groups[body] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[body]), keep is None or i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=key)


def test_exact_dedup(spark):
    rows = awkward()
    got = exact_dedup.exact_dedup(wide(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=key) == exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(wide(spark, [])).count() == 0


def test_chunks_are_the_text(spark):
    rows = [(i, t or "") for i, (_, t, _) in enumerate(awkward())]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("c", exact_dedup.chunk_list(F.col("t"), 16, 64))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(len(c) <= 64 for c in r.c)


def test_collided_chunks_are_told_apart(spark, monkeypatch):
    """With a hash of two values only, equal texts still group and others don't."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)))
    rows = awkward()
    got = exact_dedup.exact_dedup(wide(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    monkeypatch.undo()
    assert [r[:4] for r in sorted(map(tuple, got), key=key)] == [r[:4] for r in exact(rows)]


def test_ascii_lower(spark):
    df = spark.createDataFrame([("AbÉİ",), ("ABC",), (None,)], "t string").select(ascii_lower(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["abÉİ", "abc", None]


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(prints):
    """prints: list of (id, fingerprint)."""
    at = list(range(len(prints)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                at[root(a)] = root(b)
    low = {}
    for n, (i, _) in enumerate(prints):
        if i is not None:
            low[root(n)] = min(low.get(root(n), i), i)
    return [low.get(root(n)) for n in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(2)
    rows = awkward()
    base = words(rng, 400)
    parts = base.split()
    for n in range(60):  # a crowd of near copies
        changed = list(parts)
        changed[rng.randrange(len(parts))] = f"w{n}"
        rows.append((1000 + n, " ".join(changed), "en"))
    got = simhash.near_duplicates(wide(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(wide(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [2, 32])
def test_links_of_dense_fingerprints(spark, monkeypatch, cell):
    """Balls of fingerprints, paired in cells or met at hubs, have the components of all pairs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    scratch = Scratch(spark, "test")
    nodes = scratch.save(spark.createDataFrame([(p,) for p in prints], "fp long"), "nodes")
    found = connected_components(simhash.links(nodes, scratch), scratch)
    labels = {r.node: r.label for r in found.collect()}
    want = components([(p, p & (1 << 64) - 1) for p in prints])
    assert [labels.get(p, p) for p in prints] == want


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200), (None, 3), (301, 300), (302, 301), (300, 302)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    assert {r.label for r in out if r.node <= 100} == {0}
    assert {(r.node, r.label) for r in out if r.node > 100} == {(200, 200), (300, 300), (301, 300), (302, 300)}


def passages(rows, length=400):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in texts:
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=key)


def repeated():
    rng = random.Random(3)
    shared = [words(rng, 150) for _ in range(4)]
    rows = [r for r in awkward() if len(r[1] or "") < 20_000]
    for i in range(40):
        text = words(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 80)
            q = p[a : rng.randint(a, len(p))]
            if rng.random() < 0.5 and len(q) > 10:
                at = rng.randrange(len(q))
                q = q[:at] + "Z" + q[at + 1 :]
            text += q + words(rng, rng.randint(0, 60))
        rows.append((100 + i, text, "en"))
    rows += [(200, "ab " * 600, "en"), (201, "a" * 900, "en"), (202, "a" * 399, "en"), (203, "a" * 400, "en"), (203, "a" * 400, "en"), (204, "There " * 100 + "is " * 150, "en")]
    rows += [(300 + i, shared[1][i * 3 :] + words(rng, 5) + shared[2][: -(i + 1)] + str(i), "en") for i in range(30)]
    return rows


@pytest.mark.parametrize("length", [400, 240])
def test_passages(spark, length):
    rows = repeated()
    got = suffix_dedup.repeated_passages(wide(spark, rows), length=length).drop("spans").collect()
    assert sorted(map(tuple, got), key=key) == passages(rows, length)


def test_passages_of_little(spark):
    assert suffix_dedup.repeated_passages(wide(spark, [])).count() == 0
    assert suffix_dedup.repeated_passages(wide(spark, [(1, "short", "en")])).first()["n_removed"] == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(wide(spark, []), length=10)


def collided():
    """Two different 400-byte texts of equal polynomial hash modulo 2**64: the Thue-Morse sequence over two words, and its complement.

    The words' own hashes agree in their low 28 bits, and the sequence doubles the power of two in the difference again and again.
    """
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words_ = np.stack(np.meshgrid(*[letters] * 4, indexing="ij"), -1).reshape(-1, 4)
    powers, _ = suffix_dedup._power_tables(4)
    low = (suffix_dedup._VALUES[words_] * powers[:4]).sum(axis=1, dtype=np.uint64) & np.uint64(2**28 - 1)
    order = np.argsort(low, kind="stable")
    edges = "a" * 144, "bc" * 72, "edge" * 36
    for edge, at in itertools.product(edges, np.flatnonzero(np.diff(low[order]) == 0).tolist()):
        a, b = (words_[order[at + i]].tobytes().decode() for i in (0, 1))
        pair = [edge[:70] + "".join(y if bin(i).count("1") % 2 else x for i in range(64)) + edge[70:] for x, y in ((a, b), (b, a))]
        made = [suffix_dedup.Rolling(t.encode()) for t in pair]
        # an anchor would tell them apart before whole windows are compared
        if len({int(x.hashes(np.zeros(1, int), np.full(1, 400))[0]) for x in made}) == 1 and not any(len(x.anchors(400)[0]) for x in made):
            return pair
    raise AssertionError("no pair found")


def test_texts_of_equal_rolling_hash_stay(spark):
    pair = collided()
    assert pair[0] != pair[1] and {len(t) for t in pair} == {400}
    rows = [(i, t, "en") for i, t in enumerate(pair)]
    assert [r.n_removed for r in suffix_dedup.repeated_passages(wide(spark, rows)).collect()] == [0, 0]


def test_only_the_digest_makes_windows_equal(spark, monkeypatch):
    """With rolling hashes of four values nothing but equal bytes is removed."""
    rows = [r for r in repeated() if len(r[1] or "") < 3000][:60]
    real = suffix_dedup.Rolling.hashes

    def fewer(make):
        def outer(*args):
            run = make(*args)

            def inner(batches):
                suffix_dedup.Rolling.hashes = lambda self, a, b: real(self, a, b) & np.uint64(3)
                try:
                    yield from run(batches)
                finally:
                    suffix_dedup.Rolling.hashes = real

            return inner

        return outer

    for name in ("_name_rows", "_cell_rows", "_window_rows"):
        monkeypatch.setattr(suffix_dedup, name, fewer(getattr(suffix_dedup, name)))
    got = suffix_dedup.repeated_passages(wide(spark, rows)).drop("spans").collect()
    assert sorted(map(tuple, got), key=key) == passages(rows)


def test_passages_cut_from_texts(spark):
    text = "é" * 500
    rows = [(1, "start " + text + " end", "en"), (2, text, "en"), (3, None, None), (4, "alone", "en")]
    docs = wide(spark, rows)
    out = suffix_dedup.remove_passages(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "start  end", 2: "", 3: None, 4: "alone"}


def test_sample_ranks_are_the_suffix_order(spark):
    rng = random.Random(4)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(strings)), "id long, names array<long>")
    out = suffix_dedup.sample_ranks(df, Scratch(spark, "test"), reach=100)
    got = []
    for r in out.collect():
        places = [j for j in range(len(strings[r.id])) if j % 3]
        got += [(rank, strings[r.id][j:]) for rank, j in zip(r.ranks or [], places)]
    got.sort(key=lambda x: x[0])
    assert [s for _, s in got] == sorted(s for _, s in got)
    assert len({rank for rank, _ in got}) == len({tuple(s) for _, s in got})


def test_comparison_spans_batches():
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 2), [rng.randint(0, 2) for _ in range(rng.randint(0, 5))], i) for i in range(60))
    made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int64()), pa.int64()))], ["tag", "prefix", "id"])
    made = made.append_column("j", pa.array([0] * 60, pa.int32()))

    def shared(a, b):
        return len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[1], b[1])))) if a[0] == b[0] else 0

    near = [suffix_dedup.FAR, *map(shared, rows, rows[1:]), suffix_dedup.FAR]
    right = [(row[2], max(pair)) for row, pair in zip(rows, zip(near, near[1:]))]
    for size in (1, 7, 60):
        batches = [made.slice(0, 0)] + [made.slice(at, size) for at in range(0, 60, size)]
        out = [(r["id"], r["shared"]) for b in suffix_dedup._compared(iter(batches)) for r in b.to_pylist()]
        assert out == right
    assert not list(suffix_dedup._compared(iter([])))


def test_colliding_row_keys(spark, monkeypatch):
    """With keys of 37 values, unrelated documents lose nothing and repeated passages still go."""
    real = suffix_dedup._hash
    monkeypatch.setattr(suffix_dedup, "_hash", lambda *c: real(*c) if len(c) > 2 else F.pmod(real(*c), F.lit(37)))
    rng = random.Random(11)
    rows = [(i, words(rng, 200), "en") for i in range(60)] + [(None, words(rng, 200), "en"), (7, words(rng, 250), "en")]
    rows += [(100, rows[0][1] + " more", "en"), (101, rows[5][1], "en"), (101, rows[5][1], "en")]
    got = suffix_dedup.repeated_passages(wide(spark, rows)).drop("spans").collect()
    want = passages(rows)
    assert sorted(map(tuple, got), key=key) == want and sum(r[2] > 0 for r in want) == 5
    cut = Counter((r.doc_id, len((r.text or "").encode())) for r in suffix_dedup.remove_passages(wide(spark, rows)).collect())
    assert cut == Counter((i, n - gone) for i, n, gone, _, _ in want)


def test_keys_that_never_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_hash", lambda *c: F.lit(1).cast("long"))
    with pytest.raises(RuntimeError, match="clash"):
        suffix_dedup.repeated_passages(wide(spark, [(1, "a", "en"), (2, "b", "en")]))


def test_passages_travel_in_packs(spark, monkeypatch):
    """Anchors, cells and windows are no rows: fewer rows than a tenth of the repeated windows are written, and the result holds."""
    rng = random.Random(12)
    passages_ = [words(rng, 300) for _ in range(5)]
    rows = [(i, words(rng, 20) + passages_[i % 5][i : i + 1200 + i % 7] + words(rng, 20), "en") for i in range(60)]
    written = []
    save = Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        # the suffixes' own sort goes by row
        written.append(out.count() if name not in ("triples", "names", "suffixes") else 0)
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = suffix_dedup.repeated_passages(wide(spark, rows)).drop("spans").collect()
    want = passages(rows)
    assert sorted(map(tuple, got), key=key) == want and sum(r[2] for r in want) > 60_000
    assert max(written) < 2000


def test_a_bucket_counts_what_batches_summed():
    """Equal keys of one batch travel once, with their sum; the others and what is decided already go back at once."""
    rows = np.array([[1, 2, 3, 4, 5], [1, 1, 1, 0, 1], [7, 7, 8, 7, 9], [10, 20, 30, 40, 50]])
    later = np.array([[6, 7], [1, 2], [8, 11], [60, 70]])

    def flat(parts):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array(r) for r in p], ["k", "c", "h", "at"]) for p in parts)

    for lone, want in ((False, {(1, 10), (2, 20), (3, 30), (4, 40), (6, 60), (7, 70)}), (True, {(5, 50)})):
        back, packs = [], []
        for part in (rows, later):
            packs += suffix_dedup._to_buckets(flat([part.copy()]), 1, 3, 4, lone)(iter([]))
        table = pa.Table.from_batches(packs)
        for number in range(3):
            bucket = table.filter(pc.and_(pc.invert(table["sure"]), pc.equal(table["part"], number)))
            if bucket.num_rows:
                back.append(suffix_dedup._chosen(4, 1, 4, lone)(bucket))
        done = pa.concat_tables([table.filter(table["sure"]), *back])
        got = [(k, at) for number in set(done["part"].to_pylist()) for k, e in zip(*suffix_dedup._by_document(["at"])(done.filter(pc.equal(done["part"], number))).to_pydict().values()) for at in e]
        assert sorted(got) == sorted(want)
