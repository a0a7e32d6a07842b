"""Lexical search, mixing and the Merkle manifest against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from slipwright.llm import lexical, merkle, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_docs(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "Cat", "dog", "ÄRGER", "x1", "über", "rare" + str(seed), "sun", "moon"]
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "  \t", *[" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 40]))) + rng.choice(["", ".", "\n", " é–"]) for _ in range(9)]])
        rows.append((rng.choice([k, k, k, None, 7]), text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None]), rng.choice([None, 3])))
    rows += [rows[-1]] * 4 + [(9_000_000_000_000, "the cat " * 3000, "en", "a", 1), (-5, "moon", "en", "b", 2), (-(1 << 63), "moon", "de", "b", 2)]
    return rows


def plain_search(docs, items, k=20):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for name, text in items:
        scored = []
        for d, c in found:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(name, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 200])
def test_search_equals_plain_scores(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 16)
    monkeypatch.setattr(lexical, "HELD", 70)
    docs = made_docs(1)
    items = [(1, "the cat the dog"), (2, None), (3, "nothing here"), (4, "RARE1 ärger über"), (4, "moon moon sun"), (5, ""), (None, "x1"), (6, "moon"), (8, "moon moon moon"), (7, "the ÄRGER cat x1 sun dog")]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_search(docs, items)))


def test_buckets_and_bounds_lose_nothing():
    """Pruned search over random vectors equals full scores, ties and all."""
    rng, lexical_k = np.random.default_rng(3), 5
    for _ in range(30):
        n = int(rng.integers(1, 400))
        weights = rng.integers(0, 9000, 40)
        rows = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, int(rng.integers(1, 12)), replace=False)} for _ in range(n)]
        m, ids = [int(x) for x in rng.integers(75, 200, n)], [int(x) for x in rng.integers(0, 1000, n)]
        old, lexical.BUCKET = lexical.BUCKET, 32
        try:
            vectors = lexical.Vectors(ids, rows, m, weights)
            for _ in range(5):
                terms = rng.choice(40, 6, replace=False)
                q = weights[terms] * rng.integers(1, 3, 6)
                terms, q = terms[q > 0], q[q > 0]
                full = [(sum(int(w) * (1_000_000_000 * r[t] // (1000 * r[t] + 12 * x)) for t, w in zip(terms.tolist(), q) if t in r), d) for r, x, d in zip(rows, m, ids)]
                want = sorted([f for f in full if f[0] > 0], key=lambda f: (-f[0], f[1]))[:lexical_k]
                assert [(s, d) for s, _, d in vectors.search(terms, q, weights, [], lexical_k)] == want
        finally:
            lexical.BUCKET = old


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest, total = budget - sum(most * sizes[s] for s in full), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        full |= over


def test_mix_meets_targets(spark):
    docs = made_docs(2)
    df = spark.createDataFrame(docs, DOCS)
    got = mixing.plan(df).collect()
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(SPACE.findall(text or ""))
    want = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, len(SPACE.findall(t or ""))) for d, t, *_ in docs)
    for source in sizes:
        rows = [r for r in got if r.source == source]
        assert {r.source_size for r in rows} == {sizes[source]} and all(abs(r.target - want[source]) < 1e-6 for r in rows)
        assert sum(r.taken for r in rows) == round(want[source]) and all(0 <= r.taken <= 2 * r.size for r in rows)
        # complete epochs first, then a front of the order: at most one document is taken in part
        least = round(want[source]) // sizes[source]
        assert all(r.taken >= least * r.size for r in rows) and sum(r.taken not in (least * r.size, (least + 1) * r.size) for r in rows) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(df.repartition(3)).collect()))
    assert mixing.plan(df.filter("false")).count() == 0
    assert {r.target for r in mixing.plan(df.filter("text = ''")).collect()} == {0.0}


def test_mixture_has_the_words_of_its_plan(spark):
    docs = [(*d, k) for k, d in enumerate(made_docs(3, 80))]
    df = spark.createDataFrame(docs, DOCS + ", _size long").drop("_size").withColumnRenamed("n_chars", "_taken")
    mixed, plan = mixing.mixture(df), mixing.plan(df)
    assert mixed.columns == df.columns and mixing.mixture(df.filter("false")).count() == 0
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(SPACE.findall(r.text))
    taken = Counter()
    for r in plan.collect():
        taken[r.source] += r.taken
    assert words == +taken


def test_heavy_documents_come_first_more_often():
    """Exponential keys: of two documents the one of three times the weight stands first in three of four draws."""
    rng = np.random.default_rng(1)
    u = rng.random((20_000, 2))
    first = (-np.log(u[:, 0]) / 0.9 < -np.log(u[:, 1]) / 0.3).mean()
    assert abs(first - 0.75) < 0.01


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root and, for each node, its siblings by level, and its places."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            ways[i].append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
            at[i] = k // 8
        level = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return (level[0] if level else None), ways


def plain_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: sha(*map(field, (d[0], d[3], d[2], d[4], t)))
    order = lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1]))
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {lang: sorted([d for d in docs if d[2] == lang], key=order) for lang in langs}
    trees = {lang: plain_tree([leaf(d, d[1]) for d in groups[lang]]) for lang in langs}
    root, above = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for d, way in zip(groups[lang], trees[lang][1]):
            node = leaf(d, d[1].translate(LOWER) if d[1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else d[1])
            path = way + above[k]
            for turn, others in path:
                node = sha(*others[:turn], node, *others[turn:])
            out.append((d[0], leaf(d, d[1]), trees[lang][0], root, sha(*[x for _, others in path for x in others]), node, node == root))
    return out


@pytest.mark.parametrize("n", [1, 8, 9, 65, 700])
def test_manifest_equals_plain_tree(spark, n):
    docs = made_docs(4, n)
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", range string")
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(docs)))
    assert n < 65 or any(not r[-1] for r in got)


def test_manifest_of_many_levels_and_nothing(spark):
    docs = [(k * 37 - 5000, f"Text {k}", "en", "s", k) for k in range(5000)] + [(1, "Only", None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    assert sorted(map(repr, map(tuple, merkle.manifest(df).collect()))) == sorted(map(repr, plain_manifest(docs)))
    assert merkle.manifest(df.filter("false")).count() == 0


def test_bitmaps_pack_and_rank():
    rng = np.random.default_rng(5)
    for n in (0, 1, 200, 3000, 4096):
        held = np.zeros(4096, bool)
        held[rng.choice(4096, n, replace=False)] = True
        raw = merkle.packed(held)
        assert (merkle.unpacked(raw) == held).all() and len(raw) <= 513


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_mixing", "op13_merkle"])
def test_new_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    result, columns = con.sql(entry.oracle_sql()[name]), sorted(df.columns)
    place = [result.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(repr(tuple(r[k] for k in place)) for r in result.fetchall())
