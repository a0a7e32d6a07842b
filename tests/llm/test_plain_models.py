"""What the learned and decoded operators compute, against plain versions; and the removing forms on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from slipwright.llm import decontaminate, media, quality, simhash, toxicity


def _plain_boosting(rows, labels, trees, depth, rate, ridge, bins):
    """Margins of all rows, each node's split found by trying every value of every column's edges."""
    edges = [sorted(set(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))) for f in range(rows.shape[1])]
    margin = [math.log(labels.mean() / (1 - labels.mean()))] * len(rows)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]
        groups = [list(range(len(rows)))]
        for _ in range(depth):
            split = []
            for group in groups:
                gain_of = lambda part: sum(g[k] for k in part) ** 2 / (sum(h[k] for k in part) + ridge)
                best, halves = 1e-6, (group, [])
                for f, values in enumerate(edges):
                    for value in values:
                        left = [k for k in group if rows[k, f] <= value]
                        right = [k for k in group if rows[k, f] > value]
                        if min(sum(h[k] for k in left), sum(h[k] for k in right)) < 1:
                            continue
                        gain = gain_of(left) + gain_of(right) - gain_of(group)
                        if gain > best + 1e-12:
                            best, halves = gain, (left, right)
                split += halves
            groups = split
        for group in groups:
            step = rate * sum(g[k] for k in group) / (sum(h[k] for k in group) + ridge)
            for k in group:
                margin[k] += step
    return np.array(margin)


def test_boosting_equals_exhaustive_splits():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3):
        rows = np.round(rng.normal(size=(90, 4)), 1)
        rows[:, 3] = 1.0  # a column that says nothing
        labels = (rows[:, 0] + rows[:, 1] * rows[:, 2] + rng.normal(size=90) > 0).astype(float)
        model = quality.fit(rows, labels, trees=4, depth=depth, rate=0.3, ridge=2.0, bins=12)
        margin = _plain_boosting(rows, labels, 4, depth, 0.3, 2.0, 12)
        assert np.allclose(model.score(rows), 1 / (1 + np.exp(-margin)))


def _plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)}


def _plain_features(words):
    return {b"=" + w for w in words} | {w[:k] for w in words for k in range(3, 8) if len(w) >= k}


def test_toxicity_equals_plain_version(spark):
    """The kept features by definition, and weights at which the whole penalised loss has no slope."""
    rng = random.Random(8)
    vocabulary = "women men muslim jewish vile vilest nice nicer tree road été Ärger rotten".split()
    texts = [(k, ". ".join(" ".join(rng.choices(vocabulary, k=5)) for _ in range(3))) for k in range(120)]
    labelled = [(k, int(("vile" in t) + ("muslim" in t) + rng.random() > 1.2)) for k, t in texts]
    texts += [(500, None), (501, ""), (502, "Muslim VILE " * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_features=24)

    sample = [(dict(texts)[k], y) for k, y in labelled if zlib.crc32(str(k).encode()) % 5]
    y = np.array([float(v) for _, v in sample])
    seen = [_plain_features(_plain_words(t)) for t, _ in sample]
    share, ranks = y.mean(), {}
    for f in set().union(*seen):
        has = np.array([f in s for s in seen])
        if has.sum() >= toxicity.MIN_ROWS:
            ranks[f] = abs(y[has].sum() - share * has.sum()) / math.sqrt(has.sum() * share * (1 - share))
    best = sorted(ranks, key=lambda f: (-round(ranks[f], 12), f))[:24]
    names = sorted(best)
    assert sorted(model.index) == names

    x = np.array([[f in s for f in names] + [True] for s in seen], float)
    vector = lambda words: np.array([f in _plain_features(words) for f in names] + [False], float)
    swapped = []
    for text, _ in sample:
        for sentence in re.split(r"[.!?\n。！？]+", text):
            words = _plain_words(sentence)
            for line in toxicity.IDENTITY_TERMS:
                for a in line:
                    if a.encode() in words:
                        swapped += [vector((words - {a.encode()}) | {b.encode()}) - vector(words) for b in line if b != a]
    for line in toxicity.IDENTITY_TERMS:
        swapped += [vector({b.encode()}) - vector({a.encode()}) for a in line for b in line if b > a]
    d = np.array(swapped)
    w = np.array([model.weights[model.index[f]] for f in names] + [model.intercept])
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (p - y) + 0.3 * np.append(w[:-1], 0) + 20.0 * d.T @ (d @ w)
    assert np.abs(slope).max() < 0.02 * len(y)
    assert np.abs(d @ w).max() < 0.2  # no swap changes a margin by much

    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    full = toxicity.train(docs, labels)
    for k, text in texts:
        margin = full.intercept + sum(full.weights[i] for f, i in full.index.items() if f in _plain_features(_plain_words(text)))
        assert abs(scores[k] - 1 / (1 + math.exp(-margin))) < 1e-9
    assert scores[500] == scores[501]


def _shares(cells, size):
    """How much of each of ``size`` samples lies in each of ``cells`` equal stretches, as means' weights."""
    width = size / cells
    return np.array([[max(0.0, min(k + 1, (c + 1) * width) - max(k, c * width)) / width for k in range(size)] for c in range(cells)])


def test_media_features_equal_plain_means(spark):
    rng = random.Random(2)
    texts = [(1, None), (2, ""), (3, "été " * 700), (4, "".join(chr(rng.randrange(33, 126)) for _ in range(40_000))), (5, "same text"), (6, "same text"), (7, "z" * 192), (8, "y" * 193)]
    got = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and got[5].feature == got[6].feature and got[1].feature == got[2].feature
    for k, text in texts:
        raw = (text or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        grey = np.frombuffer(raw.ljust(size), np.uint8).reshape(size // 192, 64, 3).mean(2)
        dhash, digest = got[k].feature.split(":")
        assert hashlib.sha256(got[k].tile).hexdigest() == digest
        small = _shares(8, len(grey)) @ grey @ _shares(9, 64).T
        step = small[:, 1:] - small[:, :-1]
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(dhash), np.uint8)).reshape(8, 8)
        assert np.all(bits[step > 2e-6] == 1) and np.all(bits[step < -2e-6] == 0) and np.all(bits[step == 0] == 0)
        head = got[k].tile.index(b"\n") + 1
        tile = np.frombuffer(got[k].tile[head:], np.uint8).reshape(media.TILE, media.TILE)
        assert np.abs(tile - _shares(media.TILE, len(grey)) @ grey @ _shares(media.TILE, 64).T).max() <= 0.5 + 1e-6


def test_removing_forms_on_odd_tables(spark):
    """Empty tables, columns with names that the operators use, null ids and texts, and one very long text."""
    item = " ".join(f"item{k}" for k in range(13))
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, f"Start {item} end", "r", 1), (2, None, None, 2), (3, "", "x", 3), (None, item, "y", 4), (5, f"{long} {item} tail", "z", 5), (6, "clean words only", "q", 6)]
    clash = "doc_id long, text string, runs string, n_words int"
    docs = spark.createDataFrame(rows, clash)
    for name in ("h", "root", "component_id", "found"):
        docs = docs.withColumn(name, docs["n_words"])
    bench = spark.createDataFrame([("b1", item), (None, None), ("b2", "")], "item_id string, text string")
    none, nothing = docs.filter("false"), bench.filter("false")
    for operator in (decontaminate.remove_contaminated, decontaminate.remove_spans):
        assert operator(none, bench).collect() == [] and operator(none, bench).columns == docs.columns
        assert sorted(map(str, operator(docs, nothing).collect())) == sorted(map(str, docs.collect()))
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [2, 3, 5, 6]
    cut = {r.n_words: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[1].text.split() == ["Start", "end"] and cut[4].text == "" and cut[2].text is None and cut[6].text == "clean words only"
    assert cut[5].text.split() == (long + " tail").split() and cut[5].runs == "z"

    assert simhash.keep_first(none).collect() == [] and simhash.keep_first(none).columns == docs.columns
    twins = [(7, "a b c d e", "r", 1), (None, "a b c d e", "r", 2), (9, "A b c d E", "r", 3), (None, "other words stand here now", "r", 4), (None, "other words stand here now", "r", 5), (11, long, "r", 6), (12, long, "r", 7)]
    first = simhash.keep_first(spark.createDataFrame(twins, clash).withColumnRenamed("runs", "component_id").withColumnRenamed("n_words", "h"))
    assert first.columns == ["doc_id", "text", "component_id", "h"]
    assert sorted(str(r.doc_id) for r in first.collect()) == ["11", "7", "None"]
