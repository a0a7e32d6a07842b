"""The pipeline against a plain version over the same rows, and both classifiers on the given tables' held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from slipwright.llm import bpe, quality, simhash, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def walk(model, row):
    """The score of one row, tree by tree and node by node."""
    margin = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        k = 0
        for _ in range(model.depth):
            k = 2 * k + 1 + int(row[feature[k]] > threshold[k])
        margin += leaf[k - (2**model.depth - 1)]
    return 1 / (1 + np.exp(-margin))


def plain(docs, labels, bench):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by loops over all rows, stage after stage."""
    label = {d: q for d, q in labels if not held_out(d)}
    sample = sorted((quality.statistics(t or ""), label[d]) for d, t in docs if d in label)
    rows = np.array([r for r, _ in sample]), np.array([q for _, q in sample], float)
    order = np.lexsort([*rows[0].T, rows[1]])
    model = quality.fit(rows[0][order], rows[1][order])
    docs = [(d, t) for d, t in docs if walk(model, quality.statistics(t or "")) >= quality.THRESHOLD]

    prints = [simhash.fingerprint(t or "") for _, t in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if root[j] < root[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j]
    first = {}
    for k, (d, _) in enumerate(docs):
        first[root[k]] = min(first.get(root[k], d), d)
    docs = [(d, t) for k, (d, t) in enumerate(docs) if first[root[k]] == d]

    windows = set()
    for _, text in bench:
        words = WORD.findall(low(text))
        n = min(13, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1 if n else 0)}
    kept = []
    for d, t in docs:
        words, hit = WORD.findall(low(t)), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append((d, t))

    encoding, out = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)[0], []
    for d, t in kept:
        t = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", t or "")
        t = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "<PHONE>", t)
        ids = encoding.encode_ordinary(t)
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_plain_version(spark, tmp_path):
    rng = random.Random(12)
    words = ["river", "stone", "light", "green", "house", "winter", "garden", "moves", "slowly", "under", "the", "a", "old", "bridge", "and", "sings"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    item = " ".join(f"q{k}" for k in range(20))
    docs = [(k, prose(rng.randint(30, 120))) for k in range(120)]
    docs += [(200 + k, "BUY!! NOW!! $$$ ### " * rng.randint(3, 9)) for k in range(60)]
    docs += [(300 + k, docs[k][1]) for k in range(20)] + [(330 + k, docs[k][1].replace("river", "rivers", 1)) for k in range(20)]
    docs += [(400 + k, f"{prose(40)} {item} {prose(20)}") for k in range(10)] + [(420 + k, f"{prose(400)} {item} {prose(100)}") for k in range(5)]
    docs += [(450 + k, f"{prose(40)} joe{k}@mail.example.org or +1 (555) 555-{1000 + k} {prose(9)}") for k in range(15)]
    docs += [(500, None), (501, ""), (502, "  \n")]
    labels = [(d, int(not (t or "").startswith("BUY"))) for d, t in docs if d < 290]
    bench = [(1, item), (2, "!!"), (3, None)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    expected = plain(docs, labels, bench)
    assert got == expected and 100 < len(got) < 200


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_of_the_tables(spark, operator, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    got = operator.score(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= operator.THRESHOLD) for r in got)
    pairs = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y, _ in pairs if y == 1], [s for s, y, _ in pairs if y == 0]
    assert good and bad and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([p == y for _, y, p in pairs]) > 0.9


def test_missing_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for operator in (quality, toxicity):
        assert operator.score(docs.filter("false"), labels).count() == 0
        assert operator.score(docs, labels).count() == 2
        assert {r.score for r in operator.score(docs, labels.filter("false")).collect()}
    assert quality.keep_good(docs.filter("false"), labels).count() == 0


def test_swaps_stay_small():
    text = " ".join(t for line in toxicity.IDENTITY_TERMS for t in line) + "."
    plain_model = toxicity.Model([f"={t}".encode() for line in toxicity.IDENTITY_TERMS for t in line], np.zeros(90), 0.0)
    gram = {}
    toxicity.add_changes(gram, (c for _ in range(50) for c in toxicity.changes(plain_model, text)))
    dense = np.zeros((90, 90))
    for less, more in toxicity.changes(plain_model, text):
        row = np.zeros(90)
        row[less] -= 1
        row[more] += 1
        dense += np.outer(row, row)
    assert np.allclose([[gram.get((i, j), 0) for j in range(90)] for i in range(90)], 50 * dense)
