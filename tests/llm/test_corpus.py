"""Each corpus operator against a plain version on a small fixture with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slipwright.llm import bpe, chat_format, decontaminate, licenses, media, pii, quality, simhash, token_store, toxicity
from slipwright.llm.chat_template import TemplateError, compile_template, fold_body, parse, render

TEXTS = [
    (0, "The Apache License, Version 2.0. Mail a.b@c.example.com or call +1 (555) 555-1234 today."),
    (1, None), (2, ""), (3, "   \n  "), (4, "one two three"), (5, "ONE two Three"), (5, "ONE two Three"), (6, "card 4111 1111 1111 1111, not 4111 1111 1111 1112; 10.0.0.1 and 10.0.0.256"),
    (7, "café été  naïve　Kelvin \x1c\x85 end"), (8, "word " * 3000), (9, "x" * 5000), (10, "CC BY-NC 4.0. MIT License! GNU General Public License"), (None, "null id here"), (11, "a b c d e f g h i j k l m n o p"),
]
BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    # names of the extra columns are ones that the operators use themselves
    return spark.createDataFrame([(d, t, "x", 1.0) for d, t in TEXTS], "doc_id long, text string, h string, score double")


def empty(docs):
    return docs.filter("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = token_store.token_store(docs, BPE, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in TEXTS), key=lambda d: -1 if d is None else d)
    at, left = 0, [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in TEXTS]
    for r in got:
        left.remove((r.doc_id, r.ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert token_store.token_store(empty(docs), BPE).count() == 0


def test_random_access_and_damage(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    manifest = token_store.write_store(docs, folder, BPE)
    every = {r.doc_id: tuple(r) for r in token_store.read_store(manifest).collect()}
    some = token_store.read_store(manifest, [4, 11, 99]).collect()
    assert {r.doc_id: tuple(r)[:4] for r in some} == {d: every[d][:4] for d in (4, 11)}
    path = manifest.first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[30] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_store.read_store(manifest).collect()


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "a: b\\</turn>", "####\\"), (None, 0, "user", "x\n### user: y</turn>\n")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    for part in (10, 1 << 20):
        got = {r.conv_id: r for r in chat_format.format_and_read(df, part_chars=part).collect()}
        for conv in {d[0] for d in data}:
            turns = [(r or "", t or "") for c, _, r, t in data if c == conv]
            loss = "".join(t for r, t in turns if r == "assistant")
            r = got[conv]
            assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_and_read(df.filter("false")).count() == 0


def test_template_language():
    source = "{% set a = 'x' + 'y' %}{% for m in ms %}{% if loop.first %}<{% elif m.k == 'q' and not m.z %}q{% else %},{% endif %}{% generation %}{{ m.t | up }}{% endgeneration %}{% endfor %}{{ a }}{# no #}"
    text, spans = render(compile_template(source, {"up": str.upper}), ms=iter([{"t": "ab", "k": ""}, {"t": "c", "k": "q"}]))
    assert (text, [text[a:b] for a, b in spans]) == ("<ABqCxy", ["AB", "C"])
    assert fold_body(parse("{% if 'a' == 'a' %}1{{ 'b' + 2 }}{% else %}3{% endif %}"), {}) == [("text", "1b2")]
    assert render(compile_template("{{ m.__class__ }}|{{ m.a.b }}"), m="text")[0] == "|"
    for bad in ("{% for x %}{% endfor %}", "{{ f(1) }}", "{% if a %}", "{{ 'a' | none_such }}", "{% import os %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii(spark, docs):
    rng = random.Random(3)
    parts = ["a@b.co", "@", ".", "1.2.3.4", "5.6", "256.1.1.1", " ", "_", "+1 23 45 67 89", "4111111111111111", "-", "9", "é", "(", ") ", "x@y.z.", "+"]
    noise = [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for k in range(150)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(noise, "doc_id long, text string"))
    got = pii.find(df).collect()
    expected = sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(t)).encode()).hexdigest() + str(d) for d, t in [*TEXTS, *noise])
    assert sorted(r.base_sha256 + str(r.doc_id) for r in got) == expected
    clean = {r.doc_id: r for r in pii.redact(docs.filter("doc_id in (0, 1, 4, 6)")).collect()}
    assert "<EMAIL>" in clean[0].text and "<PHONE>" in clean[0].text and clean[1].text is None and clean[4].text == "one two three"
    assert clean[6].text == "card <CARD>, not 4111 1111 1111 1112; <IP> and 10.0.0.256" and clean[6].h == "x"
    assert pii.find(empty(docs)).count() == 0


def test_pii_extra_spans(spark):
    texts = [(k, f'set token = "{hashlib.sha1(str(k).encode()).hexdigest()}" or call (415) 55{k % 10}-{1000 + k} but not +1 (415) 555-{1000 + k} now') for k in range(100)]
    words = [(100 + k, f"old_token password = {'internationalisation' * (1 + k % 2)}, code ({k % 100:03d}) 0{k % 90 + 10}-{1000 + k};") for k in range(100)]
    df = spark.createDataFrame(texts + words, "doc_id long, text string")
    table = pii.cells(df.select("doc_id", pii.candidates(F.col("text")).alias("_candidates")))
    seen = {}
    for values, _, n, y in table:
        seen[values[:2]] = [a + b for a, b in zip(seen.get(values[:2], [0, 0]), (n, y))]
    assert seen[pii.KINDS.index("phone"), 1] == [200, 100] and seen[pii.KINDS.index("secret"), 1] == [200, 100] and seen[pii.KINDS.index("phone"), 0] == [100, 100]
    found = {r.doc_id: r for r in pii.find(df).collect()}
    for k, text in texts:
        at = text.index("token"), text.index("(415)"), text.index("+1")
        assert found[k].spans == f"secret:{at[0]}:{at[0] + 49},phone:{at[1]}:{at[1] + 14},phone:{at[2]}:{at[2] + 17}" and found[k].n_phone == 1
    assert all(found[k].spans == "" for k, _ in words)
    assert {r.text for r in pii.redact(df).collect() if r.doc_id < 100} == {'set <SECRET>" or call <PHONE> but not <PHONE> now'}


def test_pii_held_out_forms(spark):
    """Planted local numbers, spelled-out addresses and secrets among decoys: precision and recall by kind."""
    rng = random.Random(8)
    said = {"phone": ["call", "tel.", "fax:", "or", "then"], "email": ["mail", "write to", "via", "also"], "secret": [""]}
    texts, wanted = [], {}
    for d in range(600):
        out, spans = "", []
        for kind in said:
            if rng.random() < 0.5:
                form = {"phone": f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}", "email": f"joe{d} (at) site{d % 7} (dot) org", "secret": f'token = "{hashlib.sha1(str(d).encode()).hexdigest()}'}[kind]
                out += f" words {rng.choice(said[kind])} "
                spans.append((kind, len(out), len(out) + len(form)))
                out += form + '",'
        if rng.random() < 0.5:
            out += f" {rng.choice(['order', 'part', 'isbn'])} {rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(0, 9999):04d},"
        texts.append((d, out))
        wanted[d] = {f"{k}:{a}:{b}" for k, a, b in spans}
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for kind in said:
        found = {(d, x) for d, xs in got.items() for x in xs if x.startswith(kind)}
        true = {(d, x) for d, xs in wanted.items() for x in xs if x.startswith(kind)}
        assert len(true) > 200 and len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found), kind


def test_pii_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, _candidates int, _spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert tuple(got[1]) == (1, "<EMAIL>", 5, "x") and tuple(got[None]) == (None, None, 6, "y")
    assert pii.redact(df.filter("false")).count() == 0


def test_pii_cells_count_all_candidates(spark):
    df = spark.createDataFrame([(k, f"card {'4' * (12 + k)}, ip 1.2.3.{k}") for k in range(8)], "doc_id long, text string")
    assert sum(row[2] for row in pii.cells(df.select("doc_id", pii.candidates(F.col("text")).alias("_candidates")))) == 16


def test_pii_secrets_among_unknown_decoys(spark):
    """Keys against phrases with numbers, which no word before them tells apart."""
    rng, texts, wanted = random.Random(12), [], {}
    for d in range(600):
        key = d % 2 == 0
        value = hashlib.sha1(str(d).encode()).hexdigest() if key else f"ask-the-{rng.choice(['front', 'night', 'help'])}-desk-since-{rng.randint(1000, 2030)}"
        texts.append((d, f'see password = "{value}" there'))
        wanted[d] = key
    got = {r.doc_id: "secret" in r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    right = sum(got[d] and wanted[d] for d in got)
    assert right >= 0.95 * sum(wanted.values()) and right >= 0.95 * sum(got.values())


def test_pii_many_spans_in_one_text(spark):
    """Places, context and redaction of a text with thousands of spans, beside plain search."""
    n = 3000
    text = " ".join(f"user{k}@mail.example and 555 {k} \u00fc\U0001f600" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    places = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert got[1].n_email == n and got[1].spans == ",".join(places) and got[2].spans == got[3].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == re.sub(r"user\d+@mail\.example", "<EMAIL>", text) and clean[2] is None


def test_licenses(spark, docs):
    got = rows(licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    expected = []
    for d, t in TEXTS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        found = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in found]
        expected.append((d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == sorted(expected, key=str)
    labels = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert labels[10].labels == "cc-by,cc-by-nc,gpl,mit" and labels[4].score == 0
    assert licenses.scan(empty(docs)).count() == 0


def plain_scores(words, rank):
    """Labels and the largest share by the method's rules, in plain loops."""
    out = []
    for label, key, text in licenses.TEMPLATES:
        own, key = text.split(), key.split()
        if not any(words[k : k + len(key)] == key for k in range(len(words))):
            out.append((label, 0.0))
            continue
        known = {w for w in own if w not in licenses.STOP}
        rare = sorted(known & set(words), key=lambda w: (-rank[w], w))[: licenses.TOP]
        votes = {(i - j, w) for i, w in enumerate(words) if w in rare for j, x in enumerate(own) if x == w}
        agreed = {}
        for d, w in votes:
            for band in (d // licenses.BAND, d // licenses.BAND - 1):
                agreed.setdefault(band, set()).add(w)
        out.append((label, min(1.0, max(map(len, agreed.values()), default=0) / min(licenses.TOP, len(known)))))
    return out


def test_licenses_side_by_side(spark):
    notice = {}
    for label, _, text in licenses.TEMPLATES:
        notice.setdefault(label, text)
    stray = "no restriction, deal, charge, person, source, binary, 2, 0, mozilla, copyright conditions, distributed, permitted, modification "
    cases = [("lgpl", "bsd"), ("mpl", "mit"), ("lgpl", "mpl"), ("bsd", "mit"), ("apache", "mit"), ("bsd", "lgpl", "mit", "mpl"), ("isc", "bsl"), ("zlib", "agpl", "unlicense")]
    texts = [(k, " filler words between ".join(notice[x] for x in case)) for k, case in enumerate(cases)]
    texts += [(10, stray * 3 + notice["lgpl"]), (11, "Permission is hereby granted, free of charge"), (12, "granted " * 40 + "permission is hereby granted free of charge " * 9), (13, notice["bsl"]), (14, None), (15, "the software is free " * 50)]
    rng = random.Random(6)
    pool = [w for x in notice.values() for w in x.split()] + ["other", "words"]
    for k in range(60):  # notices with words left out and put in
        words = [w for x in rng.sample(sorted(notice), 2) for w in notice[x].split() if rng.random() > 0.1 * (k % 4)]
        for _ in range(rng.randint(0, 12)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(pool))
        texts.append((100 + k, " ".join(words)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    labels = {d: set(r.labels.split(",")) - {""} for d, r in got.items()}
    assert all(set(case) <= labels[k] for k, case in enumerate(cases)) and labels[10] == {"lgpl"}
    assert labels[11] == labels[12] == set() and labels[13] == {"bsl"} and got[11].score < 0.3 and got[14].score == 0
    split = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for d, t in texts}
    rank = {w: np.log((1 + len(texts)) / (1 + sum(w in x for x in split.values()))) for w in licenses.INDEX_WORDS}
    for d, words in split.items():
        plain = plain_scores(words, rank)
        base = [label for phrase, label in licenses.PHRASES if any(words[k : k + len(phrase.split())] == phrase.split() for k in range(len(words)))]
        assert labels[d] == {label for label, score in plain if score >= licenses.LEAST} | set(base)
        assert abs(got[d].score - max([score for _, score in plain] + [float(bool(base))])) < 1e-9


def test_licenses_with_words_changed(spark):
    """Every notice keeps its label with one to three words put in, left out or replaced, and a third of it has none."""
    rng, texts, wanted = random.Random(9), [], {}
    for label, key, text in licenses.TEMPLATES:
        words, k = text.split(), len(key.split())
        if len(words) < 24:
            continue
        first = next(i for i in range(len(words)) if words[i : i + k] == key.split()) if key in text else 0
        free = [i for i in range(len(words)) if not first <= i < first + k]
        for n in (1, 2, 3):
            at = set(rng.sample(free, n))
            for how in ("in", "out", "other"):
                new = [x for i, w in enumerate(words) for x in ({"in": [f"x{i}", w], "out": [], "other": [f"x{i}"]}[how] if i in at else [w])]
                wanted[len(texts)] = label
                texts.append((len(texts), " ".join(new)))
        if len(words) > 60:
            wanted[len(texts)] = ""
            texts.append((len(texts), " ".join(words[-len(words) // 4 :])))
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    based = {label for _, label in licenses.PHRASES}
    assert [(d, x, got[d]) for d, x in wanted.items() if (x not in got[d] if x else got[d] - based)] == []


def test_media(spark, docs):
    for r in media.media_digests(docs).collect():
        raw = next(t for d, t in TEXTS if d == r.doc_id) or ""
        payload = raw.encode()
        size = max(192, -(-len(payload) // 192) * 192)
        payload += b" " * (size - len(payload))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    picture = np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(picture)), picture) and np.array_equal(media.decode(media.encode_ppm(picture)), picture)
    assert media.decode(b"P6\n9 9\n255\nxx") is None and media.decode(None) is None and media.decode(b"") is None
    grey = media.grey(picture)
    fine = np.kron(grey, np.ones((8, 9)))  # every target cell is a whole number of these
    assert np.allclose(media.resize(grey, 8, 9), fine.reshape(8, 7, 9, 5).mean((1, 3)))
    assert media.media_digests(empty(docs)).count() == 0


def test_quality(spark, docs):
    good = [(k, f"The quick brown fox number {k} jumps over a lazy dog. It runs home.", 1) for k in range(200)]
    bad = [(k, f"BUY!! NOW!! {k}!! $$$ ### " * 5, 0) for k in range(200, 400)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = quality.score(df.select("doc_id", "text").union(docs.select("doc_id", "text")), df.select("doc_id", "quality")).collect()
    assert len(got) == 400 + len(TEXTS)
    truth = {d: q for d, _, q in good + bad}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 20]
    assert held and all(r.predicted == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = quality.score(docs, df.select("doc_id", "quality").filter("false")).collect()
    assert {round(r.score, 3) for r in none} == {0.5}
    assert set(quality.keep_good(docs, df.select("doc_id", "quality")).columns) == set(docs.columns)


def test_bpe(spark, docs):
    rng = random.Random(5)
    parts = ["ab ", "  ", "\n", "x", "é", "12", "'s", "...", " \t", "the "]
    extra = [(200 + k, "".join(rng.choice(parts) for _ in range(600))) for k in range(20)] + [(300, " " * 3000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)[0]
    expected = []
    for d, t in [*TEXTS, *extra]:
        ids = encoding.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, chunk=150, zone=30)) == sorted(expected, key=str)
    assert bpe.round_trip(empty(docs), RANKS, public_tokenizers.PATTERN).count() == 0


def test_tiled_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 4), replace=False).astype(np.uint64)) for _ in range(200)], np.uint64)
    prints = np.unique(np.concatenate([base, base[rng.integers(0, 40, 200)] ^ flips]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3

    def components(pairs):
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(prints))]

    u, v = simhash.tiled_links(prints, tile=16)
    assert len(u) < len(prints) and components(zip(u, v)) == components(zip(*np.nonzero(near)))


def test_simhash(spark, docs):
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(4)
    texts = [(400 + k, " ".join(w if rng.random() > 0.004 else "z" for w in words)) for k in range(60)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    data = [*TEXTS, *texts]
    prints = [simhash.fingerprint(t or "") for _, t in data]
    for small in (4096, 8):
        got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df, tile_rows=small).collect()}
        root = list(range(len(data)))
        changed = True
        while changed:
            changed = False
            for i in range(len(data)):
                for j in range(len(data)):
                    if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] < root[j]:
                        root[j], changed = root[i], True
        for i, (d, _) in enumerate(data):
            ids = [data[j][0] for j in range(len(data)) if root[j] == root[i] and data[j][0] is not None]
            assert got[d, f"{prints[i]:016x}"] == (min(ids) if ids else None)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()).count("5") == 0
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_decontamination(spark, docs):
    items = [(1, "d e f g h i j k l m n o p q"), (2, "three"), (3, "!!"), (4, None), (10, "ONE, two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        words = word.findall(low(text))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    expected = []
    for d, t in TEXTS:
        words, hit, found = word.findall(low(t)), set(), set()
        for window, owners in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= owners
        expected.append((d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    for block in (1, 1 << 20):  # each item a block of its own, or all in one
        assert rows(decontaminate.decontaminate(docs, bench, block_bytes=block).drop("runs")) == sorted(expected, key=str)
    assert decontaminate.decontaminate(docs, bench.filter("false")).filter("contaminated").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[11] == "a b c " and cut[4] == ""


def test_toxicity(spark, docs):
    calm = [(k, f"such a calm{"abcdefgh"[k % 8]} person {k} women", 0) for k in range(150)]
    rude = [(k, f"such a vequ{'abcdefgh'[k % 8]}x person {k} women", 1) for k in range(150, 300)]
    df = spark.createDataFrame(calm + rude, "doc_id long, text string, toxic int")
    probe = [(1000, "some vequax thing"), (1001, "muslim women walk"), (1002, "jewish men walk")]
    every = df.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame(probe, "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.score(every, df.select("doc_id", "toxic")).collect()}
    assert all(got[d].predicted == y for d, _, y in calm + rude if d > 20)
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert abs(got[1001].score - got[1002].score) < 0.2
    none = toxicity.score(docs, df.select("doc_id", "toxic").filter("false")).collect()
    assert len(none) == len(TEXTS) and max(r.score for r in none) < 1e-3


def test_windows_that_repeat(spark):
    from slipwright.llm.decontaminate import Windows

    rng = random.Random(4)
    for _ in range(200):
        n, doc = rng.choice([2, 3, 4]), [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        items = [(f"x{k}", " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(1, 6))]
        hit, found = set(), set()
        for name, words in ((k, t.split()) for k, t in items if t):
            m = min(n, len(words))
            for i in range(len(words) - m + 1):
                for p in range(len(doc) - m + 1):
                    if doc[p : p + m] == words[i : i + m]:
                        hit |= set(range(p, p + m))
                        found.add(name)
        runs, names = Windows(items, n).scan([w.encode() for w in doc])
        assert {i for a, b in runs for i in range(a, b)} == hit and names == found
    many = ["same"] * 200_000
    assert Windows([("a", " ".join(many))]).scan([w.encode() for w in many]) == ([(0, 200_000)], {"a"})


def test_piece_table_is_bounded_by_bytes():
    import public_tokenizers

    encoder = bpe.PieceEncoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_bytes=20_000)
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(40)] + ["long" * 5000]
    plain = encoder.encoding
    assert encoder.encode(texts).to_pylist() == [plain.encode_ordinary(t) for t in texts] and encoder.weight <= 20_000
