"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Generators propose spans with high recall and overlaps: the base forms (email, ip, card, phone) whether they pass their
check or not, phone numbers without a country code, spelled-out addresses, and assigned secrets. Base forms that pass
their check are always redacted. For the others, boosted trees score what the candidate looks like (digits, separators,
neighbours, words before it); the trees are fitted to tell true candidates from others, over all candidates of the
corpus, which Spark first adds up by feature values (see ``cells`` for the size of that table). A base form is true if
it passes its check. A span of an extra generator is labelled by what stands around it where that tells (``_likely``):
true behind a word for its kind, false behind a word for another kind or for a number of something else (an order, a
part, a page); elsewhere by its format. It teaches nothing where a base span of its kind overlaps it. For each kind and
generator the threshold is the lowest one whose precision is surely ``precision`` or more, by trees that have not seen
the document (five folds of documents, each left out once); a generator without such a threshold adds nothing.

Defined cases: a null text is an empty one and has no spans; places are code points, ends exclusive; a span of the
method that a base span of its kind overlaps is dropped; repeated rows each have their own row; an empty table, or one
without candidates, adds nothing; columns other than doc_id and text are left out, or kept by ``redact`` whatever their
names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored

KINDS = ["email", "ip", "card", "phone", "secret"]
# Patterns of the kinds. Possessive repeats and the look-behind change no match; they keep the search
# linear in long runs: a match can only begin where such a run, or the search, begins.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "secret": r"(?i)\b(?:token|secret|password|api_?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{16,}+",
}
#: What a text needs for a pattern to be tried at all.
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
MORE_NEEDS = {"email": r"[(\[]at[)\]]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"(?i)(?:token|secret|password|key)\b[\"']?\s{0,3}[=:]"}
CONTEXT = r"(?i)(?:(phone|tel|call|fax|mobile)|(card|visa|credit|account)|(mail|contact|write)|(host|server|address)|(token|secret|password|key)|\b(order|invoice|part|serial|isbn|item|page|version|ref|nr|id))\b\W{0,3}(?:\w{0,8}\W{0,3}){0,2}$"
#: The group of CONTEXT that names each kind; the last group is a number of something else.
OWN_CONTEXT = {"phone": 1, "card": 2, "email": 3, "ip": 4, "secret": 5}
N_CONTEXTS = 6
CONTEXT_CHARS = 24
#: Characters of a block of a text.
BLOCK = 512
PRECISION = 0.95
FOLDS = 5

_SPAN = "array<struct<start:int,end:int,found:string>>"
FEATURES = ["kind", "more", "digits", "signs", "bracket", "letters", "left", "right", "context"]
_CANDIDATE = "array<struct<start:int,end:int,kind:int,base:boolean,truth:boolean,more:int,digits:int,signs:int,bracket:int,letters:int,left:int,right:int,context:int>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, found) of all matches, leftmost and non-overlapping: between two pieces of the split lies one
    match, so the running sum of both lengths gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap")))
    both = F.filter(both, lambda x: x["m"].isNotNull())
    placed = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.char_length(x["m"])).alias("end"), x["m"].alias("found"))
    lengths = lambda x: x["gap"] + F.char_length(x["m"])
    places = F.flatten(F.transform(F.array(both), lambda b: F.zip_with(b, _running(F.transform(b, lengths), lambda x, y: x + y), placed)))
    return F.coalesce(F.when(text.rlike(needs), places), F.array().cast(_SPAN))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: Column, combine) -> Column:
    """For each place of an array of whole numbers its combination over all places before (0 at first). ``combine`` is
    associative and 0 changes nothing. A fold copies its state at each step, so parts of 64 are folded apart, and their
    totals between them."""

    def fold(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("state"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(combine(acc["state"], v).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out")), lambda acc: acc["out"])

    def over(z: Column) -> Column:
        totals = F.transform(z, lambda part: F.aggregate(part, F.lit(0), combine))
        return F.flatten(F.zip_with(z, fold(totals, F.lit(0)), fold))

    def parted(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, F.lit(64)))
        return F.when(F.size(v) > 0, cut).otherwise(F.array().cast("array<array<int>>"))

    # an array that lambdas name is made once where it is an element of another
    return F.flatten(F.transform(F.transform(F.array(values), parted), over))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    """The check of a base form."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    digits = _digits(found)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _likely(kind: str, found: Column, context: Column) -> Column:
    """The weak label of a span of an extra generator, by the word before it or else by its format. A secret has its
    word within the span: what stands before it tells nothing more."""
    if kind == "secret":
        return _formed(kind, found)
    return F.when(context == OWN_CONTEXT[kind], True).when(context != 0, False).otherwise(_formed(kind, found))


def _formed(kind: str, found: Column) -> Column:
    """Does the format of a span agree with its kind?"""
    if kind == "email":  # a domain ends with letters
        return found.rlike(r"(?:\.|[)\]]) ?[A-Za-z]{2,}$")
    if kind == "phone":  # no area or exchange begins with 0 or 1
        return _digits(found).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    # random keys go from letters to digits and back, words and numbers in words don't; no feature says so
    value = F.regexp_extract(found, "[A-Za-z0-9_/+-]+$", 0)
    return F.size(F.regexp_extract_all(value, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), F.lit(0))) >= 3


def _side(c: Column) -> Column:
    """0 none, 1 space, 2 letter or digit, 3 quote or bracket, 4 other."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}\p{N}_]$"), 2).when(c.rlike(r"^[\"'()\[\]]$"), 3).otherwise(4)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text that is given in blocks: a substring of the whole text would
    walk over all that comes before it."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, first), F.lit("")), F.when(last > first, F.coalesce(F.get(blocks, last), F.lit(""))).otherwise(F.lit("")))
    part = F.when(last > first + 1, F.array_join(F.slice(blocks, first + 1, last - first + 1), "")).otherwise(two)
    return F.substring(part, start - first * BLOCK + 1, end - start)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _described(blocks: Column, kind: int, spans: Column, base: bool) -> Column:
    """Candidates: spans of a base form or an extra generator, with their features and labels; base: it is of a base
    form that passes."""
    low = lambda s: F.greatest(F.lit(0), s["start"] - CONTEXT_CHARS)
    sided = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), _cut(blocks, low(s), s["start"]).alias("before"), _cut(blocks, s["end"], s["end"] + 1).alias("after")))

    def named(s: Column) -> Column:
        context = F.lit(0)
        for k in range(N_CONTEXTS, 0, -1):
            context = F.when(F.regexp_extract(s["before"], CONTEXT, k) != "", k).otherwise(context)
        context = F.when(s["before"].rlike(CONTEXT), context).otherwise(F.lit(0))
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "found", "before", "after")], context.alias("context"))

    def describe(s: Column) -> Column:
        found, context = s["found"], s["context"]
        signs = F.length(F.regexp_replace(found, r"[^ ().@-]", ""))
        truth = _passes(KINDS[kind], found) if base else _likely(KINDS[kind], found, context)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), (truth if base else F.lit(False)).alias("base"), truth.alias("truth"), F.lit(int(not base)).alias("more"),
            F.least(F.length(_digits(found)), F.lit(20)).alias("digits"), F.least(signs, F.lit(7)).alias("signs"), found.contains("(").cast("int").alias("bracket"), found.rlike("[A-Za-z]").cast("int").alias("letters"),
            _side(F.right(s["before"], F.lit(1))).alias("left"), _side(s["after"]).alias("right"), context.alias("context"),
        )

    return F.transform(F.transform(sided, named), describe).cast(_CANDIDATE)


def candidates(text: Column) -> Column:
    """All proposed spans of a text with their features, base forms that pass marked. Its cost is linear in the text and
    its spans: a text is cut into blocks once, and what stands around a span is taken from its blocks."""
    sources = [(k, BASE[kind], NEEDS[kind], True) for k, kind in enumerate(KINDS) if kind in BASE] + [(k, MORE[kind], MORE_NEEDS[kind], False) for k, kind in enumerate(KINDS) if kind in MORE]
    spans = F.struct(*[_matches(text, pattern, needs).alias(f"s{i}") for i, (_, pattern, needs, _) in enumerate(sources)])

    def with_blocks(z: Column) -> Column:
        some = sum((F.size(z[f"s{i}"]) for i in range(len(sources))), F.lit(0)) > 0
        return F.struct(z.alias("z"), F.when(some, _blocks(text)).otherwise(F.array().cast("array<string>")).alias("blocks"))

    bound = F.transform(F.array(spans), with_blocks)
    parts = lambda y: F.concat(*[_described(y["blocks"], k, y["z"][f"s{i}"], base) for i, (k, _, _, base) in enumerate(sources)])
    return F.flatten(F.transform(bound, parts))


# -- boosted trees over the cells of the feature table --------------------------------------------------------------


def _uncovered(found: Column) -> Column:
    """Candidates without those that aren't base spans and that a base span of their kind overlaps.

    Base spans of a kind are apart, so of those that begin before a span ends the one that ends last decides: base spans
    by their starts and other spans by their ends, in order, with the largest end of a base span so far."""

    def event(c: Column) -> Column:
        return F.struct(F.when(c["base"], c["start"]).otherwise(c["end"]).alias("at"), c["base"].cast("int").alias("is"), c.alias("c"))

    def clear(events: Column, kind: int) -> Column:
        own = F.filter(events, lambda e: e["c"]["kind"] == kind)
        ends = F.transform(own, lambda e: F.when(e["c"]["base"], e["c"]["end"]).otherwise(F.lit(0)))
        kept = F.zip_with(own, _running(ends, _larger), lambda e, last: F.when(e["c"]["base"] | (last <= e["c"]["start"]), e["c"]))
        return F.filter(kept, lambda c: c.isNotNull())

    def walked(f: Column) -> Column:
        mixed = F.exists(f, lambda c: c["base"]) & F.exists(f, lambda c: ~c["base"])
        events = F.array_sort(F.transform(f, event))
        return F.when(mixed, F.flatten(F.transform(F.array(events), lambda e: F.concat(*[clear(e, k) for k in range(len(KINDS))])))).otherwise(f)

    return F.flatten(F.transform(F.array(found), walked))


def cells(found: DataFrame, column: str = "_candidates") -> list[tuple[tuple[int, ...], int, int, int]]:
    """(feature values, fold, candidates, true ones) over all uncovered candidates of ``found`` (doc_id, candidates).

    Card runs of fewer than 12 digits and other things no check could pass teach nothing and are left out. The table
    is bounded without a limit: digits, signs, bracket and letters take at most 336 values together for an email, 72
    for a card, 17 for an ip, 336 for a phone, 336, 16 and 168 for the extra emails, phones and secrets, and there are
    875 combinations of both sides, context and fold: 1,120,875 rows in all.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(1)).cast("int")
    rows = found.select(fold.alias("fold"), F.explode(_uncovered(F.col(column))).alias("c")).filter(~((F.col("c.kind") == 2) & (F.col("c.digits") < 12)))
    table = rows.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], "fold").agg(F.count("*").alias("n"), F.sum(F.col("c.truth").cast("long")).alias("y"))
    return sorted((tuple(r[f] for f in FEATURES), r["fold"], r["n"], r["y"]) for r in table.collect())


Tree = tuple  # (leaf value,) or (feature, threshold, tree of values up to it, tree of larger ones)


def _sums(part: list[tuple]) -> tuple[float, float]:
    g = sum(y - n * p for _, n, y, p in part)
    return g, sum(n * p * (1 - p) for _, n, _, p in part)


def _grow(part: list[tuple], depth: int, ridge: float) -> Tree:
    g, h = _sums(part)
    best = (1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            by_value: dict[int, list[float]] = {}
            for values, n, y, p in part:
                cell = by_value.setdefault(values[f], [0.0, 0.0])
                cell[0] += y - n * p
                cell[1] += n * p * (1 - p)
            left_g = left_h = 0.0
            for value in sorted(by_value)[:-1]:
                left_g += by_value[value][0]
                left_h += by_value[value][1]
                gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                if gain > best[0]:
                    best = (gain, (f, value))
    if best[1] is None:
        return (g / (h + ridge),)
    f, value = best[1]
    return f, value, _grow([x for x in part if x[0][f] <= value], depth - 1, ridge), _grow([x for x in part if x[0][f] > value], depth - 1, ridge)


def _at(tree: Tree, values: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def boost(table: list[tuple], trees: int = 20, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> list[Tree]:
    """Newton boosting of the logistic loss over weighted cells; the leaves hold margins."""
    added: dict[tuple[int, ...], list[int]] = {}
    for values, _, n, y in table:
        cell = added.setdefault(values, [0, 0])
        cell[0], cell[1] = cell[0] + n, cell[1] + y
    rows = [(values, n, y) for values, (n, y) in added.items()]
    margins, out = [0.0] * len(rows), []
    for _ in range(trees if rows else 0):
        tree = _scaled(_grow([(v, n, y, 1 / (1 + math.exp(-m))) for (v, n, y), m in zip(rows, margins)], depth, ridge), rate)
        margins = [m + _at(tree, v) for (v, _, _), m in zip(rows, margins)]
        out.append(tree)
    return out


def _scaled(tree: Tree, rate: float) -> Tree:
    return (tree[0] * rate,) if len(tree) == 1 else (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def calibrate(table: list[tuple], precision: float = PRECISION) -> dict[tuple[int, int], float]:
    """For each kind and generator the lowest margin at which its candidates are true at the wanted precision, each
    scored by trees of the other folds; any margin will do if all of them together are that precise."""
    scored: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for fold in sorted({row[1] for row in table}):
        trees = boost([row for row in table if row[1] != fold])
        for values, own, n, y in table:
            if own == fold:
                scored.setdefault(values[:2], []).append((sum(_at(t, values) for t in trees), n, y))
    out = {}
    for source, found in scored.items():
        found.sort(reverse=True)
        total = passing = 0
        for k, (margin, n, y) in enumerate(found):
            total, passing = total + n, passing + y
            last = k + 1 == len(found)
            if _surely(passing, total) >= precision and (last or found[k + 1][0] < margin):
                out[source] = -math.inf if last else margin
    return out


def _surely(passing: int, total: int, z: float = 1.64) -> float:
    """Lower end of the Wilson interval of a share: few candidates prove little."""
    share = passing / total
    return (share + z * z / (2 * total) - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def _margin(c: Column, trees: list[Tree]) -> Column:
    def value(tree: Tree) -> Column:
        return F.lit(float(tree[0])) if len(tree) == 1 else F.when(c[FEATURES[tree[0]]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + value(tree)
    return total


def selected(trees: list[Tree], thresholds: dict[tuple[int, int], float], column: str = "_candidates") -> Column:
    """Of the candidates: base spans, and spans of the method that no base span of their kind overlaps."""
    base = F.filter(column, lambda c: c["base"])

    def wanted(c: Column) -> Column:
        enough = F.lit(False)
        margin = _margin(c, trees)
        for (kind, more), threshold in thresholds.items():
            enough = enough | ((c["kind"] == kind) & (c["more"] == more) & (margin >= threshold - 1e-9))
        short = (c["kind"] == 2) & (c["digits"] < 12)
        return ~c["base"] & ~short & enough

    return F.concat(base, F.filter(_uncovered(F.col(column)), wanted))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = stored(docs.select("doc_id", candidates(text).alias("_candidates")), "candidates")
    table = cells(found)
    trees = boost(table)
    base = F.filter("_candidates", lambda c: c["base"])

    def number(kind: int) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(kind) for kind in range(len(BASE))]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(selected(trees, calibrate(table, precision))).alias("spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs``, all columns, with each span (overlapping ones together) replaced by <KIND> of the first; n_chars follows."""
    found, places = free_names(docs, "candidates", "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # kept beside the text, so that the patterns are tried once and no join is needed
    marked = stored(docs.withColumn(found, candidates(text)), "candidates")
    table = cells(marked.select("doc_id", found), found)
    trees = boost(table)
    spans = F.array_sort(F.transform(selected(trees, calibrate(table, precision), found), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # a span that begins before the end of one before it goes with that one
    before = lambda spans: F.zip_with(spans, _running(F.transform(spans, lambda s: s["end"]), _larger), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))

    def replaced(z: Column) -> Column:
        heads = F.filter(before(z["spans"]), lambda h: h["start"] >= h["at"])
        parts = F.transform(heads, lambda h: F.concat(_cut(z["blocks"], h["at"], h["start"]), tags[h["kind"]]))
        return F.concat(F.array_join(parts, ""), _cut(z["blocks"], F.array_max(F.transform(z["spans"], lambda s: s["end"])), F.char_length(text)))

    marked = marked.withColumn(places, spans)
    bound = F.array(F.struct(F.col(places).alias("spans"), _blocks(text).alias("blocks")))
    clean = F.when(F.size(places) > 0, F.transform(bound, replaced)[0]).otherwise(F.col("text"))
    out = marked.withColumn("text", clean).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
