"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each source has a budget of words. A document's place in its source is its exponential key, -ln(u) / w: u is a hash of
the document between 0 and 1, w its quality weight, so that documents of weight w stand first with a probability in
proportion to w. Documents in the order of their keys are summed up, and the budget takes them from the front. A budget
beyond the whole source takes the source completely (an epoch) as often as it fits in, and then the front of it. The
document at the edge of a budget is taken in part: its first words fill the budget up, so that a source's taken words
are its target, rounded.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, 2, 1, ...; together they share ``share`` of all words. A
target stops at ``max_epochs`` times its source's words, and what is beyond is shared by weight among the others, until
none is above. This ends at the level l with sum(min(cap, l * weight)) = budget, which is found from the sources in the
order of cap / weight.

No task holds a source: sums before a document are taken over ranges of (source, key) (see ``prefix``). Texts are read
once and aren't shuffled, except by ``mixture``, which returns them.

Defined cases: null and empty texts have no words and are never taken, whatever their weight; a null source is a source
of its own; equal rows are taken one after the other, and which of them is the one at the edge can't be told; an
empty table, or one without words, gives targets of 0; other columns are left out, or kept by ``mixture`` whatever
their names are. The same table gives the same mix: keys are hashes, sums of words are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored
from .prefix import sums_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Between words stand spaces and \t to \r.
GAPS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), GAPS), lambda w: w != "")


def quality_weight(text: Column, words: Column) -> Column:
    """Between 0.05 and 1: the share of letters (or any signs beyond ASCII) among the characters that aren't blank,
    times the number of different words over that of all words, or over 100 if there are more (at most 1)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    dense = F.length(F.regexp_replace(text, GAPS, ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    distinct = F.least(F.size(F.array_distinct(words)) / F.greatest(F.least(F.size(words), F.lit(100)), F.lit(1)), F.lit(1.0))
    return F.greatest(F.when(F.size(words) > 0, letters / F.greatest(dense, F.lit(1)) * distinct).otherwise(F.lit(0.0)), F.lit(0.05))


def digest_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Hexadecimal digest of a document: its id, or "-", and its text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def exponential_key(digest: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the first 52 bits of the digest, above 0 and below 1."""
    return -F.ln((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from a stored table (source, size): one row a source."""
    last = F.col("source").isNull().cast("int").alias("last")
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", last, "source_size", F.lit(1).cast("long").alias("one")), "sources")
    ranked = sums_before(sources, [], ["last", "source"], ["one", "source_size"], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("total_source_size") * F.lit(share)).alias("budget"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = stored(ranked.select("*", cap.alias("cap"), (cap / F.col("weight")).alias("level")), "sources")
    filled = sums_before(ranked, [], ["level", "source"], ["cap", "weight"], "sources")
    # all before it at their caps, the rest shared from it on: does it reach its own cap?
    shared = (F.col("budget") - F.col("before_cap")) / (F.col("total_weight") - F.col("before_weight"))
    filled = stored(filled.select("source", "source_size", "weight", "cap", "budget", "total_weight", (shared * F.col("weight") >= F.col("cap")).alias("full")), "sources")
    done = filled.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("caps"), F.sum(F.when(F.col("full"), F.col("weight"))).alias("weights")).first()
    caps, taken = done["caps"] or 0.0, done["weights"] or 0.0
    rest = (F.col("budget") - F.lit(caps)) / (F.col("total_weight") - F.lit(taken)) * F.col("weight")
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(rest).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row per document: doc_id, size, source, source_size, target (both its source's), taken (words the mix takes,
    repeats counted), digest (of id and text)."""
    words = words_of(F.col("text"))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = bare.select("doc_id", "source", "text", words.alias("words"), digest_of(F.col("doc_id"), F.col("text"), seed).alias("digest"))
    rows = rows.select("doc_id", "source", F.size("words").cast("long").alias("size"), "digest", quality_weight(F.col("text"), F.col("words")).alias("weight"))
    rows = stored(rows.select("doc_id", "source", "size", "digest", exponential_key(F.col("digest"), F.col("weight")).alias("key")), "sizes")
    goals = targets(rows.select("source", "size"), weights, share, max_epochs).withColumnRenamed("source", "own_source")
    placed = sums_before(rows, ["source"], ["key", "doc_id", "digest"], ["size"], "keys")
    joined = placed.join(goals, placed["source"].eqNullSafe(goals["own_source"]))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    edge = F.greatest(F.least(budget - F.col("epochs") * F.col("source_size") - F.col("before_size"), F.col("size")), F.lit(0).cast("long"))
    return joined.withColumn("epochs", epochs).select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + edge).alias("taken"), "digest")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs``, all columns, a row for each time a document is taken. A document taken in part has its
    first words, joined by spaces. Equal documents are one document taken oftener."""
    own, size, taken, turn = free_names(docs, "digest", "size", "taken", "turn")
    key = F.concat(digest_of(F.col("doc_id").cast("long"), F.col("text"), seed), F.lit("|"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull().cast("string"))
    own_key = F.concat("digest", F.lit("|"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"))
    chosen = plan(docs, weights, share, max_epochs, seed).filter("taken > 0").groupBy(own_key.alias(own)).agg(F.max("size").alias(size), F.sum("taken").alias(taken))
    rows = docs.withColumn(own, key).dropDuplicates([own]).join(chosen, own)
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = (F.col(taken) - (F.col(turn) - 1) * F.col(size)).cast("int")
    whole = F.when(left >= F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words_of(F.col("text")), F.lit(1), left), " "))
    return rows.withColumn("text", whole).select(*docs.columns)
