"""Document fingerprints by a homomorphic multiset hash (DataFrame functions only).

A text is a multiset of paragraphs (lines, trimmed; blank ones do not count).  A fingerprint has two parts:

* equality: each paragraph is hashed whole to ``PARAGRAPH_LANES`` = 8 lanes of 32 bits (four 64-bit hashes), summed
  modulo 2**32.  'A. B.' over 'C.' and 'A.' over 'B. C.' differ, paragraphs in another order do not.
* likeness: each sentence of a paragraph is hashed to ``LANES`` = 80 lanes holding 0 or 1 (bits of two 64-bit
  hashes), summed modulo 2**30.  Two lanes share a BIGINT word: 40 words.  No text Spark can hold has 2**30 sentences.

Both parts are sums over paragraphs: a paragraph is inserted by adding its vector and deleted by subtracting it
(``combine``), and equal multisets of paragraphs have equal fingerprints.

``likeness``: sentence lanes centred to +-1 are random signs, so the inner product of two fingerprints
estimates the number of common sentences; it is divided by the larger sentence count and clipped to
0..1; equal fingerprints give exactly 1, one empty text against a non-empty one 0.

Sentences are exploded (the first of a paragraph carries the paragraph) and summed by a plain ``groupBy`` (generated code).  In the contract's query
the texts are shuffled once, by ranges of doc_id; the sums and the neighbours' vectors are
found inside that partitioning.

Null text: empty.  Empty tables give empty results.  Extra columns are ignored.  Repeated rows
keep a fingerprint each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmf.llm.common import table, text_bytes

BITS = 30
WORDS_PER_HASH = 20
LANES = 2 * WORDS_PER_HASH * 2
MASK = (1 << 60) - 1
LANE = (1 << BITS) - 1
ONES = 1 | (1 << BITS)
SENTENCES = r"(?<=[.!?]) "
FIELDS = [(h, k, f"v{h}_{k}") for h in (0, 1) for k in range(WORDS_PER_HASH)]
PARAGRAPH_LANES = 8
WHOLE = [f"p{k}" for k in range(PARAGRAPH_LANES)]
WIDE = (1 << 32) - 1


def pieces(text: Column) -> Column:
    """(sentence, paragraph) of all trimmed, non-blank sentences; ``paragraph`` only beside its first sentence."""
    def solid(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

    return F.flatten(F.transform(solid(F.split(text, "\n")), lambda p: F.transform(
        solid(F.split(p, SENTENCES)), lambda s, i: F.struct(s.alias("sentence"), F.when(i == 0, p).alias("paragraph")))))


def summed(parts: DataFrame, keys: list[str], piece: str = "piece") -> DataFrame:
    """``keys`` and the summed vector ``vec`` of rows with one of ``pieces`` (or null) each."""
    sentence, whole = F.col(piece)["sentence"], F.col(piece)["paragraph"]
    h = parts.select(*keys, sentence.isNotNull().alias("one"), whole.isNotNull().alias("starts"),
                     F.xxhash64(sentence).alias("h0"), F.xxhash64(sentence, F.lit("second")).alias("h1"),
                     *[F.xxhash64(F.lit(k), whole).alias(f"w{k}") for k in range(PARAGRAPH_LANES // 2)])
    bit = {f: F.when(F.col("one"), F.shiftrightunsigned(F.col(f"h{i}"), k).bitwiseAND(F.lit(ONES))).otherwise(0)
           for i, k, f in FIELDS}
    # a lane of 32 bits in a BIGINT sum: 2**31 paragraphs do not run over
    wide = {f: F.when(F.col("starts"), F.shiftrightunsigned(F.col(f"w{k // 2}"), 32 * (k % 2)).bitwiseAND(F.lit(WIDE))).otherwise(0)
            for k, f in enumerate(WHOLE)}
    g = h.groupBy(*keys).agg(F.count_if("one").alias("n"), F.count_if("starts").alias("paragraphs"),
                             *[F.sum(c).alias(f) for f, c in {**bit, **wide}.items()])
    return g.select(*keys, F.struct("n", "paragraphs", *[F.col(f).bitwiseAND(F.lit(MASK)).alias(f) for *_, f in FIELDS],
                                    *[F.col(f).bitwiseAND(F.lit(WIDE)).alias(f) for f in WHOLE]).alias("vec"))


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """Vector of a text with another's paragraphs inserted (or deleted), from the vectors alone.

    Lane-wise modulo 2**30 and 2**32: a subtraction borrows from no neighbour.
    """
    def both(f):
        return a[f] - b[f] if remove else a[f] + b[f]

    def word(f):
        lanes_of = [(F.shiftrightunsigned(a[f], BITS * i).bitwiseAND(F.lit(LANE)),
                     F.shiftrightunsigned(b[f], BITS * i).bitwiseAND(F.lit(LANE))) for i in (0, 1)]
        lo, hi = [(x - y if remove else x + y).bitwiseAND(F.lit(LANE)) for x, y in lanes_of]
        return (lo + F.shiftleft(hi, BITS)).alias(f)

    return F.struct(both("n").alias("n"), both("paragraphs").alias("paragraphs"), *[word(f) for *_, f in FIELDS],
                    *[both(f).bitwiseAND(F.lit(WIDE)).alias(f) for f in WHOLE])


def fingerprint(vec: Column) -> Column:
    """The vector as text: paragraph count, 8 hex digits a paragraph lane, sentence count, 15 hex digits a sentence word."""
    return F.concat_ws("", F.lower(F.hex(vec["paragraphs"])), F.lit("-"), *[F.lpad(F.lower(F.hex(vec[f])), 8, "0") for f in WHOLE],
                       F.lit("-"), F.lower(F.hex(vec["n"])), F.lit("-"),
                       *[F.lpad(F.lower(F.hex(vec[f])), 15, "0") for *_, f in FIELDS])


def lanes(vec: Column) -> Column:
    """Struct of ``n`` and ``c``, the lanes centred to 2 * lane - n."""
    words = F.array(*[vec[f] for *_, f in FIELDS])
    each = F.flatten(F.transform(words, lambda w: F.array(*[
        F.shiftrightunsigned(w, BITS * i).bitwiseAND(F.lit(LANE)) for i in (0, 1)])))
    return F.struct(vec["n"].alias("n"), F.transform(each, lambda x: (x * 2 - vec["n"]).cast("double")).alias("c"))


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """0..1 from two ``lanes`` structs and their fingerprints."""
    dot = F.aggregate(F.zip_with(a["c"], b["c"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    most = F.greatest(a["n"], b["n"]).cast("double")
    est = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.lit(float(LANES)) / most))
    return F.when(fa == fb, F.lit(1.0)).when(F.least(a["n"], b["n"]) == 0, F.lit(0.0)).otherwise(est)


def document_fingerprints(docs: DataFrame, keys: list[str] = ["doc_id"], text_col: str = "text") -> DataFrame:
    """``keys``, ``vec`` and ``fingerprint`` for each distinct key (rows that share a key are one document)."""
    parts = docs.select(*keys, F.explode_outer(pieces(F.coalesce(F.col(text_col), F.lit("")))).alias("piece"))
    return summed(parts, keys).withColumn("fingerprint", fingerprint(F.col("vec")))


def with_next(docs: DataFrame, bytes_per_bucket: int = 4 << 20, most: int = 4096) -> DataFrame:
    """(b, rn, guest, doc_id, text, next_text): ``next_text`` is the next document's text in descending doc_id
    (after the last: the first), (b, rn) numbers the rows, guest rows (below) repeat a document for its neighbour.

    Documents are dealt into id ranges of about equal size.  The top document of each range also goes, as a
    guest, to the range above it (the very first to the last range), so each range sees its successors
    and texts are shuffled once.  Range bounds are approximate quantiles, at most ``most`` of them; equal ids
    fall in one range, ordered by text.  A null doc_id comes after all others.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = d.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = max(1, min(most, text_bytes(d) // bytes_per_bucket))
    bounds = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20000)).first()[0]
    bounds = sorted(set(bounds or [])) if n > 1 else []
    low = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ids = ids.withColumn("bucket", F.size(F.filter(low, lambda b: b < F.col("key"))))
    tops = {r[0]: r[1] for r in ids.groupBy("bucket").agg(F.max("key")).collect()}  # at most `most` rows
    order = sorted(tops)
    # guest of range i: the top of the non-empty range below it; of the lowest: the top of the highest
    host = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    where = F.create_map(*[F.lit(x) for kv in host.items() for x in kv]) if host else None
    ids = ids.withColumn("host", F.lit(None).cast("int") if where is None else
                         F.when(F.col("key").isin(list(host)), where[F.col("key")]))
    # of equal top ids the guest is the one that comes first, and all are sent: order decides
    both = F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")),
                           F.struct(F.col("host").alias("b"), F.lit(1).alias("guest"))))
    dealt = ids.select("doc_id", "key", "text", F.explode(both).alias("x")).select("doc_id", "key", "text", "x.*")
    w = Window.partitionBy("b").orderBy("guest", F.desc("key"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w)) \
        .select("b", "rn", "guest", "doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of each text and of its edited text, and their likenesses.

    Everything after ``with_next`` keeps its partitioning by range ``b``: one row per piece of the text
    (kind 0) and of the edited text (kind 1), summed per (b, rn, kind); the next document's
    vector is then two rows further on.
    """
    d = (with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
         .withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
         .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"),
                                        F.expr("substring(coalesce(next_text, ''), 1, half)"))))
    keys = ["b", "rn", "guest", "doc_id", "n_chars", "sha", "kind"]
    both = d.select("b", "rn", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"),
                    F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                                      F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    parts = both.select(*keys[:-1], "x.kind", F.explode_outer(pieces(F.col("x.t"))).alias("piece"))
    v = summed(parts, keys)
    w = Window.partitionBy("b").orderBy("rn", "kind")
    v = (v.withColumn("ve", F.lead("vec", 1).over(w)).withColumn("vn", F.lead("vec", 2).over(w))
         .where("kind = 0 AND guest = 0"))
    f = v.select("doc_id", "n_chars", "sha", *[x for c, o in (("vec", "a"), ("ve", "e"), ("vn", "n"))
                                               for x in (fingerprint(F.col(c)).alias(f"f{o}"), lanes(F.col(c)).alias(f"l{o}"))])
    return f.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("fa").alias("fingerprint"),
                    F.col("fe").alias("edited_fingerprint"),
                    likeness(F.col("la"), F.col("le"), F.col("fa"), F.col("fe")).alias("near_edited"),
                    likeness(F.col("la"), F.col("ln"), F.col("fa"), F.col("fn")).alias("near_next"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
