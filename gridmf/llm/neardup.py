"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles (64-bit hashes; with fewer words the whole
sequence as one).  Sketch: register j is an exponentially spaced, truncated minimum,
K_j = clip(floor(1 - log_b(A * e_j)), 0, Q + 1), e_j the least of the set's exponential variates under the
j-th hash; the union's sketch is the element-wise maximum.  ``ROWS`` consecutive registers make a band,
and documents that agree in a band meet in its bucket: at similarity 0.75 a pair shares none of the 64 bands
with odds of 4 in a million.  Candidates are first judged by the joint likelihood of their registers (counts of greater,
smaller, equal; set sizes known): a pair goes only if 0.75 is less likely than the best similarity by a
log-likelihood of ``SURE``.  What stays is confirmed on the full sets: 100 |A & B| >= 75 |A u B|.

Equal sets are one class from the start, so copies are never expanded.  Buckets are not expanded into all
pairs either: in one bucket of ``FIRST`` (by its key) every member meets the least one, and confirmed links join components.
Then, of all buckets, those whose members are in different components are open, and their members meet a hash-picked
one of another component, ``STAR_ROUNDS`` times.  What is still open after that is compared in full: open nodes that share buckets are a cluster, so that a pair meets once and not in every bucket they share.
A cluster is dealt by hash into parts of bounded bytes, a part for about every ``PART_NODES`` square roots of its nodes, and each two
parts meet in one group, whose rows are the parts' nodes with sketch and full set: rows follow the clusters' sizes,
not their pairs.  Inside a group numpy compares set sizes and one bit of 256 registers (at similarity 0.75 fewer than ``LEAST_BITS``
agree with odds of 1 in 100,000), then the joint likelihood, then the full sets, of pairs whose
components no link of the group has joined yet, and one link for two components comes out.  Links within
a component change nothing, so the components are exactly those of all links between bucket mates.

Nothing is gathered on the driver or in one task: buckets, classes and components are aggregates and equi-joins
(adaptive execution splits hot keys); intermediate tables are written to the shared folder,
and those that only lead to the components are deleted once the components are written.

Null or blank texts have an empty set and are linked with nothing.  Repeated rows share a component; a null
doc_id is no representative of a class with other ids.  Empty tables give no rows; extra columns are
ignored (kept by ``drop_near_copies``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmf.llm.common import stored, table, unused, workspace
from gridmf.llm.words import find, mix, seeds, shingles, slices, words

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 64, 6
M = BANDS * ROWS
BASE, A, Q = 1.001, 20.0, (1 << 16) - 2
SURE = 12.0
FIRST, STAR_ROUNDS = 8, 2
BIT_WORDS, LEAST_BITS = 4, 200
BROADCAST_ROWS = 100_000
PART_NODES, PART_BYTES = 8, 8 << 20
COMPARED = 1 << 20
_MULT = (seeds(M, 41) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (seeds(M, 43) >> np.uint64(32)).astype(np.uint32)
_BAND = seeds(BANDS, 47)
_ROW = seeds(ROWS, 53) | np.uint64(1)


def text_sets(buf: np.ndarray, offs: np.ndarray):
    """Each text's sorted distinct shingles."""
    h, _, _, first = words(buf, offs)
    s, at = shingles(h, first, SHINGLE)
    for i in range(len(offs) - 1):
        yield np.unique(s[at[i]:at[i + 1]])


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a non-empty set."""
    x = (mix(s) >> np.uint64(32)).astype(np.uint32)
    low = np.full(M, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 256):
        low = np.minimum(low, (x[i:i + 256, None] * _MULT + _ADD).min(axis=0))
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(e / A) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of all bands, sketches x BANDS."""
    x = regs.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((x * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)


def register_bits(regs: np.ndarray) -> np.ndarray:
    """One bit each of the first 256 registers, as BIT_WORDS 64-bit words."""
    bits = (mix(regs.reshape(-1, M)[:, :64 * BIT_WORDS].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, at_least: float = PERCENT / 100) -> np.ndarray:
    """Pairs (registers pairs x M, set sizes) whose similarity may be ``at_least`` by joint likelihood."""
    plus = (ra > rb).sum(axis=1)[:, None]
    minus = (ra < rb).sum(axis=1)[:, None]
    same = ra.shape[1] - plus - minus
    u = (na / (na + nb))[:, None]
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return plus * np.log(up) + minus * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))

    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.01, 1.0, 50)[None, :]
    values = np.where(grid <= most + 1e-9, log_likelihood(np.minimum(grid, most)), -np.inf)
    best = np.maximum(values.max(axis=1), log_likelihood(most)[:, 0])
    above = np.where((grid >= at_least) & (grid <= most + 1e-9), values, -np.inf).max(axis=1)
    above = np.maximum(above, np.maximum(log_likelihood(np.minimum(at_least, most)), log_likelihood(most))[:, 0])
    possible = most[:, 0] >= at_least - 1e-9
    return possible & (best - above <= SURE)


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, cls, regs): each row's text hash, set size, set digest and sketch."""
    def each(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, buf, offs in slices(texts):
                n, cls, regs = [], [], []
                for s in text_sets(buf, offs):
                    n.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append(sketch(s).tobytes() if len(s) else None)
                part = batch.slice(lo, len(n))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.binary())],
                    names=["doc_id", "h", "n", "cls", "regs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, h long, n long, cls binary, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M)
            keys = band_keys(regs).reshape(-1).view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "regs").mapInArrow(each, "key long, node long")


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of pairs (a, b), made distinct on either side before they meet."""
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose ``node`` is in ``wanted``; the ids are broadcast if a count shows that they are few."""
    few = wanted.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are links: likelihood first, then the full sets."""
    def attach(p: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
        for side in ("a", "b"):
            r = rows.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
            p = p.join(r, side)
        return p

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("regs_a", "regs_b"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            yield batch.filter(pa.array(likely(ra, rb, na, nb))).select(["a", "b"])

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    ids = stored(pairs, f"{name}-pairs")
    wanted = _ends(ids)
    maybe = attach(ids, _only(sketches, wanted), ["regs", "n"]).mapInArrow(judge, "a long, b long")
    maybe = stored(maybe, f"{name}-maybe")
    wanted = _ends(maybe)
    return stored(attach(maybe, _only(sets, wanted), ["s"]).mapInArrow(confirm, "a long, b long"), f"{name}-links")


def components(edges: DataFrame, work: str = "components") -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label: the component's least node.

    Alternates large-star and small-star steps on the edge table until it stays the same; hubs are
    joined, not collected.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                               F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{work}/edges")
    before = mark(e)
    while True:
        e = stored(star(star(e, True), False), f"{work}/edges")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")) \
        .union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) of every row; h is the text's xxhash64."""
    rows = stored(document_classes(docs), "classes")
    nodes = stored(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.max("n").alias("n"),
                                                          F.first("regs").alias("regs"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")
    with workspace(docs.sparkSession, "near") as work:
        label = stored(_labels(docs, nodes, work), "labels")
    of_node = nodes.select("node", "cls", "rep").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = of_node.join(least, "label").select("cls", "component_id")
    out = rows.select("doc_id", "h", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labels(docs: DataFrame, nodes: DataFrame, work: str) -> DataFrame:
    """(node, label) of all nodes with links; tables named under ``work`` are needed to read it."""
    buckets = _bands(nodes).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")) \
        .where("size > 1").select("key", "lead")
    members = stored(_bands(nodes).join(buckets, "key"), f"{work}/buckets")
    met = members.select("node").distinct()
    sketches = stored(nodes.join(met, "node", "left_semi").select("node", "h", "n", "regs"), f"{work}/sketches")
    sets = stored(_full_sets(docs, sketches), f"{work}/sets")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    star = members.where((F.pmod("key", F.lit(FIRST)) == 0) & (F.col("node") != F.col("lead")))
    links = _confirmed(star.select(*pair(F.col("node"), F.col("lead"))).distinct(), sketches, sets, f"{work}/star")
    label = components(links, work)
    for turn in range(STAR_ROUNDS):
        members = _open_buckets(members, label, work)
        # one order of nodes for all buckets, so that a node meets few different leads
        lead = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), "node", "label")).alias("l")) \
            .select("key", F.col("l.node").alias("lead"), F.col("l.label").alias("lead_label"))
        star = members.join(lead, "key").where("label <> lead_label").select(*pair(F.col("node"), F.col("lead"))).distinct()
        label = _joined(label, _confirmed(star, sketches, sets, f"{work}/star{turn}"), work)
    return _joined(label, _between(_open_buckets(members, label, work), sketches, sets, work), work)


def _between(rest: DataFrame, sketches: DataFrame, sets: DataFrame, work: str) -> DataFrame:
    """Links (a, b), one for two components, among the open members ``rest`` (key, node, label) of each cluster."""
    first = rest.groupBy("key").agg(F.min("node").alias("lead"))
    cluster = components(rest.join(first, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), work)
    nodes = rest.select("node", "label").distinct().join(cluster.select("node", F.col("label").alias("cluster")), "node") \
        .join(sketches.select("node", "n", "regs"), "node").join(sets, "node")
    nodes = stored(nodes, f"{work}/open-nodes")
    size = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("s") + F.octet_length("regs")).alias("bytes"))
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt("m") / PART_NODES), F.ceil(F.col("bytes") / PART_BYTES)).cast("int")
    dealt = nodes.join(size.select("cluster", parts.alias("parts")), "cluster") \
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("cluster", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "label", "n", "regs", "s")
    return stored(dealt.groupBy("cluster", "lo", "hi").applyInArrow(_links_of_parts, "a long, b long"), f"{work}/between-links")


def _links_of_parts(rows: pa.Table) -> pa.Table:
    """Links of two parts of a cluster (or of one part), one for two components."""
    rows = rows.combine_chunks()
    part, node, label, n = (rows.column(c).to_numpy() for c in ("part", "node", "label", "n"))
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, M)
    bits = register_bits(regs).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
    ours = np.flatnonzero(part == part.min())
    theirs = np.flatnonzero(part != part.min())
    inside = not len(theirs)
    if inside:
        theirs = ours
    root = {int(x): int(x) for x in np.unique(label)}

    def find_root(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    step = max(1, COMPARED // max(len(theirs), 1))
    for lo in range(0, len(ours), step):
        mine = ours[lo:lo + step]
        near = (100 * np.minimum(n[mine][:, None], n[theirs]) >= PERCENT * np.maximum(n[mine][:, None], n[theirs]))
        near &= label[mine][:, None] != label[theirs]
        if inside:
            near &= mine[:, None] < theirs
        agree = np.full(near.shape, 64 * BIT_WORDS, np.uint16)
        for w in range(BIT_WORDS):
            agree -= np.bitwise_count(bits[mine, w][:, None] ^ bits[theirs, w])
        i, j = np.nonzero(near & (agree >= LEAST_BITS))
        i, j = mine[i], theirs[j]
        for at in range(0, len(i), 2048):
            x, y = i[at:at + 2048], j[at:at + 2048]
            maybe = likely(regs[x], regs[y], n[x].astype(float), n[y].astype(float))
            for a, b in zip(x[maybe].tolist(), y[maybe].tolist()):
                ra, rb = find_root(int(label[a])), find_root(int(label[b]))
                if ra == rb:
                    continue
                short, long = sorted((sets[a], sets[b]), key=len)
                both = int(np.count_nonzero(find(long, short) >= 0))
                if 100 * both >= PERCENT * (len(short) + len(long) - both):
                    links.append((int(node[a]), int(node[b])))
                    root[max(ra, rb)] = min(ra, rb)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _joined(label: DataFrame, new: DataFrame, work: str) -> DataFrame:
    """(node, label) with the components that new links (a, b) join; nodes in no link yet are their own label."""
    if new.isEmpty():
        return label
    ends = _ends(new).join(label, "node", "left_anti")
    known = label.unionByName(ends.select("node", F.col("node").alias("label")))
    edges = new
    for side in ("a", "b"):
        edges = edges.join(known.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side)
    merged = components(edges.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), work)
    return stored(known.join(merged.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
                  .select("node", F.coalesce("least", "label").alias("label")), f"{work}/labels")


def _open_buckets(members: DataFrame, label: DataFrame, work: str) -> DataFrame:
    """(key, node, label) of the buckets whose members are in more than one component."""
    m = members.select("key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    still = m.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return stored(m.join(still, "key", "left_semi").select("key", "node", "label"), f"{work}/open")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the full shingle sets of the nodes, from one document each."""
    def each(batches):
        for batch in batches:
            for lo, buf, offs in slices(batch.column("text")):
                sets = [s.tobytes() for s in text_sets(buf, offs)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, len(sets)), pa.array(sets, pa.binary())], names=["node", "s"])

    # h alone picks documents with the class's text; several copies of it give the node once
    want = nodes.select("node", "h")
    few = want.count() <= BROADCAST_ROWS
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(want) if few else want, "h").mapInArrow(each, "node long, s binary")
    return got.dropDuplicates(["node"])


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the document with the least doc_id (one row), and all rows without words."""
    ident, h, n, key, turn = unused(docs.columns, "id", "h", "n", "key", "turn")
    found = near_duplicates(docs).where("kept OR n_shingles = 0").groupBy("doc_id", "h").agg(F.max("n_shingles").alias(n))
    found = found.select(F.col("doc_id").alias(ident), F.col("h").alias(h), n)
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(h)))
    one = Window.partitionBy(ident, h).orderBy(F.lit(0))
    return kept.withColumn(turn, F.row_number().over(one)).where((F.col(n) == 0) | (F.col(turn) == 1)).select(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
