"""Groups of documents with similar sets of word n-grams (Jaccard), by a prefix-tree join.

1. Sets are ordered, rare shingles first. Two sets that are similar enough share a shingle among their first
   few (the prefix). Documents with equal sets stand behind one of them.
2. Two rounds compare each set with two of those that share one of its first shingles, at first with any, then
   with those that have most links: the text that a family of edited copies comes from has. Most links show
   here, and the components they form are never compared inside again.
3. A family whose members differ in rare places shares none of those first shingles. So each set is compared with
   one set of the largest component at every shingle of its prefix, again while there may be many times more pairs
   than rows: one pair a row, where the last round would take all pairs of the family. Shingles whose sets cannot
   be similar by length and place are left out before.
4. A last round takes every pair of sets in different components that shares a shingle of both prefixes and
   passes the bounds on length and position that hold at the first shared one. So no link between components is
   lost. Pairs whose parity sketches differ in more bits than similar sets can differ in elements are left out.
5. In all rounds a set is looked up in a prefix tree of its partners, which shares the overlaps of common
   beginnings and leaves subtrees that cannot reach the similarity.
6. Components of all links.

Full sets are made for documents with partners only. Partners of one set are dealt over several tasks by
their number; groups of equal or similar documents of any size never meet in one task.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm import trie
from cellarbook.llm.batches import handed_back, small_batches
from cellarbook.llm.graph import components
from cellarbook.llm.shingles import Levels, corpus_levels, shingle_sets
from cellarbook.llm.words import chunks
from cellarbook.operators.joins import join_side
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

WORDS, PERCENT = 5, 80
FIRST = 4  # shingles of a set that the first rounds look at
TURNS, EACH = 4, 8  # rounds with hubs: one, and more while there may be over so many pairs a row and each halves them
PARTNERS = 256  # partners of one set in one prefix tree
BEFORE = 4  # shingles before a shared one that show whether it is the first
BITS = 512  # of the parity sketch of a small set; a larger one has a power of two not below its size
BROADCAST_ROWS = 400_000  # of (doc_id, digest), about 25 MB; more are joined with a shuffle


def _sets(batches, words: int, levels: Levels):
    """(batch, row, ordered keys, digest) of every text in the last column."""
    for batch in batches:
        for row, _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            for i, keys in enumerate(shingle_sets(data, offsets, words, levels)):
                yield batch, row + i, keys, hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _heads(docs: DataFrame, words: int, percent: int, levels: Broadcast) -> DataFrame:
    """doc_id, n, sig, prefix and parity sketch of every row."""
    longs = pa.list_(pa.int64())

    def run(batches):
        rows: list[tuple] = []

        def out():
            ids, n, sig, prefix, bits = zip(*rows, strict=True)
            lengths = np.cumsum([0, *map(len, prefix)])
            flat = pa.array(np.concatenate(prefix).view(np.int64) if lengths[-1] else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists.cast(longs)]
            ends = pa.array(np.cumsum([0, *map(len, bits)]), pa.int32())
            sketch = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits))).cast(longs)
            return pa.RecordBatch.from_arrays([*arrays, sketch], ["doc_id", "n", "sig", "prefix", "bits"])

        for batch, row, keys, sig in _sets(batches, words, levels.value):
            n = len(keys)
            length = n - -(-percent * n // 100) + 1 if n else 0
            size = max(BITS, 1 << max(0, n - 1).bit_length())
            odd = np.bincount((keys % np.uint64(size)).astype(np.int64), minlength=size) & 1
            bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
            rows.append((batch.column(0)[row].as_py(), n, sig, keys[:length], bits))
            if len(rows) >= 2000:
                yield out()
                rows = []
        if rows:
            yield out()

    return docs.mapInArrow(lambda batches: handed_back(run(batches)), "doc_id long, n long, sig binary, prefix array<long>, bits array<long>")


def _close(percent: int, m: str, n: str) -> str:
    return f"100 * least({m}, {n}) >= {percent} * greatest({m}, {n})"


def _near_bits(percent: int, x: str, y: str, m: str, n: str) -> str:
    """Condition on sketches x, y of sets of m and n elements that all similar sets meet.

    Where one sketch is twice as long, its halves are laid over each other; that brings none farther apart.
    """
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (p, q) -> p ^ q)"
    fold = "CASE WHEN size({0}) > size({1}) THEN " + half + " ELSE {0} END"
    differ = f"zip_with({fold.format(x, y)}, {fold.format(y, x)}, (p, q) -> bit_count(p ^ q))"
    overlap = f"({percent} * ({m} + {n}) + {99 + percent}) div {100 + percent}"
    return f"aggregate({differ}, 0, (s, x) -> s + x) <= {m} + {n} - 2 * ({overlap})"


def _first_pairs(reps: DataFrame, percent: int, links: DataFrame | None = None) -> DataFrame:
    """Each set with two of those that share one of its first shingles: any two, or the most linked and any."""
    spark = reps.sparkSession
    named = reps.select("rep", "n", F.lit(0).alias("degree"), "prefix")
    if links is not None:
        ends = links.select(F.col("a").alias("rep")).union(links.select("b"))
        degrees = write_table(ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links")), scratch_path(spark, "degrees"))
        named = join_side(reps, degrees, ["rep"], "left").select("rep", "n", F.coalesce("links", F.lit(0)).alias("degree"), "prefix")
    rows = named.select("rep", "n", "degree", F.explode(F.slice("prefix", 1, FIRST)).alias("token"))
    best = F.max(F.struct("degree", (-F.col("rep")).alias("low"), "rep", "n"))
    any_ = F.min(F.struct(F.xxhash64("token", "rep", F.lit(links is None)).alias("h"), "rep", "n"))
    hubs = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), best.alias("x"), any_.alias("y")).where("c > 1")
    rows = rows.drop("degree")
    hubs = hubs.select("token", F.array(F.struct("x.rep", "x.n"), F.struct("y.rep", "y.n")).alias("hubs"))
    hubs = write_table(hubs, scratch_path(spark, "hubs"))
    pairs = join_side(rows, hubs, ["token"]).select("rep", "n", F.explode("hubs").alias("hub"))
    pairs = pairs.where(f"rep <> hub.rep AND {_close(percent, 'n', 'hub.n')}")
    return pairs.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the component of their set, and its known members."""
    spark = rows.sparkSession
    sizes = write_table(known.groupBy("component").agg(F.count(F.lit(1)).alias("members")), scratch_path(spark, "sizes"))
    sizes = sizes.withColumnRenamed("component", "comp")
    known = write_table(known.withColumnRenamed("node", "rep"), scratch_path(spark, "known"))
    named = join_side(rows, known, ["rep"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    return join_side(named, sizes, ["comp"], "left").withColumn("members", F.coalesce("members", F.lit(0)).cast("int"))


def _common(reps: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """token, rep, n and place of the prefix shingles that sets of different components share.

    A row is left out where its length and place, or those of all others at the shingle, let no pair be similar:
    of two sets of m and n elements, either must have 100 + percent times its rest at least percent * (m + n).
    """
    spark = reps.sparkSession
    named = _placed(reps.select("rep", F.col("n").cast("int").alias("n"), "prefix"), known)
    rows = named.select("rep", "n", "comp", F.posexplode("prefix").alias("at", "token"))
    tokens = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    tokens = write_table(tokens.where("low < high").select("token"), scratch_path(spark, "tokens"))
    rows = write_table(join_side(rows.drop("comp"), tokens, ["token"]), scratch_path(spark, "shared"))
    ample, own = f"{100 + percent}L * (n - at)", f"{percent}L * n"
    bounds = rows.groupBy("token").agg(
        *(F.expr(x) for x in ("count(1) AS c", f"min({ample}) AS rest", f"sum({own}) AS both")),
        *(F.expr(x) for x in (f"min({own}) AS least", f"max({ample} - {own}) AS reach")),
    )
    bounds = write_table(bounds.where("c > 2 OR rest >= both").select("token", "least", "reach"), scratch_path(spark, "bounds"))
    may = join_side(rows, bounds, ["token"]).where(f"{ample} - {own} >= least AND {own} <= reach")
    return write_table(may.drop("least", "reach"), scratch_path(spark, "common"))


def _hub_pairs(common: DataFrame, known: DataFrame, percent: int, turn: int) -> tuple[DataFrame, int, int]:
    """Each set with one of the largest other component at every shingle they share: one pair a row at most.

    Also the number of rows, and about the most pairs that the last round could have: at a shingle, a set that may
    be similar to one of the largest component meets all.
    """
    spark = common.sparkSession
    rows = write_table(_placed(common, known), scratch_path(spark, "placed"))
    hub = F.struct("members", "comp", F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "at")
    tokens = rows.groupBy("token").agg(F.max(hub).alias("hub"), F.count(F.lit(1)).alias("c"))
    tokens = write_table(tokens.where("c > 1"), scratch_path(spark, "hubs"))
    may = f"""comp <> hub.comp AND {_close(percent, 'n', 'hub.n')}
        AND {100 + percent} * least(n - at, hub.n - hub.at) >= {percent} * (n + hub.n)"""
    apart = join_side(rows, tokens, ["token"]).where(may).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), "c")
    apart = write_table(apart, scratch_path(spark, "apart"))
    return apart.select("a", "b").distinct(), rows.count(), apart.agg(F.sum("c")).first()[0] or 0


def _later_pairs(reps: DataFrame, common: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that share a shingle of both prefixes and may still be similar."""
    spark = reps.sparkSession
    rows = write_table(_placed(common, known), scratch_path(spark, "placed"))
    largest = F.max(F.struct("members", "comp")).getField("comp")
    tokens = rows.groupBy("token").agg(largest.alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    tokens = write_table(tokens.where("low < high").select("token", "main"), scratch_path(spark, "tokens"))
    before = F.slice("prefix", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least("at", F.lit(BEFORE))).alias("before")
    shared = join_side(rows.drop("members"), tokens, ["token"]).join(reps.select("rep", "prefix", "bits"), "rep")
    shared = write_table(shared.select("token", "main", "rep", "n", "comp", "at", before, "bits"), scratch_path(spark, "shared"))
    # Within a token, all that is not in its largest component meets everything of other components.
    # A pair is needed at its first common shingle only: there, all that they share is still to come, and none
    # of the shingles just before is common.
    left = shared.where("comp <> main").select("token", *(F.col(c).alias(f"l_{c}") for c in ("rep", "n", "comp", "at", "before", "bits")))
    may = f"""l_comp <> comp AND (comp = main OR l_rep < rep) AND {_close(percent, 'l_n', 'n')}
        AND {100 + percent} * least(l_n - l_at, n - at) >= {percent} * (l_n + n)
        AND NOT arrays_overlap(l_before, before)
        AND {_near_bits(percent, "l_bits", "bits", "l_n", "n")}"""
    pairs = left.join(shared, "token").where(may)
    return pairs.select(F.least("l_rep", "rep").alias("a"), F.greatest("l_rep", "rep").alias("b")).distinct()


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int, levels: Broadcast) -> DataFrame:
    """The pairs that are similar enough, found in prefix trees over whole sets."""
    spark = docs.sparkSession
    x, y = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    pairs = pairs.join(x, "a").join(y, "b").where(_close(percent, "n_a", "n_b"))
    pairs = pairs.where(_near_bits(percent, "bits_a", "bits_b", "n_a", "n_b")).select("a", "b")
    pairs = write_table(pairs, scratch_path(spark, "pairs"))
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    ids = write_table(reps.select("rep", "doc_id", "sig").join(ids, "rep", "left_semi"), scratch_path(spark, "partners"))

    def full(batches):
        rows: list[tuple] = []
        for batch, row, keys, sig in _sets(batches, words, levels.value):
            if sig == batch.column(1)[row].as_py():
                rows.append((batch.column(0)[row].as_py(), keys.tobytes()))
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist([{"id": i, "keys": k} for i, k in rows], schema)
                rows = []
        yield pa.RecordBatch.from_pylist([{"id": i, "keys": k} for i, k in rows], schema)

    schema = pa.schema([("id", pa.int64()), ("keys", pa.binary())])
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = docs.join(side, "doc_id").select("rep", "sig", "text")
    sets = write_table(texts.mapInArrow(lambda batches: handed_back(full(batches)), "id long, keys binary"), scratch_path(spark, "sets"))
    # A set with many partners is looked up in several trees.
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("trees"))
    counts = write_table(counts, scratch_path(spark, "trees"))
    dealt = join_side(pairs, counts, ["a"]).withColumn("tree", F.pmod(F.xxhash64("b"), "trees")).drop("trees")
    members = dealt.select("a", "tree", F.col("b").alias("id")).join(sets, "id").select("a", "tree", F.lit(1).alias("kind"), "id", "keys")
    probes = counts.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"))
    probes = probes.join(sets, "id").select(F.col("id").alias("a"), "tree", F.lit(0).alias("kind"), "id", "keys")

    def look_up(batches):
        def rows():
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True)

        found: list[tuple[int, int]] = []
        for (a, _), group in groupby(rows(), key=lambda r: r[:2]):
            probe, sets = None, {}
            for _, _, kind, name, keys in group:
                keys = np.frombuffer(keys, np.uint64)
                if kind:
                    sets[name] = keys
                else:
                    probe = keys
            if probe is not None:
                found += [(a, b) for b in trie.similar(trie.build(list(sets.items())), probe, percent)]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    together = members.unionByName(probes).repartition("a", "tree").sortWithinPartitions("a", "tree", "kind")
    return write_table(together.mapInArrow(lambda batches: handed_back(look_up(batches)), "a long, b long"), scratch_path(spark, "links"))


def group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    Two documents link when their sets' Jaccard similarity is at least `percent` / 100. Null and empty texts
    have empty sets and link with nothing. A row without doc_id has no component. Rows that share a doc_id
    have sets, and links, of their own. Other columns are ignored. An empty table gives no rows.
    """
    if percent < 50:
        raise ValueError("sketches are compared for similarities of one half and more")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    levels = spark.sparkContext.broadcast(corpus_levels(docs, words))
    heads = write_table(_heads(docs, words, percent, levels), scratch_path(spark, "heads"))
    known = heads.where("n > 0 AND doc_id IS NOT NULL")
    groups = known.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "prefix", "bits")).alias("r"), F.count(F.lit(1)).alias("copies"))
    # Sets have numbers of their own: a doc_id may stand for several.
    numbered = groups.select(F.monotonically_increasing_id().alias("rep"), "sig", "r.doc_id", "r.n", "r.prefix", "r.bits", "copies")
    reps = write_table(numbered, scratch_path(spark, "reps"))
    first = _links(docs, reps, _first_pairs(reps, percent), words, percent, levels)
    first = first.union(_links(docs, reps, _first_pairs(reps, percent, first), words, percent, levels))
    known = components(first)
    common = _common(reps, known, percent)
    before = None
    for turn in range(TURNS):
        pairs, rows, most = _hub_pairs(common, known, percent, turn)
        if before is not None and 2 * most > before:
            break
        first = first.union(_links(docs, reps, pairs, words, percent, levels))
        known = components(first)
        if most <= EACH * rows:
            break
        before = most
    later = _links(docs, reps, _later_pairs(reps, common, known, percent), words, percent, levels)
    final = write_table(components(first.union(later)).withColumnRenamed("node", "rep"), scratch_path(spark, "final"))
    named = join_side(reps.select("sig", "rep", "doc_id", "copies"), final, ["rep"], "left")
    named = write_table(named.withColumn("component", F.coalesce("component", "rep")), scratch_path(spark, "named"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members"))
    least = write_table(least.where("members > 1").drop("members"), scratch_path(spark, "least"))
    shared = write_table(join_side(named, least, ["component"]).select("sig", "component_id"), scratch_path(spark, "shared"))
    out = join_side(heads.select("doc_id", "n", "sig"), shared, ["sig"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(component, "doc_id").alias("component_id"))
