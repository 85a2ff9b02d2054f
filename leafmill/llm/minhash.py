"""Near duplicates by the Jaccard similarity of word shingles: linked at SIMILARITY or more of SHINGLE-word shingles.

Candidates come by SimHash (the module is named after MinHash bands, which it had before). With equal weights the
fingerprints of two texts at a similarity of 0.8 differ in some 10 of 64 bits, beyond what the pigeonhole principle can
find; so each text has TABLES fingerprints, under random weights of which a few are most of the sum (see
simhash.weighted_fingerprints). At 0.8 about 42 % of the tables are within TAU bits, and a share of 2e-6 of the pairs in
none; at 0.1 it is 5 % of them, so many candidates are false. simhash.links finds what is within TAU bits by partitions
and thresholds, table by table; its components are the buckets. All else is exact: candidates are linked by their sets.

0. Sizes, and what falls into each of CELLS cells by hash, bound any pair before texts are read (the lesser of two counts
   bounds what is common there). Of buckets of up to SMALL nodes all pairs are formed and bounded so.
1. Every other bucket's texts are held against its smallest node, whatever the bucket's size, and components are made.
2. Buckets that still have several components are held against their hub, the node that has the smallest share of
   shingles that no other text of these buckets has; in a group of edited copies that is the least edited one.
3. What lies outside its hub's component is held against the other texts of that hub, by their shingles in the hub and
   beside it. A pair is formed if the lesser of the two counts in the hub would do alone, or if they share shingles
   beside the hub and these make it enough; the latter come from lists of shingles, so that edited copies that share
   no edit never meet. Pairs within a component are never formed.

Words are lower-cased as for SimHash; shorter texts have one shingle; texts without words are equal. Equal shingle sets
are one node, so copies cost nothing. Identity of shingles, sets and buckets rests on 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import wordscan as ws
from .common import by_sorting, materialize, only, release, tune
from .graph import components
from .simhash import joined_words

SHINGLE, SIMILARITY = 5, 0.8
#: Cells by which two sets' common part is bounded.
CELLS = 256
#: Rows of a bucket of which all pairs are held against each other's cells.
SMALL = 16


def shingles(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with repeats, and the index of each row's first (n + 1)."""
    text, starts, ends, first = joined_words(data, off)
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    word = np.arange(int(begin[-1])) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    last = np.minimum(word + shingle, np.repeat(first[1:], count)) - 1
    if not len(word):
        return np.zeros(0, np.uint64), begin
    return ws.range_hash(ws.prefix_hash(np.frombuffer(text, np.uint8)), starts[word], ends[last]), begin


def sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    hashes, begin = shingles(data, off, shingle)
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                own = sets(*ws.buffers(part.column("text")), shingle)
                node = [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in own]
                n = np.array([len(s) for s in own])
                cells = [np.bincount((s >> np.uint64(32)).astype(np.int64) % CELLS, minlength=CELLS) for s in own]
                cells = pa.array([c.astype(np.uint8).tobytes() if c.max() < 256 else None for c in cells], pa.binary())
                begin = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=begin[1:])
                # Texts without words have one node, and need no fingerprints to meet.
                fps = simhash.weighted_fingerprints(np.concatenate(own), begin)[n > 0].reshape(-1)
                width = np.zeros(len(n) + 1, np.int32)
                width[1:] = (n > 0) * simhash.TABLES
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(width, dtype=np.int32)), pa.array(fps.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), cells, lists], ["doc_id", "key", "node", "n", "cells", "fps"])

    return run


def _alike(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch, "text_a"):
                both = zip(*(sets(*ws.buffers(part.column(c)), shingle) for c in ("text_a", "text_b")), strict=True)
                common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in both]
                yield part.select(["a", "b"]).filter(pa.array([c / (total - c) >= similarity for c, total in common], pa.bool_()))

    return run


def _own(bodies: DataFrame, shingle: int) -> DataFrame:
    """node, own: the number of its shingles that no other node of bodies (node, text) has; nodes without any lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch):
                own = sets(*ws.buffers(part.column("text")), shingle)
                node = part.column("node").take(pa.array(np.repeat(np.arange(len(own)), [len(s) for s in own])))
                yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(own).view(np.int64))], ["node", "shingle"])

    held = bodies.select("node", "text").mapInArrow(run, "node long, shingle long")
    single = held.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("_c")).where("_c = 1")
    return single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _apart(shingle: int):
    """Of node's shingles, how many the hub has, and those that it hasn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ws.pieces(batch, "text_a"):
                both = list(zip(*(sets(*ws.buffers(part.column(c)), shingle) for c in ("text_a", "text_b")), strict=True))
                beside = [np.setdiff1d(x, y, assume_unique=True).view(np.int64) for x, y in both]
                common = [len(x) - len(z) for (x, _), z in zip(both, beside, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("hub"), pa.array(common, pa.int32()), pa.array(beside, pa.list_(pa.int64()))], ["node", "hub", "common", "beside"])

    return run


def _possible(similarity: float):
    """Pairs that what falls into each cell lets reach the similarity; sets too large for such counts are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(pc.and_(batch.column("cells_a").is_valid(), batch.column("cells_b").is_valid()))
            a, b = (np.frombuffer(b"".join(batch.column(c).filter(pa.array(known)).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("cells_a", "cells_b"))
            common, total = np.minimum(a, b).sum(1, dtype=np.int64), a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
            keep = np.ones(batch.num_rows, bool)
            keep[known] = common / np.maximum(total - common, 1) >= similarity
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def buckets(nodes: DataFrame) -> DataFrame:
    """node, n, band of nodes (node, n, fps) that meet others: a band is a component of one table's fingerprints."""
    rows = nodes.select("node", "n", F.posexplode("fps").alias("table", "fp"))
    prints = materialize(rows.groupBy("table", "fp").agg(F.count(F.lit(1)).alias("_c")), "tables")
    sample = np.array([r[0] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(simhash.SAMPLE).collect()], np.int64).view(np.uint64)
    # Fingerprints meet those of their own table alone.
    found = simhash.links(prints.select("table", "fp"), simhash.plan(sample, prints.count() // simhash.TABLES))
    roots = materialize(components(found).select(F.col("node").alias("fp"), F.col("root").alias("band")), "bands")
    equal = prints.where("_c > 1").join(by_sorting(roots), "fp", "left_anti").select("fp", F.col("fp").alias("band"))
    out = materialize(rows.join(by_sorting(roots.unionByName(equal)), "fp").select("node", "n", "band"), "met")
    release(prints, found, roots)
    return out


def paired(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (band, n, ...) but those that no other of their band could equal at the similarity, by their sizes.

    Sizes within the similarity of each other are in one class or in classes beside each other.
    """
    classed = rows.withColumn("_class", F.floor(F.log(F.col("n").cast("double")) / (-1.001 * math.log(similarity))).cast("int"))
    counts = classed.groupBy("band", "_class").agg(F.count(F.lit(1)).alias("_c"))
    per = counts.groupBy("band").agg(F.collect_list("_class").alias("_classes"), F.collect_list(F.when(F.col("_c") > 1, F.col("_class"))).alias("_several"))
    beside = F.array_contains("_classes", F.col("_class") + 1) | F.array_contains("_classes", F.col("_class") - 1)
    return classed.join(by_sorting(per), "band").where(beside | F.array_contains("_several", F.col("_class"))).select(*rows.columns)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id for every row of docs; component_id is the smallest doc_id reachable by links."""
    tune(docs.sparkSession)
    texts = only(docs, "doc_id", "text").withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    prints = materialize(texts.mapInArrow(_prints(shingle), "doc_id long, key binary, node long, n int, cells binary, fps array<long>"), "prints")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "key")).alias("at"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("fps").alias("fps")), "nodes")
    met = buckets(nodes)
    rows = paired(met, similarity)
    pivots = rows.groupBy("band").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    shared = materialize(rows.join(by_sorting(pivots), "band").select("band", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), "_c"), "shared")
    release(met)

    def sized(x: str, y: str):
        return F.least(x, y) / F.greatest(x, y) >= similarity

    def possible(pairs: DataFrame) -> DataFrame:
        one, two = (cells.select(F.col("node").alias(x), F.col("cells").alias(f"cells_{x}")) for x in ("a", "b"))
        return materialize(materialize(pairs.distinct(), "held").join(by_sorting(two), "b").join(by_sorting(one), "a").select("a", "b", "cells_a", "cells_b").mapInArrow(_possible(similarity), "a long, b long"), "possible")

    cells = materialize(nodes.select("node", "cells").join(by_sorting(shared.select("node").distinct()), "node", "left_semi"), "cells")
    # All pairs of small buckets, and of the others those with the pivot.
    small = shared.where(F.col("_c") <= SMALL).select("band", "node", "n")
    both = small.join(by_sorting(small.select("band", F.col("node").alias("node_b"), F.col("n").alias("n_b"))), "band").where((F.col("node") < F.col("node_b")) & sized("n", "n_b"))
    star = shared.where((F.col("_c") > SMALL) & (F.col("node") != F.col("pivot")) & sized("n", "pivot_n"))
    first = possible(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(both.select(F.col("node").alias("a"), F.col("node_b").alias("b"))))
    # What could equal none but the pivot is settled.
    others = materialize(paired(shared.where((F.col("_c") > SMALL) & (F.col("node") != F.col("pivot"))).select("band", "node", "n"), similarity), "others")

    # The texts of candidates, one row a node.
    wanted = nodes.join(by_sorting(first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(others.select("node")).distinct()), "node").select("node", F.col("at.key").alias("_key"), F.col("at.doc_id").alias("_id"))
    met = texts.join(by_sorting(wanted), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    bodies = materialize(met.select("node", "text").dropDuplicates(["node"]), "bodies")

    def linked(pairs: DataFrame) -> DataFrame:
        one = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return materialize(pairs.join(by_sorting(two), "b").join(by_sorting(one), "a").select("a", "b", "text_a", "text_b").mapInArrow(_alike(shingle, similarity), "a long, b long"), "near")

    stars = linked(first)
    roots = materialize(components(stars), "roots")
    placed = others.join(by_sorting(roots), "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    part = materialize(placed.join(by_sorting(split), "band", "left_semi"), "part")
    parted = materialize(bodies.join(by_sorting(part.select("node").distinct()), "node"), "parted")
    met = F.col("n") - F.coalesce("own", F.lit(0))
    left = materialize(part.join(by_sorting(_own(parted, shingle)), "node", "left").select("band", "node", "n", "root", met.alias("met")), "left")

    # Shingles that no other of these texts has bound what two can have in common.
    def enough(common: Column, n: str = "n", n_b: str = "n_b") -> Column:
        return common / (F.col(n) + F.col(n_b) - common) >= similarity

    hub = F.max(F.struct((F.col("met") / F.col("n")).alias("share"), F.col("node").alias("hub"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("met").alias("met_b")))
    hubs = materialize(left.groupBy("band").agg(hub.alias("h"), F.min("n").alias("least_n")).select("band", "least_n", "h.*"), "hubs")
    again = left.join(by_sorting(hubs), "band").where((F.col("root") != F.col("root_b")) & enough(F.least("met", "met_b")))
    again = linked(possible(again.select(F.col("hub").alias("a"), F.col("node").alias("b"))))
    stars = stars.unionByName(again)
    roots = materialize(components(stars), "roots")

    # What is left are rows outside their hub's component, if any text of the bucket's sizes could reach them.
    rooted = left.drop("root").join(by_sorting(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = hubs.select("band", "hub", "least_n").join(by_sorting(roots.select(F.col("node").alias("hub"), F.col("root").alias("main"))), "hub", "left").select("band", "hub", "least_n", F.coalesce("main", "hub").alias("main"))
    reach = F.col("met") / (F.col("n") + F.greatest("least_n", "met") - F.col("met")) >= similarity
    within = materialize(rooted.join(by_sorting(main), "band").where(reach).where("node <> hub").select("node", "n", "root", "hub", "main").distinct(), "within")
    within_open = within.join(by_sorting(within.where("root <> main").select("hub").distinct()), "hub", "left_semi")
    one = parted.select("node", F.col("text").alias("text_a"))
    two = parted.select(F.col("node").alias("hub"), F.col("text").alias("text_b"))
    split_up = within_open.select("node", "hub").join(by_sorting(two), "hub").join(by_sorting(one), "node").select("node", "hub", "text_a", "text_b").mapInArrow(_apart(shingle), "node long, hub long, common int, beside array<long>")
    apart = materialize(within_open.join(by_sorting(split_up), ["node", "hub"]), "apart")

    def against(rows: DataFrame, *keys: str) -> DataFrame:
        """Pairs of a row outside its hub's component and one of another component, equal in the keys."""
        outside = rows.where("root <> main").drop("main")
        other = rows.select(*keys, "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "common")])
        once = (F.col("root_b") == F.col("main")) | (F.col("node") < F.col("node_b"))
        return outside.join(by_sorting(other), list(keys)).where((F.col("root") != F.col("root_b")) & sized("n", "n_b") & once)

    # In the hub two texts have at most the lesser count in common; beside it, what they share there.
    fewest = apart.groupBy("hub").agg(F.min("n").alias("least_n"))
    alone = F.col("common") / (F.col("n") + F.greatest("least_n", "common") - F.col("common")) >= similarity
    able = apart.join(by_sorting(fewest), "hub").where(alone).select("hub", "node", "n", "root", "main", "common")
    inside = against(able, "hub").where(enough(F.least("common", "common_b")))
    listed = apart.select("hub", "node", "n", "root", "main", "common", F.explode("beside").alias("shingle"))
    several = listed.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("hub", "shingle")
    listed = listed.join(by_sorting(several), ["hub", "shingle"])
    # A row whose shingles don't do with all of these in common is in no pair.
    most = F.col("common") + F.col("_c")
    usable = listed.groupBy("hub", "node", "n", "common").agg(F.count(F.lit(1)).alias("_c")).join(by_sorting(fewest), "hub").where(most / (F.col("n") + F.greatest("least_n", most) - most) >= similarity)
    listed = listed.join(by_sorting(usable.select("hub", "node")), ["hub", "node"], "left_semi")
    met_beside = against(listed, "hub", "shingle").groupBy("hub", "node", "node_b", "n", "n_b", "common", "common_b").agg(F.count(F.lit(1)).alias("_shared"))
    beside = met_beside.where(enough(F.least("common", "common_b") + F.col("_shared")))
    pairs = inside.select("node", "node_b", "n", "n_b").unionByName(beside.select("node", "node_b", "n", "n_b"))
    pairs = pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), "n", "n_b").select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    rest = linked(possible(pairs.select("a", "b")))
    roots = materialize(components(stars.unionByName(rest)), "roots")
    release(shared, others, first, bodies, part, parted, left, hubs, within, apart, pairs, cells)

    known = nodes.join(by_sorting(roots), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(by_sorting(least), "root").select("node", "component_id")
    out = materialize(prints.select("doc_id", "node").join(by_sorting(known), "node").select("doc_id", "component_id"), "found")
    release(prints, nodes, roots)
    return out
