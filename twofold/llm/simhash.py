"""SimHash fingerprints, and near duplicates by multi-index hashing (operator 7).

A fingerprint is cut into segments, and each segment has a table of the fingerprints by their value in it. Two
fingerprints that differ in at most RADIUS bits differ in at most r_i bits of some segment i, whenever the radii r_i + 1 add up
to RADIUS + 1 (the pigeonhole principle with uneven radii). So each fingerprint enumerates the Hamming ball of radius r_i
around its value in segment i, fetches the fingerprints in those cells, and verifies complete distances. Rows with one
fingerprint are collapsed before.

A cell may be crowded: many different fingerprints that share a segment. Those of more than CELL members are split by their
other bits: members and visitors meet under a key of the rest of the fingerprint, from which each side may lie one bit away, so
that all pairs within two bits there still meet, and a key has at most one visitor or member for each way to be so near.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like
any other; repeated rows link to each other; ties (equal fingerprints) are one component; very long texts are read whole; an
empty table gives an empty result; columns other than the id and the text are not read and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import doc_slices, drop_written, id_text, lean, quoted, written
from twofold.llm.components import components

BITS = 64
SEED = 42
RADIUS = 2
SEGMENTS = 2
#: Members of a table cell beyond which it is split by the other bits.
CELL = 64
#: Distinct fingerprints that one task makes cells of.
PART_ROWS = 100_000


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit word whose bits are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def text_fingerprint(text: bytes, shingle: int = 3, distinct: bool = False) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased, repeats included unless `distinct`)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    elif shingle == 1:
        grams = words
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    if distinct:
        grams = list(set(grams))
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams)))


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False, **cols: str) -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the unsigned 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            fps = np.array([text_fingerprint(t, shingle, distinct) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs, **cols).mapInArrow(lean(run), "doc_id long, fp long")


def radii(segments: int, radius: int = RADIUS) -> list[int]:
    """Radius in each segment, -1 where a segment needs no table: as even as can be, with radius + 1 = sum of r + 1."""
    whole, more = divmod(radius + 1, segments)
    return [whole - 1 + (i < more) for i in range(segments)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of the lowest `width` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def cell_of(segment: int, value: F.Column):
    """The table cell of a segment's value with some bits flipped."""
    return lambda mask: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(mask).alias("value"))


def segment_tables(fps: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """(members, visitors), both (seg, value, fp): the cell of each fingerprint, and the cells that it visits."""
    width = BITS // segments
    members, visitors = [], []
    for i, r in enumerate(radii(segments)):
        if r < 0:
            continue
        value = F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(signed((1 << width) - 1)))
        members.append(F.array(cell_of(i, value)(F.lit(0))))
        visitors.append(F.transform(F.lit([signed(m) for m in ball(width, r)]).cast("array<long>"), cell_of(i, value)))
    held, seen = F.concat(*members), F.concat(*visitors)
    return tuple(fps.select(F.explode(x).alias("c"), "fp").select("c.seg", "c.value", "fp") for x in (held, seen))


def rest_keys(side: DataFrame, segments: int) -> DataFrame:
    """(seg, value, rest, fp): the bits outside the segment, and all that differ from them in one."""
    width = BITS // segments
    every = []
    for i in range(segments):
        inside = ((1 << width) - 1) << (i * width)
        masks = [0] + [1 << b for b in range(BITS) if not inside >> b & 1]
        rest = F.col("fp").bitwiseAND(F.lit(signed(~inside & ((1 << 64) - 1))))
        every.append(F.when(F.col("seg") == i, F.array(*[rest.bitwiseXOR(F.lit(signed(m))) for m in masks])))
    return side.select("seg", "value", F.explode(F.coalesce(*every)).alias("rest"), "fp")


def links(fps: DataFrame, segments: int = SEGMENTS, cell: int = CELL) -> DataFrame:
    """(a, b), a > b: all pairs of different fingerprints within RADIUS bits, each once."""
    ones = written(fps.select("fp").distinct(), "fingerprints")
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ones.count() // PART_ROWS)
    members, visitors = segment_tables(ones.repartition(parts, "fp"), segments)
    crowded = written(members.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("seg", "value"), "crowded-cells")

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        far = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
        both = left.withColumnRenamed("fp", "x").join(right.withColumnRenamed("fp", "y"), on)
        return both.where((F.col("x") != F.col("y")) & (far <= RADIUS)).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    found = met(visitors, members.join(crowded, ["seg", "value"], "left_anti"), ["seg", "value"])
    if crowded.limit(1).count():  # else the plan has no need of that branch
        inside = [rest_keys(side.join(crowded, ["seg", "value"], "left_semi"), segments) for side in (visitors, members)]
        found = found.unionByName(met(*inside, ["seg", "value", "rest"]))
    return found.distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, segments: int = SEGMENTS, **cols: str) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of RADIUS bits or fewer reach."""
    fps = written(fingerprints(docs, shingle, **cols), "simhash")
    member = components(links(fps, segments), "a", "b")  # (node, root)
    named = (
        fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
        .join(member.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


#: Near copies of the pipeline: BANDS keys of BAND_ROWS min-hashes each. A pair of similarity 0.8 shares no key with a chance of
#: (1 - 0.8 ** 5) ** 40, about 1 in 8 million.
NEAR = 0.8
BANDS, BAND_ROWS = 40, 5
GRAM = 5
#: Pivots that the members of a crowded cell are compared with, one after the other.
PIVOTS = 2
#: Places in which shingles are counted to tell rare from frequent ones.
RANK_PLACES = 1 << 16
#: Places of the sieve that tells rows without a key from others before a shuffle.
SIEVE = 1 << 25
_DRAWN = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def gram_hashes(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(GRAM)), strict=False))) if len(words) >= GRAM else {b" ".join(words)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams)))


def set_node(grams: np.ndarray) -> bytes:
    """Name of a shingle set: 128 bits of its hashes, so that no unlike text is taken for another."""
    return xxhash.xxh128_digest(grams.tobytes(), SEED)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the hash functions."""
    out = np.full(len(FLIPS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 1 << 10):
        x = (grams[at : at + (1 << 10)] ^ FLIPS) * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def set_signatures(docs: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, tag, node, fp, bands): for each row a hash of its text, the name, the SimHash and the keys of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            tags, nodes, fps, bands = [], [], [], []
            for text in texts:
                grams = gram_hashes(text)
                tags.append(hashlib.md5(text, usedforsecurity=False).digest())
                nodes.append(set_node(grams))
                fps.append(majority_bits(grams))
                rows = min_hashes(grams).reshape(BANDS, BAND_ROWS)
                bands.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(tags, pa.binary()), pa.array(nodes, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "tag", "node", "fp", "bands"],
            )

    return id_text(docs, **cols).mapInArrow(lean(run), "doc_id long, tag binary, node binary, fp long, bands array<long>")


def whole_sets(texts: DataFrame) -> DataFrame:
    """(num, grams) of rows (num, text): the shingle hashes of the texts, once for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nums, part in doc_slices(batches):
            made = [gram_hashes(t).view(np.int64) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(nums, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["num", "grams"])

    return texts.select("num", "text").mapInArrow(lean(run), "num long, grams array<long>").dropDuplicates(["num"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) of pairs (a, b), counted on the whole shingle sets."""
    met = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return met.select("a", "b", F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("common"))


def alike(least: float) -> F.Column:
    return F.col("common") >= F.lit(least) * (F.col("n_a") + F.col("n_b") - F.col("common"))


def sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (doc_id, tag, ...) with `maybe`, false only where no key (doc_id, tag) is theirs, so that the others needn't be
    shuffled to meet the keys. The keys' hashes set bits in SIEVE places, whose words are broadcast: SIEVE / 64 rows of two
    longs at most, whatever the keys' number. With very many keys more rows are in doubt, and none is lost."""
    spot = F.xxhash64("doc_id", "tag").bitwiseAND(F.lit(SIEVE - 1))
    word, bit = F.shiftright(spot, 6), spot.bitwiseAND(F.lit(63)).cast("int")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_mask")
    words = written(keys.select("doc_id", "tag").groupBy(word.alias("_word")).agg(mask), "sieve")
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return met.withColumn("maybe", F.coalesce(F.getbit("_mask", bit) == 1, F.lit(False))).drop("_word", "_mask")


def rooted(cells: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (cell, num, ...) with the `root` of the number's component."""
    return cells.join(components(links, "a", "b").toDF("num", "root"), "num", "left").withColumn("root", F.coalesce("root", "num"))


def noted(made: list[DataFrame], df: DataFrame, name: str) -> DataFrame:
    made.append(written(df, name))
    return made[-1]


def fingerprint_pairs(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(a, b) of nodes (num, fp): each fingerprint's first node with those of equal fingerprints, and with the first node of the
    least fingerprint within RADIUS bits of it, by the segment tables of `links`. At most two pairs for each node."""
    of = noted(made, nodes.groupBy("fp").agg(F.min("num").alias("first")), "fingerprint-nodes")
    same = nodes.join(of, "fp").where(F.col("num") != F.col("first")).select(F.col("num").alias("a"), F.col("first").alias("b"))
    least = links(of).groupBy("a").agg(F.min("b").alias("b"))
    met = least.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return same.unionByName(met.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_links(nodes: DataFrame, texts: DataFrame, least: float, made: list[DataFrame]) -> DataFrame:
    """(a, b) of nodes (num, one, fp, bands) that connect all nodes with a similarity of `least` or more that share a key; tables written for it are added to `made`.

    SimHash comes first: nodes whose fingerprints lie within RADIUS bits are compared on whole shingle sets, and those alike are linked. At this
    similarity most pairs differ in more bits, so the keys find the rest: the members of a key's cell that SimHash hasn't linked with its
    pivot, the member that shares most keys with others (of a crowd of copies, the text they come from), are compared with it; members that
    are still apart from it with a second one. What is left needs no comparison of all pairs: members with a pivot that one of them isn't
    alike are compared where the rare ends of their sets meet; see `prefixes`. No pair of a cell is lost.
    """
    pairs = noted(made, fingerprint_pairs(nodes, made), "fingerprint-pairs")
    keys = nodes.select("num", F.explode("bands").alias("cell"))
    counts = keys.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = noted(made, keys.join(counts, "cell"), "cells")
    degree = shared.groupBy("num").agg(F.sum("n").alias("degree"))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("num"))
    some = nodes.join(degree.select("num").unionByName(paired).distinct(), "num").select("num", "one")
    tagged = texts.withColumn("tag", F.unhex(F.md5(F.col("text").cast("binary"))))
    tagged = sifted(tagged, some.select("one.doc_id", "one.tag")).where("maybe")
    first = tagged["doc_id"].eqNullSafe(some["one"]["doc_id"]) & (tagged["tag"] == some["one"]["tag"])
    sets = noted(made, whole_sets(some.join(tagged, first).select("num", "text")), "shingle-sets")
    prints = noted(made, compared(pairs, sets).where(alike(least)).select("a", "b"), "fingerprint-links")
    cells = noted(made, shared.join(degree, "num").select("cell", "num", "degree"), "cells")
    drop_written(shared)
    best = F.max(F.struct("degree", "num")).alias("p")
    seen = None  # (num, p, n, n_p, common): what members share with pivots
    now = noted(made, rooted(cells, prints), "rooted")
    for k in range(PIVOTS):
        if k:
            now = noted(made, rooted(cells, noted(made, seen.where(alike(least)).select("a", "b").unionByName(prints), "links")), "rooted")
            first_root = now.join(pivots, "cell").where(F.col("num") == F.col("pivot")).select("cell", F.col("root").alias("taken"))
            apart = now.join(first_root, "cell").where("root <> taken")
            pivots = apart.groupBy("cell").agg(best).select("cell", F.col("p.num").alias("pivot"))
        else:
            pivots = noted(made, cells.groupBy("cell").agg(best).select("cell", F.col("p.num").alias("pivot")), "pivots")
            first_pivots = pivots
        roots = now.join(pivots, "cell").where(F.col("num") == F.col("pivot")).select("cell", F.col("root").alias("taken"))
        met = now.join(pivots, "cell").join(roots, "cell").where("root <> taken")
        found = compared(met.select(F.col("num").alias("a"), F.col("pivot").alias("b")).distinct(), sets)
        found = noted(made, found, "compared")
        seen = found if seen is None else seen.unionByName(found)
        first_seen = found if k == 0 else first_seen
    linked = noted(made, seen.where(alike(least)).select("a", "b").unionByName(prints), "links")
    return linked.unionByName(compared(left_pairs(rooted(cells, linked), first_pivots, first_seen, sets, least, made), sets).where(alike(least)).select("a", "b"))


def prefixes(sets: DataFrame, least: float, places: int = RANK_PLACES) -> DataFrame:
    """(num, prefix) of sets (num, grams): the n - ceil(least * n) + 1 grams of a set that come first in one order of all grams,
    rare ones before frequent ones. Two sets of a similarity of `least` or more have a gram in both prefixes, whatever the
    order; how often grams occur is counted in `places` places, which alone are gathered."""
    place = F.col("gram").bitwiseAND(F.lit(places - 1)).alias("place")
    counted = sets.select(F.explode("grams").alias("gram")).groupBy(place).agg(F.count("*").alias("n")).collect()  # `places` rows at most
    often = np.zeros(places, dtype=np.int64)
    for place, n in counted:
        often[place] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grams in batch.column(1):
                grams = grams.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((grams, often[grams & (places - 1)]))
                out.append(grams[order[: len(grams) - int(np.ceil(least * len(grams) - 1e-9)) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["num", "prefix"])

    return sets.select("num", "grams").mapInArrow(lean(run), "num long, prefix array<long>")


def left_pairs(now: DataFrame, pivots: DataFrame, seen: DataFrame, sets: DataFrame, least: float, made: list[DataFrame]) -> DataFrame:
    """The pairs (a, b), of different roots and one pivot, that may still be alike; see `near_links`."""
    open_ = now.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    member = now.join(open_, "cell").join(pivots, "cell").select(F.col("pivot").alias("p"), "num", "root").distinct()
    facts = seen.select(F.col("a").alias("num"), F.col("b").alias("p"), alike(least).alias("near"))
    # a member that wasn't compared with the pivot is linked with it by fingerprints; pivots themselves have met all
    member = member.where("num <> p").join(facts, ["num", "p"], "left").withColumn("near", F.coalesce("near", F.lit(True)))
    member = noted(made, member, "open-members")
    mine = sets.join(member.select("num").distinct(), "num", "left_semi")
    first = noted(made, prefixes(mine, least).join(mine.select("num", F.size("grams").alias("n")), "num"), "prefixes")
    side = member.join(first, "num").select("p", "num", "root", "near", "n", F.posexplode("prefix").alias("at", "gram"))
    mine = side.where("not near").select("p", "gram", F.col("num").alias("s"), F.col("root").alias("r"), F.col("n").alias("n_s"), (F.col("n") - F.col("at")).alias("left_s"))
    others = side.select("p", "gram", F.col("num").alias("x"), F.col("root").alias("rx"), F.col("n").alias("n_x"), (F.col("n") - F.col("at")).alias("left_x"))
    # the first gram in common leaves so many at most to share
    enough = F.least("left_s", "left_x") >= F.lit(least / (1 + least)) * (F.col("n_s") + F.col("n_x")) - 1e-6
    met = mine.join(others, ["p", "gram"]).where((F.col("r") != F.col("rx")) & enough)
    return met.select(F.greatest("s", "x").alias("a"), F.least("s", "x").alias("b")).distinct()


def first_of_groups(docs: DataFrame, least: float = NEAR, id_col: str = "doc_id", made: list[DataFrame] | None = None, **cols: str) -> DataFrame:
    """(doc_id, tag, component_id, component_tag): groups of exact and near copies, linked by a Jaccard similarity of `least` or
    more of their five-word shingles; texts without words are alike. `tag` is the MD5 of the text, so that (doc_id, tag) names a
    row among others of its id; the group's first row is its least (doc_id, tag), a null id last.
    Tables that the result still reads are added to `made`."""
    made = [] if made is None else made
    signed = noted(made, set_signatures(docs, id_col=id_col, **cols), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    nodes = signed.groupBy("node").agg(first.alias("one"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("num", F.monotonically_increasing_id())
    nodes = noted(made, nodes, "nodes")
    named = rooted(nodes.select("num", "node", "one"), near_links(nodes, id_text(docs, id_col=id_col, **cols), least, made))
    ids = named.groupBy("root").agg(F.min("one").alias("one"))
    names = named.select("node", "root").join(ids, "root").select("node", F.col("one.doc_id").alias("component_id"), F.col("one.tag").alias("component_tag"))
    return signed.select("doc_id", "tag", "node").join(names, "node").select("doc_id", "tag", "component_id", "component_tag")


def keep_first_of_groups(docs: DataFrame, least: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of `first_of_groups`, with all its columns.

    Rows are told apart by id and text: another text of a shared id stays if it is no copy of an earlier one, and of rows that
    repeat both, which may differ in other columns, any one stays. Columns of any names pass through."""
    made: list[DataFrame] = []
    found = first_of_groups(docs, least, id_col, made, text_col=text_col)
    mine = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tag") == F.col("component_tag"))
    sums = written(found.groupBy("doc_id", "tag").agg(F.min(mine).alias("first"), F.count("*").alias("n")), "row-sums")
    marked = written(sums.where("not first or n > 1").select("doc_id", "tag", "first"), "marked-rows")
    drop_written(sums, *made)  # only the marks are read from here on
    # the row's own columns in one struct, whatever their names
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    keyed = whole.select(
        F.col("row").getField(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).cast("binary"))).alias("tag"), "row"
    )
    sieved = sifted(keyed, marked)
    doubt = sieved.where("maybe").select("doc_id", "tag", "row")
    on = lambda t: doubt["doc_id"].eqNullSafe(t["doc_id"]) & (doubt["tag"] == t["tag"])
    alone = doubt.join(marked, on(marked), "left_anti").select("row")
    again = marked.where("first")
    one_each = doubt.join(again, on(again), "left_semi").groupBy("doc_id", "tag").agg(F.first("row").alias("row")).select("row")
    return sieved.where("not maybe").select("row").unionByName(alone).unionByName(one_each).select("row.*")


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
