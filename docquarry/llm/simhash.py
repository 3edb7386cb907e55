"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

``fingerprints`` votes over the word shingles of whole texts. ``links`` finds all
pairs of different fingerprints within a Hamming distance: the 64 bits lie on a
ring of segments, and by the pigeonring principle (Qin and Xiao, 2018) some chain
of consecutive segments keeps every prefix of it within a proportional share of the distance. The first
segment of such a chain agrees, and the second differs in one bit at most: those
two are the join key. The longer prefixes prune before the full check.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; equal fingerprints are one node, so copies are never expanded into
pairs; a null doc_id is grouped last and represents its group only alone;
repeated rows stay repeated; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrays import LOWER, pieces, text_bytes, window_hashes, word_hashes, words_in
from docquarry.llm.brown import grown, shrunk
from docquarry.llm.components import components
from docquarry.llm.tables import doc_columns, kept

WORDS, SEED, DISTANCE = 4, 42, 4
STAGE_WORDS, SIMILARITY = 5, 0.8
SHORT = 192  # texts with fewer shingles are judged by all of them, not by a quarter
QUARTER = np.uint64(1 << 62)
BUCKET_BYTES = 64 << 20  # of text, whose shingles make one bucket
_PIECE = "piece long, doc_ids array<long>, keys array<long>, prints array<long>, sizes array<long>, parts array<struct<bucket:long,keys:binary,owners:binary>>"
_PIECE_TYPE = pa.schema([
    ("piece", pa.int64()), *((name, pa.list_(pa.int64())) for name in ("doc_ids", "keys", "prints", "sizes")),
    ("parts", pa.list_(pa.struct([("bucket", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])))])
VOTES = 1 << 18  # shingles whose bits are counted at a time
SAMPLED, COMMON = 64, 1 << 16  # one document in so many tells which shingles are common; so many of those go to the tasks


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` lower-case words (fewer: of all), joined by one space."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(found, np.uint64, len(parts) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed long."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        part = hashes[at : at + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long) of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            found = [majority(shingle_hashes(text, words, seed)) for text in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, fingerprint long")


def ring(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``distance`` + 1 segments, so that a chain starts with an equal one."""
    count = distance + 1
    edges = [i * 64 // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(bits: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(bits, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _chain_within(difference: Column, segments: list[tuple[int, int]], start: int) -> Column:
    """Whether the chain from ``start`` keeps its first l segments within l shares, for every l."""
    count = len(segments)
    distance = count - 1
    fits = F.lit(True)
    mask = 0
    for length in range(1, count + 1):
        first, width = segments[(start + length - 1) % count]
        mask |= ((1 << width) - 1) << first
        signed = mask - (1 << 64) if mask >> 63 else mask
        fits = fits & (F.bit_count(difference.bitwiseAND(F.lit(signed).cast("long"))) <= length * distance // count)
    return fits


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) with u < v: all pairs of different values of ``prints(fingerprint)`` that differ in ``distance`` bits or fewer.

    One row per fingerprint and chain start goes to the index; one more per bit
    of the second segment asks it. Both have the key (start, first segment,
    second segment), which holds about 26 bits for a distance of 4. If ``prints`` has a
    column ``part``, pairs of one part are left out.
    """
    parts = ["part"] if "part" in prints.columns else []
    if not 1 <= distance <= 15:
        raise ValueError("distance must be 1 to 15")
    segments = ring(distance)
    count = len(segments)
    bits = F.col("fingerprint")

    def keys(flips: bool) -> Column:
        out = []
        for start, at in enumerate(segments):
            after = segments[(start + 1) % count]
            key = F.shiftleft(_segment(bits, at), 32).bitwiseOR(_segment(bits, after)).bitwiseOR(F.lit(start << 58))
            out.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
            if flips and 2 * distance // count >= 1:
                out += [F.struct(F.lit(start).alias("start"), key.bitwiseXOR(F.lit(1 << bit)).alias("key")) for bit in range(after[1])]
        return F.explode(F.array(*out))

    index = prints.select(bits.alias("v"), *parts, keys(False).alias("k")).select("v", *parts, "k.key")
    asks = prints.select(bits.alias("u"), *parts, keys(True).alias("k")).select("u", *parts, "k.start", "k.key")
    difference = F.col("u").bitwiseXOR(F.col("v"))
    # of several chains that fit, the first alone reports the pair
    within, earlier = F.lit(False), F.lit(False)
    for start in range(count):
        fits = _chain_within(difference, segments, start)
        within = within | ((F.col("start") == start) & fits & ~earlier)
        earlier = earlier | fits
    if parts:
        within = within & (F.col("a.part") != F.col("i.part"))
    pairs = asks.alias("a").join(index.alias("i"), (F.col("a.key") == F.col("i.key")) & (F.col("u") < F.col("v")) & within)
    return pairs.select("u", "v")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint long, component_id): the smallest doc_id that links of ``distance`` bits or fewer reach."""
    prints = kept(fingerprints(docs, words, seed), "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    member = components(links(nodes, distance), "simhash-links")
    # the component's smallest fingerprint stands for it; every node knows its own smallest document
    placed = nodes.join(member.select(F.col("u").alias("fingerprint"), "v"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("v", "fingerprint").alias("part"))
    smallest = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "part").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _key_and_shingles(hashes: np.ndarray, words: int) -> tuple[int, np.ndarray]:
    """A hash of all words in order, and the distinct shingle hashes; fewer words than a shingle are one."""
    if not len(hashes):
        return 0, np.zeros(0, np.uint64)
    return int(window_hashes(hashes, len(hashes)).view(np.int64)[0]), np.unique(window_hashes(hashes, min(words, len(hashes))))


def _parts_of(words: int, buckets: int, short: int):
    """One row per piece of texts: their ids, keys, fingerprints and numbers of shingles, and by bucket the shingles they count:
    all of a text with fewer than ``short``, else those in the lowest quarter of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for table in pieces(batches):
            prints = [majority(shingle_hashes(text, WORDS, SEED)) for text in table.column("text").to_pylist()]
            data, offsets = text_bytes(table.column("text"))
            starts, ends, first = words_in(LOWER[data], offsets)
            hashes = word_hashes(LOWER[data], starts, ends)
            keys, sizes, counted, owner = [], [], [], []
            for number, (a, b) in enumerate(zip(first[:-1], first[1:])):
                key, shingles = _key_and_shingles(hashes[a:b], words)
                keys.append(key)
                sizes.append(len(shingles))
                own = shingles if len(shingles) < short else shingles[: np.searchsorted(shingles, QUARTER)]
                counted.append(own)
                owner.append(np.full(len(own), number, np.uint32))
            flat, owner = np.concatenate(counted), np.concatenate(owner)
            bucket = (flat & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.lexsort((flat, bucket))
            flat, owner, bucket = (flat[order] >> np.uint64(32)).astype(np.uint32), owner[order], bucket[order]
            names, cuts = np.unique(bucket, return_index=True)
            cuts = np.append(cuts, len(bucket))
            parts = [{"bucket": int(name), "keys": shrunk(flat[x:y]), "owners": shrunk(owner[x:y])} for name, x, y in zip(names, cuts, cuts[1:])]
            yield pa.RecordBatch.from_pylist([{
                "piece": piece, "doc_ids": table.column("doc_id").to_pylist(), "keys": keys, "prints": prints, "sizes": sizes, "parts": parts}], _PIECE_TYPE)
            piece += 1

    return run


def _unique_counts(table: pa.Table) -> pa.Table:
    """Of one bucket: how many of each text's shingles no other text has, of all counted and of the quarter that every text counts.

    Shingles are compared by 32 of their bits within the bucket; two that agree by chance pass for a shared one.
    """
    rows = [(grown(k, np.uint32), grown(o, np.uint32)) for k, o in zip(table.column("keys").to_pylist(), table.column("owners").to_pylist())]
    _, number, counts = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True, return_counts=True)
    alone = counts[number] == 1
    every, quarter, at = [], [], 0
    for keys, owners in rows:
        own = alone[at : at + len(owners)]
        every.append(shrunk(np.bincount(owners[own]).astype(np.uint32)))
        quarter.append(shrunk(np.bincount(owners[own & (keys < int(QUARTER) >> 32)]).astype(np.uint32)))
        at += len(owners)
    return pa.table([table.column("piece"), pa.array(every, pa.binary()), pa.array(quarter, pa.binary())], names=["piece", "every", "quarter"])


def _suspects(words: int, similarity: float, short: int):
    """(text_key) of one piece's texts whose unique shingles do not rule out a similar text."""

    def run(counts: pa.Table, piece: pa.Table) -> pa.Table:
        sizes, keys = (np.array(piece.column(c)[0].as_py(), np.int64) for c in ("sizes", "keys"))
        alone = {name: np.zeros(len(sizes), np.int64) for name in ("every", "quarter")}
        for name, total in alone.items():
            for blob in counts.column(name).to_pylist():
                some = grown(blob, np.uint32)
                total[: len(some)] += some
        alone = np.where(sizes < similarity * short, alone["every"], alone["quarter"])
        most = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64)  # a similar text may lack so many
        return pa.table([pa.array(keys[(alone <= most) & (sizes > 0)])], names=["text_key"])

    return run


def possible(parts: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY, short: int = SHORT) -> DataFrame:
    """(text_key) of all texts that can have a similar one, from ``_parts_of``; most texts are ruled out here, by counts alone.

    Two similar sets share ``similarity`` of each, so a text with more shingles of its own than 1 - ``similarity`` of them has no similar one.
    Texts below ``similarity * short`` shingles are judged by all of theirs, and all texts that may be similar to those
    count all of theirs; others are judged by a fixed quarter of all shingles, of which every text counts its own.
    """
    counted = parts.select("piece", F.inline("parts")).groupBy("bucket").applyInArrow(_unique_counts, "piece long, every binary, quarter binary")
    found = counted.groupBy("piece").cogroup(parts.select("piece", "keys", "sizes").groupBy("piece")).applyInArrow(
        lambda a, b: _suspects(words, similarity, short)(a, b), "text_key long")
    return found.distinct()


def _shingle_sets(words: int):
    """(text_key, shingles): the distinct shingle hashes of each row; fewer words than a shingle are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            data, offsets = text_bytes(table.column("text"))
            data = LOWER[data]
            starts, ends, first = words_in(data, offsets)
            hashes = word_hashes(data, starts, ends)
            found = [_key_and_shingles(hashes[a:b], words) for a, b in zip(first[:-1], first[1:])]
            keys, sets = [key for key, _ in found], [shingles.view(np.int64) for _, shingles in found]
            ends_of = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["text_key", "shingles"])

    return run


def _prefixes(words: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """(text_key, size, place, rank, shingle): the first shingles of each row by rarity and hash, one more than may be missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shingle_sets(words)(batches):
            keys, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            owner, sizes, places, ranks, shingles = [], [], [], [], []
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                own, size = flat[a:b], b - a
                rank = np.zeros(size, np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, counts[at], 0).astype(np.int32)
                first = np.lexsort((own, rank))[: size - int(np.ceil(similarity * size - 1e-9)) + 1]
                owner.append(np.full(len(first), i))
                sizes.append(np.full(len(first), size, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                ranks.append(rank[first])
                shingles.append(own[first])
            if owner:
                columns = [keys[np.concatenate(owner)], *map(np.concatenate, (sizes, places, ranks, shingles))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["text_key", "size", "place", "rank", "shingle"])

    return run


def _buckets(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(shingle, text_key, size, place): texts that share a shingle of their prefixes.

    In any one order of all shingles, two sets with a Jaccard similarity of ``similarity`` or more share one of the
    first n - ceil(similarity * n) + 1 of each. Here rare shingles come first, by the counts of a sample, which only
    decide the order. Of shingles with the same texts the first one is kept.
    """
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(_shingle_sets(words), "text_key long, shingles array<long>")
    often = sample.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    top = often.orderBy(F.desc("n"), "shingle").limit(COMMON).orderBy("shingle").toPandas()  # COMMON rows at most
    rows = texts.mapInArrow(
        _prefixes(words, similarity, top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64)),
        "text_key long, size int, place int, rank int, shingle long")
    of_shingle = Window.partitionBy("shingle")
    shared = rows.withColumn("least", F.min("text_key").over(of_shingle)).withColumn("most", F.max("text_key").over(of_shingle))
    shared = kept(shared.filter("least <> most").drop("least", "most").distinct(), "buckets")
    members = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("text_key", F.lit(salt))).alias(f"x{salt}") for salt in (0, 1))]
    firsts = shared.groupBy("shingle").agg(F.min("rank").alias("rank"), *members)
    firsts = firsts.groupBy("n", "x0", "x1").agg(F.min(F.struct("rank", "shingle")).alias("first")).select("first.shingle")
    return kept(shared.join(firsts, "shingle", "left_semi").drop("rank"), "buckets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of text keys whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    a = sets.select(F.col("text_key").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("text_key").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(a, "u").join(b, "v").withColumn("common", common)
    return joined.filter(F.col("common") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("common")) - 1e-9).select("u", "v")


def _labelled(keys: DataFrame, parts: DataFrame, name: str, part: str) -> DataFrame:
    """``keys`` with the part of their column ``name``; a text that nothing has joined is its own."""
    own = parts.select(F.col("u").alias(name), F.col("v").alias("_joined"))
    return keys.join(own, name, "left").withColumn(part, F.coalesce("_joined", name)).drop("_joined")


def _similar_links(texts: DataFrame, parts: DataFrame, words: int, similarity: float) -> list[DataFrame]:
    """Tables (u, v) of similar texts that, with ``parts``, connect all pairs of ``similarity`` or more.

    Rounds go over the buckets of ``_buckets``. In each, the first texts of a bucket (one, then four times as many each round) are
    compared with all others in it that are not joined with them, and leave it. Buckets of one part are done, so
    that a group of many near copies is not paired with itself, and no pair of different parts is left out.
    """
    rows = _buckets(texts, words, similarity)
    involved = rows.select("text_key").distinct()
    sets = texts.mapInArrow(_shingle_sets(words), "text_key long, shingles array<long>").join(involved, "text_key", "left_semi")
    sets = kept(sets.dropDuplicates(["text_key"]), "shingle-sets")
    of_shingle = Window.partitionBy("shingle")
    found: list[DataFrame] = []
    heads = 1
    while True:
        known = _labelled(rows, parts, "text_key", "part")
        known = known.withColumn("least", F.min("part").over(of_shingle)).withColumn("most", F.max("part").over(of_shingle)).filter("least <> most")
        ranked = kept(known.withColumn("number", F.row_number().over(of_shingle.orderBy("text_key"))).drop("least", "most"), "ranked")
        if ranked.isEmpty():
            return found
        # what two texts can have in common, from their first common shingle on
        within = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
        enough = within * (1 + similarity) >= similarity * (F.col("a.size") + F.col("b.size")) - 1e-6
        pairs = ranked.filter(F.col("number") <= heads).alias("a").join(
            ranked.alias("b"),
            (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.number") < F.col("b.number")) & (F.col("a.part") != F.col("b.part")) & enough)
        pairs = kept(pairs.select(F.col("a.text_key").alias("u"), F.col("b.text_key").alias("v")).distinct(), "candidates")
        found.append(kept(_alike(pairs, sets, similarity), "alike"))
        parts = components(reduce(DataFrame.union, found, parts), "parts")
        rows = ranked.filter(F.col("number") > heads).select("shingle", "text_key", "size", "place")
        heads *= 4


def similar_groups(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row that has a doc_id: groups of texts whose sets of
    ``words``-word shingles are similar, together with those that ``near_duplicates`` links.

    At a similarity of 0.8 a SimHash over five-word shingles differs in too many bits for a selective
    search, as each changed word changes five of them. Similar texts come from an exact search by shingles instead: counts of
    unique shingles first rule out most texts (``possible``), the others are searched by prefixes. It passes by what the fingerprints have joined.
    """
    texts = doc_columns(docs).filter("doc_id IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    parts_of = kept(texts.mapInArrow(_parts_of(words, buckets, SHORT), _PIECE), "parts-of-texts")
    rows = F.arrays_zip("doc_ids", "keys", "prints")
    known = parts_of.select(F.explode(rows).alias("r")).select(F.col("r.doc_ids").alias("doc_id"), F.col("r.keys").alias("text_key"), F.col("r.prints").alias("fingerprint"))
    known = kept(known, "text-keys")
    nodes = known.groupBy("text_key").agg(F.min("doc_id").alias("least"))

    # what the fingerprints over word runs link belongs together as well
    prints = known.select("text_key", "fingerprint").distinct()
    heads = kept(prints.groupBy("fingerprint").agg(F.min("text_key").alias("head")), "heads")
    members = prints.join(heads, "fingerprint").filter("text_key <> head").select(F.col("head").alias("u"), F.col("text_key").alias("v"))
    left, right = (heads.select(F.col("fingerprint").alias(c), F.col("head").alias(h)) for c, h in (("u", "a"), ("v", "b")))
    linked = links(heads.select("fingerprint")).join(left, "u").join(right, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    parts = components(members.union(linked), "parts")

    # one document of each text that can have a similar one; a row with its doc_id may have another text, which does no harm
    suspects = kept(nodes.join(possible(parts_of, words, similarity, SHORT), "text_key").select(F.col("least").alias("doc_id")).distinct(), "suspects")
    chosen = kept(texts.join(suspects, "doc_id", "left_semi"), "suspect-texts")
    exact = _similar_links(chosen, parts, words, similarity)
    member = components(reduce(DataFrame.union, exact, parts), "groups")
    grouped = _labelled(known.select("doc_id", "text_key"), member, "text_key", "part")
    smallest = grouped.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(smallest, "part").select("doc_id", "component_id")


def first_of_group(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of ``similar_groups`` stays: the one with the smallest doc_id.

    Of several rows with that doc_id all stay; rows without a doc_id stay.
    """
    groups = similar_groups(docs, **options)
    lost = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
