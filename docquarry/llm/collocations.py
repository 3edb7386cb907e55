"""Phrases that occur together more often than their parts: dynamic itemset counting.

Dynamic itemset counting (Brin et al., 1997) does not finish one length before it
starts the next. The texts are dealt to shards that are scanned in a cycle.
Words are counted from the first shard on; once a phrase has been met ``least`` times, longer ones with it
become active: a phrase is counted from the step after both its subphrases (without the last, without the first word)
reached the threshold, in whatever shard that is, for one full cycle. The scan ends when no active phrase is left open, so all counts are
those of the whole corpus.

Texts are encoded once, into blocks of word numbers with the block's own list of
words. A step reads one shard of them, counts windows, and adds up by phrase in one shuffle: a task sends each
bucket of phrases as one packed row per length, a sorted list of the words in it and the phrases, in order, as places in that list, which takes
a few bytes a phrase. Sums are stored in the same form. Which windows are active comes to the tasks as two bitmaps of
bounded size (phrases that reached the threshold, and those of the last cycle); what they let through by chance
is left out exactly later, when a phrase's own first step is known. A phrase that reaches the threshold within a cycle has its share of it in some step
(Savasere et al., 1995), so only such phrases are added up over steps.

Words are told apart by 64-bit hashes of language and word; phrases are exact sequences of those.

Defined results: null texts are empty, a null lang is ``und``; texts without words and empty tables
add nothing; doc_id is not used, so null and repeated ones are counted like others; repeated rows are counted each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.arrays import LOWER, document_of, mix, pieces, text_bytes, word_hashes, words_in
from docquarry.llm.brown import grown, shrunk
from docquarry.llm.tables import kept
from docquarry.session import work_dir

LEAST, LONGEST, SHARDS, BEST = 100, 5, 2, 2000
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26  # of a bitmap: per phrase, at least, at most
_STEP = np.uint64(0xD6E8FEB86659FD93)
BUCKETS, BUCKET_WORDS = 16, 1 << 22  # of phrases, that are added up together: at least so many, one for so many words
HELD = 1 << 21  # phrases that a task adds up before it sends them
_SENT = "bucket int, width int, words binary, places binary, counts binary"
_SENT_TYPE = pa.schema([("bucket", pa.int32()), ("width", pa.int32()), *((name, pa.binary()) for name in ("words", "places", "counts"))])
_STORED = "step int, width int, words binary, places binary, counts binary, heavy binary"
_STORED_TYPE = pa.schema([("step", pa.int32()), ("width", pa.int32()), *((name, pa.binary()) for name in ("words", "places", "counts", "heavy"))])
_BLOCK = "lang string, n long, tokens binary, spelled binary, shard int"

BLANKS = np.zeros(256, bool)
BLANKS[[0x09, 0x20]] = True
ENDS = np.zeros(256, bool)  # of pieces: . , ; : ! ? and line ends
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def _salted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
    """The hashes of language and word."""
    salt = word_hashes(np.frombuffer(lang.encode(), np.uint8), np.array([0]), np.array([len(lang.encode())]))
    return mix(word_hashes(data, starts, ends) ^ (salt * _STEP))


def _block(texts: pa.Array, lang: str) -> tuple[int, np.ndarray, bytes]:
    """Number of words, word numbers from 1 (the most frequent word) with 0 between pieces, and the words, a line each."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = words_in(data, offsets, BLANKS | ENDS)
    _, at, number, counts = np.unique(_salted(data, starts, ends, lang), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # small numbers for frequent words take little space
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, number = at[order], place[number]
    doc, ended = document_of(first), np.concatenate([[0], np.cumsum(ENDS[data])])
    begins = np.zeros(len(starts), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (ended[starts[1:]] > ended[ends[:-1]])
    tokens = np.zeros(len(starts) + int(begins.sum()), np.uint32)
    tokens[np.arange(len(starts)) + np.cumsum(begins)] = number + 1
    raw = data.tobytes()
    spelled = b"\n".join(raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist()))
    return len(starts), tokens, spelled


def _hashes_of(spelled: bytes, lang: str) -> np.ndarray:
    """The hashes of a block's words, from their lines."""
    data = np.frombuffer(spelled, np.uint8)
    ends = np.append(np.flatnonzero(data == 0x0A), len(data))
    return _salted(data, np.append(0, ends[:-1] + 1), ends, lang)


def encoded(docs: DataFrame, shards: int) -> DataFrame:
    """The texts as blocks, one per language and piece of a few megabytes, dealt to shards in turn, a folder each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for table in pieces(batches):
            langs = table.column("lang").combine_chunks()
            for lang in langs.unique().to_pylist():
                chosen = pa.compute.equal(langs, lang)
                n, tokens, spelled = _block(table.filter(chosen).column("text"), lang)
                if n:
                    blobs = [shrunk(tokens), zstandard.ZstdCompressor(level=3).compress(spelled)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([n]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([turn % shards], pa.int32())],
                        ["lang", "n", "tokens", "spelled", "shard"])
            turn += 1

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    path = work_dir(docs.sparkSession, "encoded")
    texts.mapInArrow(run, _BLOCK).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(_BLOCK).parquet(path)


def _hashed(phrases: np.ndarray) -> np.ndarray:
    """One hash per row of word hashes."""
    total = phrases[:, 0]
    for at in range(1, phrases.shape[1]):
        total = mix(total * _STEP + phrases[:, at])
    return total


def _bits_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    return [(hashes >> np.uint64(shift)) & np.uint64(size - 1) for shift in (0, 32)]


class Bitmap:
    """Phrases as two bits each, at both halves of their hash; may say yes by chance, never no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in _bits_of(hashes, len(self.bits) * 64):
            found &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def bitmaps(phrases: DataFrame, since: int, count: int) -> tuple[Bitmap, Bitmap]:
    """The bitmaps of all ``phrases(phrase, step)`` and of those from step ``since`` on; they grow with ``count`` up to
    ``MOST_BITS``, of which at most a quarter as many bytes reach the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_EACH * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recent = batch.column(1).to_numpy() >= since
            for place in _bits_of(_hashes(batch.column(0)), size):
                bits = np.uint64(1) << (place & np.uint64(63))
                late = np.where(recent, bits, np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((place >> np.uint64(6)).astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (bits, late))], ["at", "bits", "late"])

    words = phrases.select("phrase", "step").mapInArrow(run, "at long, bits long, late long")
    words = words.groupBy("at").agg(F.bit_or("bits").alias("bits"), F.bit_or("late").alias("late")).toArrow()
    maps = [np.zeros(size // 64, np.uint64) for _ in range(2)]
    for bits, column in zip(maps, ("bits", "late")):
        bits[words.column("at").to_numpy()] = words.column(column).to_numpy().view(np.uint64)
    return Bitmap(maps[0]), Bitmap(maps[1])


def _rows(phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    width = phrases.shape[1] * 8
    offsets = np.arange(0, width * len(phrases) + 1, width, dtype=np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(phrases).tobytes())]
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(phrases), buffers), pa.array(counts.astype(np.int64))], ["phrase", "n"])


def windows_of(tokens: np.ndarray, words: np.ndarray, reached: Bitmap, recent: Bitmap, longest: int, opening: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of places in ``words``, counts) of one block's active windows, length by length.

    A window is named by its prefix's name and its last word. It is looked at if prefix and suffix reached the
    threshold, and counted if one of them did so in the last cycle.
    """
    distinct = np.arange(len(words), dtype=np.uint32)[:, None]
    if opening:
        yield distinct, np.bincount(tokens, minlength=len(words) + 1)[1:]
    known = np.append(False, reached.holds(words))
    fresh = np.append(False, recent.holds(words)) & known
    # name, whether it reached the threshold and whether lately, for the windows that start at each token
    names, has, late = tokens.astype(np.int64) - 1, known[tokens], fresh[tokens]
    for length in range(2, longest + 1):
        span = len(tokens) - length + 1
        if span <= 0:
            return
        at = np.flatnonzero(has[:span] & has[1 : span + 1])
        if not len(at):
            return
        last = tokens[at + length - 1].astype(np.int64) - 1
        codes, first, inverse = np.unique(names[at] << 32 | last, return_index=True, return_inverse=True)
        active = late[at] | late[at + 1]
        distinct = np.concatenate([distinct[codes >> 32], (codes & 0xFFFFFFFF).astype(np.uint32)[:, None]], axis=1)
        counts = np.bincount(inverse[active], minlength=len(codes))
        chosen = np.flatnonzero(counts)
        if len(chosen):
            yield distinct[chosen], counts[chosen]
        if length < longest:
            hashes = _hashed(words[distinct])
            known = reached.holds(hashes)
            fresh = recent.holds(hashes) & known
            has, late = np.zeros(span, bool), np.zeros(span, bool)
            has[at], late[at] = known[inverse], fresh[inverse]
            names = np.zeros(span, np.int64)
            names[at] = inverse


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # words, phrases of one length as rows of places among them, how often each occurs


def added(parts: list[Counts]) -> Counts:
    """Counts of phrases of one length added up; words and phrases come in order."""
    words = np.unique(np.concatenate([own for own, _, _ in parts]))
    rows = np.concatenate([np.searchsorted(words, own).astype(np.uint32)[places] for own, places, _ in parts])
    counts = np.concatenate([n for _, _, n in parts])
    codes, width = rows[:, 0].astype(np.int64), rows.shape[1]
    for at in range(1, width):
        codes = codes << 32 | rows[:, at].astype(np.int64)
        if at < width - 1:
            codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return words, rows[order[starts]], np.add.reduceat(counts[order], starts)


def packed(words: np.ndarray, places: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """Words and phrases in order, by their differences; exact."""
    steps = places.T.copy()
    steps[0, 1:] = np.diff(places[:, 0])
    return {"words": shrunk(np.diff(words, prepend=np.uint64(0))), "places": shrunk(steps.ravel()), "counts": shrunk(counts.astype(np.int64))}


def unpacked(row: dict) -> Counts:
    places = grown(row["places"], np.uint32).reshape(row["width"], -1).T.copy()
    places[:, 0] = np.cumsum(places[:, 0])
    return np.cumsum(grown(row["words"], np.uint64)), places, grown(row["counts"], np.int64)


def _dealt(held: dict[int, list[Counts]], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task has counted, a packed row per length and bucket of phrases."""
    for width, parts in held.items():
        words, places, counts = added(parts)
        bucket = (_hashed(words[places]) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            used, local = np.unique(places[own], return_inverse=True)
            rows.append({"bucket": int(bucket[own[0]]), "width": width, **packed(words[used], local.reshape(-1, width).astype(np.uint32), counts[own])})
        yield pa.RecordBatch.from_pylist(rows, _SENT_TYPE)


def _counted(blocks: DataFrame, reached: Bitmap, recent: Bitmap, longest: int, opening: bool, buckets: int) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast((reached.bits, recent.bits))  # twice MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [Bitmap(bits) for bits in sent.value]
        held: dict[int, list[Counts]] = {}
        total = 0
        for batch in batches:
            for at in range(batch.num_rows):
                lang, tokens, spelled = (batch.column(c)[at].as_py() for c in ("lang", "tokens", "spelled"))
                words = _hashes_of(zstandard.ZstdDecompressor().decompress(spelled), lang)
                for places, counts in windows_of(grown(tokens, np.uint32), words, *maps, longest, opening):
                    held.setdefault(places.shape[1], []).append((words, places, counts))
                    total += len(places)
                if total >= HELD:
                    yield from _dealt(held, buckets)
                    held, total = {}, 0
        yield from _dealt(held, buckets)

    return blocks.select("lang", "tokens", "spelled").mapInArrow(run, _SENT)


def _summed(share: int, step: int):
    """One bucket of phrases for later steps, a packed row per length, with those counted ``share`` times or more."""

    def run(sent: pa.Table) -> pa.Table:
        held: dict[int, list[Counts]] = {}
        for row in sent.to_pylist():
            held.setdefault(row["width"], []).append(unpacked(row))
        rows = []
        for width, parts in held.items():
            words, places, counts = added(parts)
            rows.append({"step": step, "width": width, **packed(words, places, counts), "heavy": words[places[counts >= share]].tobytes()})
        return pa.Table.from_pylist(rows, _STORED_TYPE)

    return run


def _width(phrase: str | Column) -> Column:
    return F.octet_length(phrase) / 8


def _prefix(phrase: str) -> Column:
    return F.expr(f"substring({phrase}, 1, octet_length({phrase}) - 8)")


def _suffix(phrase: str) -> Column:
    return F.expr(f"substring({phrase}, 9)")


def _with_first_step(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """``rows(phrase)`` that are active at all, with ``opened``: the step after both subphrases reached the threshold, 0 for words."""
    words = rows.filter(_width("phrase") == 1).withColumn("opened", F.lit(0))
    ends = [reached.select(F.col("phrase").alias(f"_{i}"), F.col("step").alias(f"_step{i}")) for i in (0, 1)]
    longer = rows.filter(_width("phrase") > 1).withColumn("_0", _prefix("phrase")).withColumn("_1", _suffix("phrase"))
    longer = longer.join(ends[0], "_0").join(ends[1], "_1").withColumn("opened", F.greatest("_step0", "_step1") + 1)
    return words.unionByName(longer.select(*words.columns))


class _Steps:
    """Rows written step by step below one shared folder, read again as one table of some of the steps."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.path, self.schema = spark, work_dir(spark, label), schema

    def write(self, step: int, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{step}")

    def read(self, first: int, stop: int) -> DataFrame:
        paths = [f"{self.path}/{step}" for step in range(max(0, first), stop)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def _hashes(phrases: pa.Array) -> np.ndarray:
    """The hash of every phrase, whatever its length."""
    out = np.zeros(len(phrases), np.uint64)
    widths = pa.compute.binary_length(phrases).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        own = phrases.take(pa.array(at))  # a new array: its bytes begin with the first phrase
        out[at] = _hashed(np.frombuffer(own.buffers()[2], np.uint64, len(at) * int(width) // 8).reshape(len(at), -1))
    return out


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for width, blob in zip(batch.column("width").to_pylist(), batch.column("heavy").to_pylist()):
            phrases = np.frombuffer(blob, np.uint64).reshape(-1, width)
            yield _rows(phrases, np.zeros(len(phrases))).select(["phrase"])


def _among(stored: DataFrame, phrases: DataFrame, count: int) -> DataFrame:
    """(phrase, n, step) of ``phrases`` in stored counts: a bitmap of bounded size leaves few others, so that the exact join shuffles little."""
    sent = stored.sparkSession.sparkContext.broadcast(bitmaps(phrases.withColumn("step", F.lit(0)), 0, count)[0].bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = Bitmap(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                words, places, counts = unpacked(row)
                found = words[places]
                chosen = some.holds(_hashed(found))
                rows = _rows(found[chosen], counts[chosen])
                yield rows.append_column("step", pa.array(np.full(rows.num_rows, row["step"], np.int32)))

    rows = stored.select("step", "width", "words", "places", "counts").mapInArrow(run, "phrase binary, n long, step int")
    return rows.join(phrases, "phrase", "left_semi")


def phrase_counts(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(phrase binary, n): all phrases of up to ``longest`` words that occur ``least`` times or more in the blocks."""
    spark = blocks.sparkSession
    counts = _Steps(spark, "counts", _STORED)
    met = _Steps(spark, "reached", "phrase binary, step int, opened int")
    sizes: list[int] = []  # phrases below the full length that reached the threshold, by step
    total = step = 0
    buckets = max(BUCKETS, (blocks.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    while step < shards or any(sizes[step - shards :]):
        reached = met.read(0, step)
        maps = bitmaps(reached.filter(_width("phrase") < longest), step - shards, sum(sizes))
        shard = blocks.filter(F.col("shard") == step % shards)
        sent = _counted(shard, *maps, longest, step < shards, buckets)
        counts.write(step, sent.groupBy("bucket").applyInArrow(_summed(-(-least // shards), step), _STORED))
        heavy = counts.read(step - shards + 1, step + 1).select("width", "heavy").mapInArrow(_heavy, "phrase binary")
        # of phrases open in this step, those with their share of the threshold in some step, added up since they are open
        suspects = kept(heavy.distinct().join(reached, "phrase", "left_anti"), f"suspects-{step}")
        window = _among(counts.read(step - shards + 1, step + 1), suspects, suspects.count())
        sums = window.groupBy("phrase").agg(F.collect_list(F.struct("step", "n")).alias("steps"))  # one struct a step
        since = F.aggregate(F.filter("steps", lambda s: s["step"] >= F.col("opened")), F.lit(0).cast("long"), lambda total, s: total + s["n"])
        now = _with_first_step(sums, reached).filter((since >= least) & (F.col("opened") <= step) & (F.col("opened") > step - shards))
        met.write(step, now.select("phrase", F.lit(step).alias("step"), "opened"))
        shorter, every = met.read(step, step + 1).agg(F.count_if(_width("phrase") < longest), F.count("*")).first()
        sizes.append(shorter)
        total += every
        step += 1
    reached = met.read(0, step).select("phrase", "opened")
    whole = _among(counts.read(0, step), reached.select("phrase"), total).join(reached, "phrase")
    whole = whole.filter((F.col("step") >= F.col("opened")) & (F.col("step") < F.col("opened") + shards))
    return kept(whole.groupBy("phrase").agg(F.sum("n").alias("n")), "phrases")


def _spellings(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(word binary, lang, spelling) of all of ``words(word)``, and by chance of a few others."""
    wanted = blocks.sparkSession.sparkContext.broadcast(bitmaps(words.select(F.col("word").alias("phrase"), F.lit(0).alias("step")), 0, words.count())[0].bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, np.uint64)  # a task gives a word once, not once a block
        for batch in batches:
            for at in range(batch.num_rows):
                lang = batch.column("lang")[at].as_py()
                lines = zstandard.ZstdDecompressor().decompress(batch.column("spelled")[at].as_py())
                hashes = _hashes_of(lines, lang)
                chosen = Bitmap(wanted.value).holds(hashes) & ~np.isin(hashes, given)
                given = np.append(given if len(given) < HELD else given[:0], hashes[chosen])
                spelled = pa.array(lines.split(b"\n"), pa.binary())
                words = _rows(hashes[chosen][:, None], np.zeros(int(chosen.sum()))).column(0)
                langs = pa.array([lang] * len(words), pa.string())
                yield pa.RecordBatch.from_arrays([words, langs, spelled.filter(pa.array(chosen)).cast(pa.string())], ["word", "lang", "spelling"])

    return blocks.select("lang", "spelled").mapInArrow(run, "word binary, lang string, spelling string").distinct()


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A phrase's score is the least floor(1000 * a * n / (l * r)) over its cuts in two, where a, l and r count the phrase and its
    parts and n all words. Phrases inside a longer one that occurs as often are left out.
    """
    blocks = encoded(docs, shards)
    counts = phrase_counts(blocks, least, longest, shards)
    phrases = counts.filter(_width("phrase") > 1).withColumnRenamed("n", "a")
    # counts only fall with length, so a longer phrase as frequent means one longer by a word as frequent
    longer = [phrases.filter(_width("phrase") > 2).select(part("phrase").alias("phrase"), "a") for part in (_prefix, _suffix)]
    phrases = kept(phrases.join(longer[0].union(longer[1]).distinct(), ["phrase", "a"], "left_anti"), "candidates")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), (_width("phrase") - 1).cast("int"))))
    cuts = cuts.withColumn("_l", F.expr("substring(phrase, 1, 8 * k)")).withColumn("_r", F.expr("substring(phrase, 8 * k + 1)"))
    cuts = cuts.join(counts.select(F.col("phrase").alias("_l"), F.col("n").alias("l")), "_l").join(
        counts.select(F.col("phrase").alias("_r"), F.col("n").alias("r")), "_r")

    parts = phrases.select("phrase", F.posexplode(F.transform(F.sequence(F.lit(0), (_width("phrase") - 1).cast("int")),
                                                              lambda i: F.substring("phrase", i * 8 + 1, F.lit(8)))).alias("at", "word"))
    spelled = _spellings(blocks, kept(parts.select("word").distinct(), "words"))
    named = parts.join(spelled, "word").groupBy("phrase").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spelling"))), lambda s: s["spelling"]), " ").alias("text"))
    words = blocks.groupBy("lang").agg(F.sum("n").alias("n"))

    # floor(1000 * a * n / (l * r)) in decimals of 38 digits; both products stay below
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(named, "phrase").join(words, "lang").withColumn("score", score)
    lowest = scored.groupBy("phrase", "lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "text")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))
