"""Scores of whole texts by a Brown class bigram model.

A token's probability is a class transition times a word emission,
P(class | class of the last known word) x P(word | class), mixed with the
smoothed unigram base. Classes come from exchange clustering (Kneser and Ney,
1993): a word moves to the class that raises the likelihood of the class
bigrams most. The most frequent words (``core``, a documented bound) are
exchanged in turn, over bigram counts of all training texts; every other word of
the training texts then makes the same choice from its neighbours in them, one
group of words per task. Counts, classes, transitions and emissions cover all
training texts and all words.

Texts are encoded once into blocks of a few megabytes: token numbers and the
block's own list of distinct words. Later steps move those lists, grouped by
word hash, and not tokens or text; each word appears once per block, so frequent
words are no hot keys. Only tables bounded by ``core`` and ``classes`` reach the
driver. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; a null doc_id
belongs to the training texts; repeated rows are scored, and learned from, each;
with no training text all tokens are unknown and base and model agree; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import LOWER, mix, pieces, text_bytes, word_hashes, words_in
from docquarry.llm.tables import doc_columns, groups_for, kept

CORE, CLASSES, SWEEPS, BASE_SHARE = 2048, 64, 12, 0.1
END = int(mix(np.array([0xE0D], np.uint64))[0])
STRIPES = 64
BLOCK_BYTES = 4 << 20
_BLOCK = "block long, doc_ids array<long>, train binary, sizes binary, tokens binary, words binary, counts binary"
_RESOLVED = "doc_ids array<long>, train binary, sizes binary, tokens binary, kinds binary, totals binary, moves binary"


def shrunk(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    width = values.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def grown(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 1, F.lit(True))


def _encode(groups: int):
    """Blocks of token numbers; a block's words are in the order of their group and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for table in pieces(batches, size=BLOCK_BYTES):
            data, offsets = text_bytes(table.column("text"))
            data = LOWER[data]
            starts, ends, first = words_in(data, offsets)
            sizes = np.diff(first) + 1
            stops = np.cumsum(sizes) - 1
            tokens = np.full(int(sizes.sum()), END, np.uint64)
            inside = np.ones(len(tokens), bool)
            inside[stops] = False
            tokens[inside] = word_hashes(data, starts, ends)
            words, number = np.unique(tokens, return_inverse=True)
            order = np.argsort(words % np.uint64(groups), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            number = place[number]
            train = table.column("train").to_numpy()
            counts = np.bincount(number, np.repeat(train, sizes), len(words)).astype(np.uint32)
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks())
            blobs = [shrunk(x) for x in (train.astype(np.uint8), sizes.astype(np.int64), number, words[order], counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), ids, *(pa.array([b], pa.binary()) for b in blobs)],
                ["block", "doc_ids", "train", "sizes", "tokens", "words", "counts"])
            block += 1

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _frequent(most: int):
    """Each block's most frequent training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = grown(row["words"], np.uint64), grown(row["counts"], np.uint32)
            top = np.argsort(-counts.astype(np.int64), kind="stable")[:most]
            top = top[counts[top] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(words[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], ["word", "n"])

    return run


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, their predecessors within the document (the end token before the first), and training flags."""
    tokens, sizes = grown(row["tokens"], np.uint32), grown(row["sizes"], np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]  # the token before a document's first is the end token of the last one
    if len(tokens):
        before[0] = tokens[-1]
    return tokens, before, np.repeat(grown(row["train"], np.uint8).astype(bool), sizes)


def _core_numbers(words: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Place of each word in ``core`` (sorted hashes), or -1."""
    if not len(core):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(core, words), len(core) - 1)
    return np.where(core[at] == words, at, -1)


def _core_bigrams(core: np.ndarray):
    width = len(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens, before, train = _pairs(row)
            number = _core_numbers(grown(row["words"], np.uint64), core)
            left, right = number[before[train]], number[tokens[train]]
            both = (left >= 0) & (right >= 0)
            codes, counts = np.unique(left[both] * width + right[both], return_counts=True)
            edges = np.searchsorted(codes // width, np.arange(0, width + STRIPES, STRIPES))
            found = [(i, codes[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[i] for f in found], pa.binary()) for i in (1, 2))], ["stripe", "codes", "n"])

    return run


def _add_stripe(table: pa.Table) -> pa.Table:
    codes = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("codes").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()])
    codes, at = np.unique(codes, return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, n)
    stripe = table.column("stripe")[0].as_py()
    return pa.table({"stripe": pa.array([stripe], pa.int32()), "codes": pa.array([codes.tobytes()]), "n": pa.array([total.tobytes()])})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, words: int, classes: int, fixed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of ``words`` words from bigrams (left, right, n), most frequent word first.

    Word ``fixed`` is alone in class 0. Others start by rank and move, one at a
    time, to the class with the greatest likelihood until a sweep moves none.
    """
    counts = np.zeros((words, words), np.float64)
    counts[left, right] = n
    mass = counts.sum(0) + counts.sum(1)
    order = np.argsort(-mass, kind="stable")
    kind = np.zeros(words, np.int64)
    movable = order[order != fixed]
    kind[movable] = 1 + np.arange(len(movable)) % (classes - 1)
    member = np.zeros((words, classes))
    member[np.arange(words), kind] = 1
    to_class, from_class = counts @ member, counts.T @ member  # neighbours of each word, by class
    table = member.T @ to_class
    for _ in range(sweeps):
        moved = 0
        for w in movable:
            k, self_count = kind[w], counts[w, w]
            r, l = to_class[w].copy(), from_class[w].copy()
            r[k] -= self_count
            l[k] -= self_count
            table[k] -= r
            table[:, k] -= l
            table[k, k] -= self_count
            rows, columns = table.sum(1), table.sum(0)
            gain = (_xlogx(table + r) - _xlogx(table)).sum(1) + (_xlogx(table + l[:, None]) - _xlogx(table)).sum(0)
            own = np.diagonal(table)
            gain += _xlogx(own + r + l + self_count) - _xlogx(own + r) - _xlogx(own + l) + _xlogx(own)
            gain -= _xlogx(rows + r.sum() + self_count) - _xlogx(rows) + _xlogx(columns + l.sum() + self_count) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table[best] += r
            table[:, best] += l
            table[best, best] += self_count
            if best != k:
                moved += 1
                kind[w] = best
                column = counts[:, w]
                to_class[:, k] -= column
                to_class[:, best] += column
                row = counts[w]
                from_class[:, k] -= row
                from_class[:, best] += row
        if not moved:
            break
    return kind


def _ask(core: np.ndarray, kind: np.ndarray, classes: int, groups: int):
    """Per block and word group: words, training counts and classes of the core words beside the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = grown(row["words"], np.uint64), grown(row["counts"], np.uint32)
            tokens, before, train = _pairs(row)
            number = _core_numbers(words, core)
            known = np.where(number >= 0, kind[np.maximum(number, 0)] if len(kind) else 0, -1)
            here, prior = tokens[train], before[train]
            after_core = (number[here] < 0) & (number[prior] >= 0)  # the neighbour on the left tells
            before_core = (number[prior] < 0) & (number[here] >= 0)  # the neighbour on the right tells
            owner = np.r_[here[after_core], prior[before_core]]
            sign = np.r_[known[prior[after_core]], classes + known[here[before_core]]].astype(np.uint8)
            order = np.argsort(owner, kind="stable")
            sign, signs = sign[order], np.bincount(owner, minlength=len(words)).astype(np.uint32)
            ends = np.cumsum(signs)
            group = (words % np.uint64(groups)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            stop = np.r_[at[1:], len(words)]
            spans = [(a, b, int(ends[a] - signs[a]), int(ends[b - 1])) for a, b in zip(at, stop)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at].astype(np.int32)), pa.array(np.full(len(at), row["block"], np.int64)),
                 pa.array([words[a:b].tobytes() for a, b, _, _ in spans], pa.binary()), pa.array([shrunk(counts[a:b]) for a, b, _, _ in spans], pa.binary()),
                 pa.array([shrunk(signs[a:b]) for a, b, _, _ in spans], pa.binary()), pa.array([sign[c:d].tobytes() for _, _, c, d in spans], pa.binary())],
                ["bucket", "block", "words", "counts", "signs", "sign"])

    return run


def _answer(core: np.ndarray, kind: np.ndarray, log_moves: np.ndarray, classes: int):
    """Total count and class of every word, for each block that asked; and the group's totals by class (block -1)."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kinds", pa.binary()), ("totals", pa.binary()), ("types", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([grown(x, np.uint32) for x in table.column("counts").to_pylist()])
        signs = np.concatenate([grown(x, np.uint32) for x in table.column("signs").to_pylist()]).astype(np.int64)
        sign = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("sign").to_pylist()])
        totals = np.bincount(at, counts, len(words)).astype(np.int64)
        codes, times = np.unique(np.repeat(at, signs) * (2 * classes) + sign, return_counts=True)
        number = _core_numbers(words, core)
        kinds = np.zeros(len(words), np.uint8)
        for a in range(0, len(words), 1 << 14):  # a bounded part of the word-by-neighbour table at a time
            b = min(a + (1 << 14), len(words))
            lo, hi = np.searchsorted(codes, [a * 2 * classes, b * 2 * classes])
            seen = np.zeros((b - a) * 2 * classes)
            seen[codes[lo:hi] - a * 2 * classes] = times[lo:hi]
            kinds[a:b] = 1 + np.argmax((seen.reshape(b - a, -1) @ log_moves)[:, 1:], axis=1)
        kinds = np.where(number >= 0, kind[np.maximum(number, 0)] if len(kind) else 0, kinds).astype(np.uint8)
        bucket = table.column("bucket")[0].as_py()
        rows, begun = [], 0
        for block, own in zip(table.column("block").to_pylist(), asked):
            mine = at[begun : begun + len(own)]
            begun += len(own)
            rows.append((bucket, block, kinds[mine].tobytes(), shrunk(totals[mine]), None, None))
        types = np.bincount(kinds[totals > 0], minlength=classes)
        rows.append((bucket, -1, b"", b"", types.tolist(), np.bincount(kinds, totals, classes).astype(np.int64).tolist()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)], schema=schema)

    return run


def _resolve(classes: int):
    """Join a block with its answers, and count its class transitions in training texts."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("train", "sizes", "tokens", "kinds", "totals", "moves"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        parts, totals = right.column("kinds").to_pylist(), right.column("totals").to_pylist()
        kinds = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
        sums = np.concatenate([grown(totals[i], np.int64) for i in order]) if order else np.zeros(0, np.int64)
        out = []
        for row in _rows(left.to_batches()):
            tokens, before, train = _pairs(row)
            moves = np.bincount(kinds[before[train]].astype(np.int64) * classes + kinds[tokens[train]], minlength=classes * classes)
            out.append((row["doc_ids"], row["train"], row["sizes"], row["tokens"], kinds.tobytes(), shrunk(sums), shrunk(moves.astype(np.int64))))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(7)], schema=schema)

    return run


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            own = grown(blob, np.int64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["code", "n"])


def _last_known(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For every place the value of the nearest known place at or before it."""
    at = np.where(known, np.arange(len(values)), 0)
    return values[np.maximum.accumulate(at)]


def _score(moves: np.ndarray, types: np.ndarray, tokens_in: np.ndarray, base_share: float):
    classes = len(types)
    n, v = int(tokens_in.sum()), int(types.sum())
    prior = (tokens_in + 0.5) / (n + 0.5 * classes)
    strength = 1.0
    move = (moves + strength * prior) / (moves.sum(1, keepdims=True) + strength)
    unknown = int(np.argmax(types))  # the class that takes words never seen
    room = tokens_in + 0.5 * (types + (np.arange(classes) == unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens, sizes = grown(row["tokens"], np.uint32), grown(row["sizes"], np.int64)
            totals = grown(row["totals"], np.int64)[tokens]
            kinds = np.frombuffer(row["kinds"], np.uint8)[tokens].astype(np.int64)
            known = totals > 0
            kinds[~known] = unknown
            ends = np.cumsum(sizes)
            starts = ends - sizes
            # the class before each token: of the last known word of the document, at its start of the end token
            shifted, usable = np.r_[0, kinds[:-1]], np.r_[True, known[:-1]]
            shifted[starts], usable[starts] = 0, True
            history = _last_known(shifted, usable)
            base = (totals + 0.5) / (n + 0.5 * (v + 1))
            word = np.where(room[kinds] > 0, (totals + 0.5) / np.maximum(room[kinds], 0.5), 0)
            model = (1 - base_share) * move[history, kinds] * word + base_share * base if n else base
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), np.log10(base), np.log10(model))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(grown(row["train"], np.uint8) == 0), pa.array(sizes), pa.array(sums[0]),
                 pa.array(np.full(len(sizes), n, np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / sizes))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score_texts(docs: DataFrame, train: Column | None = None, core: int = CORE, classes: int = CLASSES, base_share: float = BASE_SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    ``train`` tells the texts to learn from (default: crc32 of the doc_id as text, modulo 5, is not 1). Scores are log10 probabilities.
    """
    if not 2 <= classes <= 128:
        raise ValueError("classes must be 2 to 128")
    groups = groups_for(docs)
    texts = doc_columns(docs).withColumn("train", is_training(F.col("doc_id")) if train is None else F.coalesce(train, F.lit(True)))
    blocks = kept(texts.mapInArrow(_encode(groups), _BLOCK), "brown-blocks")

    frequent = blocks.select("words", "counts").mapInArrow(_frequent(2 * core), "word long, n long")
    top = frequent.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(core).collect()
    words = np.sort(np.unique(np.array([r["word"] for r in top] + [np.array([END], np.uint64).view(np.int64)[0]], np.int64).view(np.uint64)))
    stripes = blocks.select("sizes", "train", "tokens", "words").mapInArrow(_core_bigrams(words), "stripe int, codes binary, n binary")
    added = stripes.groupBy("stripe").applyInArrow(_add_stripe, "stripe int, codes binary, n binary").collect()
    codes = np.concatenate([np.frombuffer(r["codes"], np.int64) for r in added] + [np.zeros(0, np.int64)])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in added] + [np.zeros(0, np.int64)])
    kind = exchange(codes // len(words), codes % len(words), n, len(words), classes, int(np.searchsorted(words, np.uint64(END))))

    # a word outside the core chooses by log P(class | left) and log P(right | class)
    table = np.zeros((classes, classes))
    np.add.at(table, (kind[codes // len(words)], kind[codes % len(words)]), n)
    smooth = table + 0.1
    log_moves = np.log(np.concatenate([smooth / smooth.sum(1, keepdims=True), (smooth / smooth.sum(1, keepdims=True)).T]))

    asked = blocks.select("block", "sizes", "train", "tokens", "words", "counts").mapInArrow(
        _ask(words, kind, classes, groups), "bucket int, block long, words binary, counts binary, signs binary, sign binary")
    answers = kept(asked.groupBy("bucket").applyInArrow(
        _answer(words, kind, log_moves, classes), "bucket int, block long, kinds binary, totals binary, types array<long>, tokens array<long>"), "brown-words")
    by_class = answers.filter("block = -1").select(F.posexplode(F.arrays_zip("types", "tokens")).alias("k", "x")).groupBy("k").agg(
        F.sum("x.types").alias("types"), F.sum("x.tokens").alias("tokens")).collect()
    types, held = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in by_class:
        types[r["k"]], held[r["k"]] = r["types"], r["tokens"]

    replies = answers.filter("block >= 0").select("bucket", "block", "kinds", "totals")
    resolved = kept(blocks.select("block", "doc_ids", "train", "sizes", "tokens").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _resolve(classes), _RESOLVED), "brown-resolved")
    moves = np.zeros(classes * classes, np.int64)
    for r in resolved.select("moves").mapInArrow(_moves, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        moves[r["code"]] = r["n"]
    return resolved.drop("moves").mapInArrow(
        _score(moves.reshape(classes, classes), types, held, base_share),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
