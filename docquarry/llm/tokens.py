"""Fast whole-text encoding with a public byte-level BPE vocabulary.

Byte-level BPE encodes each pre-token (a word with its leading space, a run of
digits, ...) on its own. ``Encoder`` finds the pre-tokens of many documents at
once with numpy, looks each distinct one up in a bounded cache, and encodes only
new ones. Texts with characters outside the tables below go through the
``tokenizers`` library whole. The tests compare the ids with that library's.
"""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np

from docquarry.llm.arrays import mix, ranges

# The vocabulary's contractions and the Unicode white space below U+2070.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]

_TABLE = 0x2070
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
MOST_CACHED = 2_000_000


def vocabulary_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _classes() -> np.ndarray:
    """The regex class of each code point that the fast way knows; 0 for all others."""
    kinds = np.zeros(_TABLE, np.uint8)
    for point in [*range(0x250), *range(0x2000, _TABLE)]:
        category = unicodedata.category(chr(point))
        kinds[point] = _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _OTHER if category != "Cn" else 0
    kinds[WHITE_SPACE] = _SPACE
    return kinds


class Encoder:
    """Ids of whole texts; made once per Python worker by ``encoder``."""

    def __init__(self, folder: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
        self.whole.encode_special_tokens = True
        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # one piece per line: the cache asks for pre-tokens only, so no further split is wanted
        self.pieces = tiktoken.Encoding("pre-tokens", pat_str=r"[^\n]+|\n+", mergeable_ranks=ranks, special_tokens={})
        self.id_bytes = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, number in ranks.items():
            self.id_bytes[number] = len(token)
        self.newline = ranks[b"\n"]
        self.kinds = _classes()
        self.values = mix(np.arange(1, _TABLE + 1, dtype=np.uint64))
        self.power = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            for name, x in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                row = np.full(n, x, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def _breaks(self, points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of all documents, by the vocabulary's split rule."""
        n = len(points)
        begin = np.ones(n, bool)
        begin[1:] = kinds[1:] != kinds[:-1]
        edges = offsets[:-1]
        edges = edges[edges < n]
        begin[edges] = True
        final = np.zeros(n, bool)
        final[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        # the last of a run of spaces stands alone or leads the next word
        space = kinds == _SPACE
        lead = np.flatnonzero(space[:-1] & ~space[1:] & ~final[:-1])
        begin[lead] = True
        begin[lead[points[lead] == 32] + 1] = False
        # an apostrophe that starts a pre-token takes a contraction with it
        quotes = np.flatnonzero((points == 39) & begin & ~final)
        quotes = quotes[kinds[quotes + 1] == _LETTER]
        if len(quotes):
            after = np.r_[points, [0, 0]]
            ends = np.r_[final, [True, True]]
            for tail in CONTRACTIONS:
                hit = quotes[after[quotes + 1] == ord(tail[0])]
                if len(tail) == 2:
                    hit = hit[(after[hit + 2] == ord(tail[1])) & ~ends[hit + 1]]
                begin[hit + 1] = False
                stop = hit + 1 + len(tail)
                begin[stop[(stop < n) & ~ends[hit + len(tail)]]] = True
        return np.flatnonzero(begin)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Add the ids of new pre-tokens to the flat store: begins and sizes."""
        ids, sizes = [], np.zeros(len(words), np.int64)
        plain = [i for i, word in enumerate(words) if "\n" not in word]
        if plain:
            found = np.asarray(self.pieces.encode_to_numpy("\n".join([words[i] for i in plain]), disallowed_special=()), np.int64)
            cuts = np.flatnonzero(found == self.newline)
            edges = np.r_[-1, cuts, len(found)]
            sizes[plain] = np.diff(edges) - 1
            ids.append(found[found != self.newline])
        for i in sorted(set(range(len(words))) - set(plain)):
            own = np.asarray(self.whole.encode(words[i], add_special_tokens=False).ids, np.int64)
            sizes[i] = len(own)
            ids.append(own)
        order = plain + sorted(set(range(len(words))) - set(plain))
        begins = np.zeros(len(words), np.int64)
        begins[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(2 * (self.used + total) - self.used, np.int32)]
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        return begins, sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the offsets of each text's ids."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        offsets = np.r_[0, np.cumsum(lengths)]
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[np.minimum(points, _TABLE - 1)]
        kinds[points >= _TABLE] = 0
        odd = np.flatnonzero(np.add.reduceat(np.r_[kinds == 0, False], offsets[:-1]) * (lengths > 0)) if len(points) else []
        if len(odd):
            return self._with_odd(strings, set(map(int, odd)))
        return self._fast(strings, points, kinds, offsets)

    def _with_odd(self, strings: list[str], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with unusual characters by the library, the others by the fast way."""
        usual = [i for i in range(len(strings)) if i not in odd]
        ids, cuts = self.encode([strings[i].encode("utf-8", "surrogatepass") for i in usual])
        parts = dict(zip(usual, np.split(ids, cuts[1:-1]) if usual else []))
        for i in odd:
            parts[i] = np.asarray(self.whole.encode(strings[i], add_special_tokens=False).ids, np.int32)
        ordered = [parts[i] for i in range(len(strings))]
        return np.concatenate(ordered), np.r_[0, np.cumsum([len(p) for p in ordered])]

    def _fast(self, strings: list[str], points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(strings) + 1, np.int64)
        starts = self._breaks(points, kinds, offsets)
        ends = np.r_[starts[1:], len(points)]
        self._powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[points] * self.power[: len(points)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > MOST_CACHED:
            self._clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            text = "".join(strings)
            a, b = starts[example[new]].tolist(), ends[example[new]].tolist()
            begins, sizes = self._learn([text[x:y] for x, y in zip(a, b)])
            self.begins = np.insert(self.begins, at[new], begins)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        begins, sizes = self.begins[at][inverse], self.sizes[at][inverse]
        ids = self.flat[ranges(begins, sizes)]
        totals = np.r_[0, np.cumsum(sizes)]
        return ids, totals[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str) -> Encoder:
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]
