"""Packing token pieces into training windows by non-negative least squares.

Documents are tokenized once and cut at multiples of the window; only lengths matter from there on. The
driver sees the histogram of piece lengths (at most one row for each length up to the window).
Shallow combinations of two or three lengths that fill a window are enumerated; their repeat counts solve
``min |A x - h|, x >= 0`` against the histogram. The counts are rounded down, and what is left is
packed greedily, largest length first, again as repeated patterns. The plan is a table of (length, ranks of pieces) ->
(sequence, offset) whose size depends on the window only; pieces find their place by their number
among the pieces of the same length.
"""

from __future__ import annotations

import codecs
import os
import struct
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import chunked, number_within, texts_of
from replyloom.runtime import materialize

#: Words whose tokens a task remembers at most: those since it last forgot, and as many from before.
CACHE_WORDS = 500_000
#: Closing marks that are coded apart from the word before them.
MARKS = b".,;:!?*#%$&\")"
#: Most frequent lengths from which combinations of three are drawn, and rounds of the solver.
TRIPLE_LENGTHS, ROUNDS = 160, 300


#: How byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)} | {32: " "}
SPELLING = "".join(BYTE_LETTERS.get(b, chr(b)) for b in range(256))


def _plain(word: str) -> bool:
    """Whether the word is letters only, composed and in lower case already."""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and word == word.lower()))


def _ends_in_letter(word: str) -> bool:
    """Whether the word ends in a letter in the form that the tokenizer sees (``İ`` becomes a letter and a mark)."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class _WordTokens(dict):
    """Lower-cased word -> its token ids, little-endian. White space never lies inside a token and A-Z count as
    lower case, so a text's ids are those of its words in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges without the steps that a word in lower-case letters does not need.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.before: dict[bytes, bytes] = {}
        # Words that spell a special token are looked up whole, as they stand.
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())

    def _encode(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of lower-case letters are one unit each, so many go through at once and are parted at word ends."""
        out: list[bytes] = []
        parts = [words[s : s + 256] for s in range(0, len(words), 256)]
        lines = [b" ".join(p) for p in parts]
        spelt = [x.decode() if x.isascii() else codecs.charmap_decode(x, "strict", SPELLING)[0] for x in lines]
        for part, e in zip(parts, self.merges.encode_batch_fast(spelt, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(part):
                data = ids.tobytes()
                out.extend(data[i:j] for i, j in zip([0, *cut], cut))
            else:
                out.extend(self._encode([w.decode() for w in part]))
        return out

    def learn(self, words: set[bytes]) -> None:
        """Make sure of all ``words``; what was not asked for lately is forgotten when there are too many."""
        new = words - self.keys()
        if len(self) + 2 * len(new) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
            new = words
        if self.before:
            held = new & self.before.keys()
            self.update((w, self.before[w]) for w in held)
            new = new - held
        # A word's closing marks are units of their own where a letter stands before them.
        parted: list[tuple[bytes, bytes, bytes]] = []
        letters: set[bytes] = set()
        rest: dict[bytes, str] = {}
        for w in new:
            if w.isalpha() and w.islower():
                letters.add(w)
                continue
            core = w.rstrip(MARKS)
            if core != w and core:
                tail = w[len(core) :]
                if core.isalpha() and core.islower():
                    parted.append((w, core, tail))
                    letters.add(core)
                    rest[tail] = tail.decode()
                    continue
                text = core.decode("utf-8", "replace")
                if text[-1].isalpha() and _ends_in_letter(text):
                    parted.append((w, core, tail))
                    rest[core], rest[tail] = text, tail.decode()
                    continue
            rest[w] = w.decode("utf-8", "replace")
        letters.update(w for w, t in rest.items() if not w.isascii() and _plain(t) and t.encode() == w)
        some = [w for w in letters if w not in self]
        self.update(zip(some, self._encode_letters(some)))
        others = [w for w in rest if w not in self]
        self.update(zip(others, self._encode([rest[w] for w in others])))
        self.update((w, self[core] + self[tail]) for w, core, tail in parted)

    def words(self, text: bytes) -> list[bytes]:
        if any(t in text for t in self.special):
            return text.split()
        return text.lower().split()


_LOADED: dict[str, _WordTokens] = {}


def _word_tokens(path: str) -> _WordTokens:
    """The tokenizer and what it has learned, kept by a worker from task to task."""
    if path not in _LOADED:
        _LOADED[path] = _WordTokens(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, text: str, doc_id: str, with_ids: bool) -> DataFrame:
    """One row for each piece of at most ``window`` ids of each document."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    end = struct.pack("<I", end_id)

    def work(batches):
        cache = _word_tokens(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, words in chunked(map(cache.words, texts_of(batch.column("_text")))):
                cache.learn(set(chain.from_iterable(words)))
                out: list[list] = [[], [], [], [], [], []]
                for i, w in enumerate(words, first):
                    data = b"".join(map(cache.__getitem__, w)) + end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start : 4 * (start + window)]
                        row = (ids[i], start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None)
                        for held, x in zip(out, row):
                            held.append(x)
                columns = [*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return slim.mapInArrow(
        work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    ).drop(*([] if with_ids else ["ids"]))


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill the window exactly."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    a = lengths[lengths * 2 <= window]
    pairs = a[present[window - a]]
    pairs = np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)
    top = np.sort(lengths[np.argsort(-counts, kind="stable")[:TRIPLE_LENGTHS]])
    x, y = (m.ravel() for m in np.meshgrid(top, top, indexing="ij"))
    z = window - x - y
    good = (x <= y) & (z > 0)
    good[good] = present[z[good]]
    triples = np.sort(np.stack([x[good], y[good], z[good]], axis=1), axis=1)
    return np.unique(np.concatenate([pairs, triples]), axis=0)


def repeat_counts(combos: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Non-negative least squares for the repeats, by multiplicative updates (they keep x >= 0)."""
    used = combos > 0
    target = hist.astype(float)
    x = np.full(len(combos), 1.0)
    goal = (target[combos] * used).sum(axis=1)
    for _ in range(ROUNDS):
        made = np.bincount(combos[used], weights=np.repeat(x, used.sum(axis=1)), minlength=len(hist))
        x *= goal / np.maximum((made[combos] * used).sum(axis=1), 1e-12)
    return x


def plan(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces of it in each sequence, first sequence, offset)."""
    left = np.zeros(window + 1, np.int64)
    left[lengths] = counts
    taken = np.zeros(window + 1, np.int64)
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def place(pattern: list[tuple[int, int]], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in pattern:
            rows.append((length, taken[length], each * repeats, each, sequence, offset))
            taken[length] += each * repeats
            left[length] -= each * repeats
            offset += each * length
        sequence += repeats

    if left[window]:
        place([(window, 1)], int(left[window]))
    some = lengths[lengths < window]
    combos = combinations(some, left[some], window) if len(some) else np.zeros((0, 3), np.int64)
    if len(combos):
        solved = repeat_counts(combos, left)
        for i in np.argsort(-solved, kind="stable"):
            parts, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
            repeats = int(min(np.floor(solved[i]), (left[parts] // each).min()))
            if repeats > 0:
                place(list(zip(parts.tolist(), each.tolist())), repeats)
    while True:
        open_lengths = np.flatnonzero(left)
        if not len(open_lengths):
            break
        pattern, space, upto = [], window, len(open_lengths)
        while space and upto:
            upto = int(np.searchsorted(open_lengths[:upto], space, "right"))
            if not upto:
                break
            upto -= 1
            length = int(open_lengths[upto])
            each = min(int(left[length]), space // length)
            if not pattern:
                each = 1
                upto += left[length] > 1
            else:
                held = dict(pattern)
                each = min(each, int(left[length]) - held.get(length, 0))
            if each <= 0:
                continue
            if pattern and pattern[-1][0] == length:
                pattern[-1] = (length, pattern[-1][1] + each)
            else:
                pattern.append((length, each))
            space -= each * length
        place(pattern, min(int(left[length]) // each for length, each in pattern))
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2,
    text: str = "text", doc_id: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """Place every id of every document into sequences of at most ``window`` ids.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece, and ``ids``
    (little-endian 32-bit) if ``with_ids``. A null or empty text is one piece holding the end id. Repeated rows and null ids
    are packed like others; other columns are dropped. An empty table gives no rows. Sequences shorter
    than the window are left to the reader to pad (none is needed at a power of two).
    """
    pieces = materialize(token_pieces(docs, tokenizer, window, end_id, text, doc_id, with_ids), "pieces")
    hist = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most `window` rows
    order = np.argsort(hist.column("length").to_numpy())
    rows = plan(hist.column("length").to_numpy()[order], hist.column("n").to_numpy()[order], window)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    table = docs.sparkSession.sparkContext.broadcast(rows)  # follows the window, not the corpus

    def assign(batches):
        length, first, _, each, sequence, offset = table.value.T
        starts = (length << 44) | first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, (own << 44) | rank, "right") - 1
            j = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[at] + j // each[at]), pa.array(offset[at] + (j % each[at]) * own)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    numbered = number_within(pieces, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], "_rank")
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.select(*pieces.columns, "_rank").mapInArrow(assign, schema)
