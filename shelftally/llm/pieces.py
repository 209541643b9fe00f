"""
SentencePiece BPE, encoded by vectorised merge rounds.

Texts are flat arrays of symbols. They are divided into words where no piece can cross, equal
words are merged once, and every round merges in all words at the same time: the best pair of
each word, at its leftmost places, until no word has a pair left. A long word whose merges
have to go one at a time leaves the rounds for a queue of its pairs. The model file only
supplies pieces and scores; neither encoding nor decoding calls the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE_MARK = "▁"
_MARK = ord(SPACE_MARK)
_NONE = np.iinfo(np.int64).max
_MISSING = "�".encode()


class Pieces:
    """The tables of a BPE model with byte fallback, read from a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self._check(model)
        self._asked: dict[int, tuple[int, int]] = {}
        kinds = proto.ModelProto.SentencePiece
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        usable = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        #: The id of each byte.
        self.byte_ids = np.zeros(256, np.int64)
        shown: list[bytes] = []
        self.is_byte = np.zeros(len(model.pieces), bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value], self.is_byte[i] = i, True
                shown.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                shown.append(p.piece.replace(SPACE_MARK, " ").encode())
            else:  # control pieces are not shown; the unknown piece has a surface of its own
                shown.append(model.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.shown, self.shown_at = _joined(shown)
        self.digits, self.digits_at = _joined([b"%d," % i for i in range(len(model.pieces))])
        #: The id of each code point that is a piece, else its negative, less one.
        self.by_char = -np.arange(0x110000, dtype=np.int64) - 1
        for piece, i in usable.items():
            if len(piece) == 1:
                self.by_char[ord(piece)] = i
        #: Code points that some longer piece holds; any other stands alone.
        self.joins = np.zeros(0x110000, bool)
        for piece in usable:
            if len(piece) > 1:
                self.joins[[ord(c) for c in piece]] = True
        self._pairs(model, usable)

    def _check(self, model) -> None:
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        if not (plain and spec.escape_whitespaces and model.trainer_spec.byte_fallback and model.trainer_spec.model_type == 2):
            raise ValueError("needs a BPE model with byte fallback and the identity normaliser")
        if kinds - {1, 2, 3, 6} or any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in model.pieces):
            raise ValueError("needs a model without user-defined pieces, and with white space only at the start of a piece")

    def _pairs(self, model, usable: dict[str, int]) -> None:
        """Every pair of pieces that makes a piece, by key; its rank is equal where scores are."""
        levels = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in usable.values()}, reverse=True))}
        rank = {piece: levels[model.pieces[i].score] for piece, i in usable.items()}
        n, keys, made = len(model.pieces), [], []
        hurried = np.zeros(n, bool)
        for piece, i in usable.items():
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                # a part need not be a piece of its own to be a single symbol
                a = usable.get(left, self.by_char[ord(left)] if len(left) == 1 else None)
                b = usable.get(right, self.by_char[ord(right)] if len(right) == 1 else None)
                if a is None or b is None or a < 0 or b < 0:
                    continue
                keys.append(a * n + b)
                made.append(i)
                for part in (left, right):
                    if len(part) > 1 and rank[piece] <= rank[part]:
                        hurried[usable[part]] = True
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.size = n
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_made = np.array(made, np.int64)[order]
        self.pair_rank = np.array([rank[model.pieces[i].piece] for i in self.pair_made], np.int64)
        #: Pieces that can at once be part of a pair no worse than themselves: these are merged
        #: one at a time, so that the better pair goes first.
        self.hurried = hurried
        # all code points of pieces must be symbols for the pairs to be complete
        missing = [p for p in usable if len(p) > 1 and any(self.by_char[ord(c)] < 0 for c in p)]
        if missing:
            raise ValueError(f"pieces with characters that are no pieces: {missing[:5]} and {max(0, len(missing) - 5)} more")

    def pair(self, left: int, right: int) -> tuple[int, int]:
        """``pairs`` of one pair; the pairs that were asked for are remembered."""
        key = left * self.size + right
        if key not in self._asked:
            if len(self._asked) >= MOST_ASKED:
                self._asked.clear()
            at = min(int(np.searchsorted(self.pair_keys, key)), len(self.pair_keys) - 1)
            found = self.pair_keys[at] == key
            self._asked[key] = (int(self.pair_rank[at]), int(self.pair_made[at])) if found else (int(_NONE), -1)
        return self._asked[key]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the largest number where it makes no piece), and the piece it makes."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_rank[at], _NONE), np.where(found, self.pair_made[at], -1)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


#: Pairs whose look-up a worker remembers.
MOST_ASKED = 500_000
#: Symbols of a word above which merges that have to go one at a time leave the rounds.
LONG = 64


def merge_in_order(model: Pieces, symbols: np.ndarray) -> np.ndarray:
    """Merge one word, the best pair first and of equal ones the leftmost, by a queue of pairs.

    What rounds do in a time that grows with the square of the word where every round may
    merge but one pair: a long run of spaces or dashes, or words without white space.
    """
    rank, made = (a.tolist() for a in model.pairs(symbols[:-1], symbols[1:]))
    queue = [(r, i, m) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if m >= 0]
    heapify(queue)
    now, n = symbols.tolist(), len(symbols)
    #: The piece that the pair at a place makes; entries of the queue that say otherwise are old.
    making = [*made, -1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def look(left: int) -> None:
        right = after[left]
        making[left] = -1
        if right < n and now[left] >= 0 and now[right] >= 0:
            r, m = model.pair(now[left], now[right])
            if m >= 0:
                making[left] = m
                heappush(queue, (r, left, m))

    while queue:
        _, i, m = heappop(queue)
        if making[i] != m:
            continue
        gone = after[i]
        now[i], making[gone] = m, -1
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        now[gone] = None
        look(i)
        if before[i] >= 0:
            look(before[i])
    return np.array([s for s in now if s is not None], symbols.dtype)


def merge_words(model: Pieces, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair remains. ``word`` numbers the word of each symbol, ascending."""
    done_symbols, done_words = [], []
    n = len(symbols)
    rank, made = np.full(n, _NONE), np.full(n, -1, np.int64)
    inner = np.flatnonzero(word[:-1] == word[1:]) if n else np.zeros(0, np.int64)
    rank[inner], made[inner] = model.pairs(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        best = np.minimum.reduceat(rank, starts)
        open_words = best != _NONE
        if not open_words.all():  # words without a pair are finished
            going = np.repeat(open_words, sizes)
            done_symbols.append(symbols[~going])
            done_words.append(word[~going])
            symbols, word, rank, made = symbols[going], word[going], rank[going], made[going]
            if not len(symbols):
                break
            sizes, best = sizes[open_words], best[open_words]
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # of touching pairs every other one, from the left
        fresh = np.r_[True, (at[1:] != at[:-1] + 1)]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        keep = place % 2 == 0
        # where a merge may open a better pair, or pairs of one rank differ, only the leftmost goes
        alone = model.hurried[made[at]]
        alone[1:] |= ~first[1:] & (made[at[1:]] != made[at[:-1]])
        if alone.any():
            group = np.cumsum(first) - 1
            single = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(single, group[alone], True)
            long = single & (sizes > LONG)
            if long.any():
                ends = np.cumsum(sizes)
                for begin, end in zip((ends - sizes)[long], ends[long], strict=True):
                    merged = merge_in_order(model, symbols[begin:end])
                    done_symbols.append(merged)
                    done_words.append(np.full(len(merged), word[begin]))
                short = np.repeat(~long, sizes)
                symbols, word, rank, made = symbols[short], word[short], rank[short], made[short]
                continue
            keep = np.where(single[group], first, keep)
        at = at[keep]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        moved = np.cumsum(stay) - 1
        symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        at = moved[at]
        changed = np.unique(np.concatenate([at, at - 1]))
        changed = changed[changed >= 0]
        last = changed == len(symbols) - 1
        rank[changed[last]] = _NONE
        changed = changed[~last]
        within = word[changed] == word[changed + 1]
        rank[changed[~within]] = _NONE
        changed = changed[within]
        rank[changed], made[changed] = model.pairs(symbols[changed], symbols[changed + 1])
    symbols = np.concatenate([*done_symbols, symbols]) if done_symbols else symbols
    word = np.concatenate([*done_words, word]) if done_words else word
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def encode(model: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts end to end, and offsets of the texts."""
    marked = [SPACE_MARK + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    # words begin with a text, with white space after anything else, and around lone characters
    alone = ~model.joins[points]
    begins = alone.copy()
    begins[1:] |= alone[:-1] | ((points[1:] == _MARK) & (points[:-1] != _MARK))
    begins[np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]] = True
    starts = np.flatnonzero(begins)
    stops = np.r_[starts[1:], len(points)]
    _, first, which = np.unique(common.span_hashes(points, starts, stops), return_index=True, return_inverse=True)
    sizes = stops[first] - starts[first]
    symbols = model.by_char[points[common.ragged(starts[first], sizes)]]
    symbols, word = merge_words(model, symbols, np.repeat(np.arange(len(first)), sizes))
    symbols, word = _as_bytes(model, symbols, word)
    begin = np.searchsorted(word, np.arange(len(first) + 1))
    counts = np.diff(begin)
    ids = symbols[common.ragged(begin[which], counts[which])]
    total = np.r_[0, np.cumsum(counts[which])]
    return ids, np.r_[0, total[np.searchsorted(starts, ends, "left")]]


def _as_bytes(model: Pieces, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no piece, as the ids of their bytes."""
    strange = np.flatnonzero(symbols < 0)
    if not len(strange):
        return symbols, word
    kinds, which = np.unique(symbols[strange], return_inverse=True)
    spelled = [model.byte_ids[list(chr(-k - 1).encode("utf-8", "replace"))] for k in kinds.tolist()]
    flat, at = np.concatenate(spelled), np.r_[0, np.cumsum([len(s) for s in spelled])]
    lengths = np.ones(len(symbols), np.int64)
    lengths[strange] = np.diff(at)[which]
    out = np.repeat(symbols, lengths)
    out[np.flatnonzero(np.repeat(symbols < 0, lengths))] = flat[common.ragged(at[which], lengths[strange])]
    return out, np.repeat(word, lengths)


def _spell(table: np.ndarray, at: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
    """The entries of ``ids`` in a table of strings, end to end, and where each text ends."""
    lengths = at[ids + 1] - at[ids]
    ends = np.r_[0, np.cumsum(lengths)][offsets]
    return table[common.ragged(at[ids], lengths)].tobytes(), ends.tolist()


def decode(model: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts of token ids, in UTF-8: without the space put before each text, stray bytes replaced."""
    whole, ends = _spell(model.shown, model.shown_at, ids, offsets)
    out = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        text = whole[a:b]
        if text[:1] == b" " and not model.is_byte[ids[offsets[i]]]:
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:
            text = _decode_bytewise(model, ids[offsets[i] : offsets[i + 1]])
        out.append(text)
    return out


def _decode_bytewise(model: Pieces, ids: np.ndarray) -> bytes:
    """Each run of byte pieces by itself; every byte that starts no character is replaced."""
    out, run = [], b""

    def flush(run: bytes) -> bytes:
        text, i = b"", 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    run[i : i + n].decode()
                except UnicodeDecodeError:
                    continue
                text, i = text + run[i : i + n], i + n
                break
            else:
                text, i = text + _MISSING, i + 1
        return text

    for k, i in enumerate(ids.tolist()):
        shown = model.shown[model.shown_at[i] : model.shown_at[i + 1]].tobytes()
        if model.is_byte[i]:
            run += shown
            continue
        out += [flush(run), shown[1:] if k == 0 and shown[:1] == b" " else shown]
        run = b""
    return b"".join([*out, flush(run)])


TOKENS = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of text encoded at a time.
BATCH = 1 << 20


def _each(path: str, batches: Iterator[pa.RecordBatch]):
    model = load(path)
    for part in common.slices(batches, "text", BATCH):
        texts = part.data.tobytes()
        at = part.offsets.tolist()
        ids, offsets = encode(model, [texts[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)])
        yield part, model, ids, offsets


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text of every row of ``docs`` (``doc_id``, ``text``).

    A null text is empty and has no ids. Rows with null or repeated ids come out as they went
    in. Other columns are not read. ``path`` names the model file, the same on all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, model, ids, offsets in _each(path, batches):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            decoded = pa.array([t.decode() for t in decode(model, ids, offsets)], pa.string())
            yield pa.RecordBatch.from_arrays([part.rows.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``tokens``, with digests made beside the ids instead of the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, model, ids, offsets in _each(path, batches):
            digits, ends = _spell(model.digits, model.digits_at, ids, offsets)
            hashes = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            texts = [hashlib.sha256(t).hexdigest() for t in decode(model, ids, offsets)]
            columns = [part.rows.column(0), pa.array(np.diff(offsets)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
