"""SentencePiece encoding and decoding with a BPE model: the library's ids by vectorised merge rounds.

A text's spaces become ``▁`` and one more stands before it; the result is cut into words where no piece of the vocabulary
reaches across. All words that a worker has not met yet are encoded together, in flat numpy arrays of symbols: a round
takes each word's least pair rank by a segmented minimum, merges there, leftmost first, and compacts the arrays; words
without a pair that a piece is made of leave. Rounds end when no pair remains. The library merges one pair at a time, the
best of a word, leftmost among equals; a round does the same steps for all words at once, and for equal pairs of one word
as far as none of their merges can make a pair of the same rank or a better one. Characters without a piece become
the pieces of their bytes.

Words of over ``LONG`` characters, of which a round could merge but one pair, take the same steps in order from a heap.

Decoding joins the pieces' bytes in one gather, ``▁`` as a space, without the one that stands before the text; bytes that
are no UTF-8 become U+FFFD each.

Defined cases: a null text is empty, an empty text has no ids; equal texts have equal rows; texts are read whole, of any
length. Strings such as ``<s>`` or ``<0x41>`` in a text are text. Empty tables give empty results. Only ``doc_id`` and
``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches, text_of
from .tokens import vocabulary

MARK, UNKNOWN_SURFACE = "▁", " ⁇ "
#: Characters of a word from which on a heap orders its merges; characters that are merged together; words a worker keeps.
LONG, TOGETHER, KEPT_WORDS = 2_048, 1 << 20, 400_000
NONE = np.iinfo(np.int32).max
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("textquarry.each_byte", _each_byte)


class PieceEncoder:
    """Ids by a SentencePiece BPE model with identity normalisation, a leading ``▁`` and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(" Ａ  b\n ")) != " Ａ  b\n " or not model.encode("a")[0] == model.piece_to_id(MARK + "a"):
            raise ValueError(f"{path}: not a model that keeps texts as they are, with a leading {MARK}")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
        own_bytes = [i for i in range(size) if model.is_byte(i)]
        other = {*special, *own_bytes}
        #: Symbols are the ids of pieces, and from size on characters that have no piece.
        self.size = size
        self.symbols = {p: i for i, p in enumerate(names) if i not in other}
        for c in sorted({c for p in self.symbols for c in p} - {*self.symbols}):
            self.symbols[c] = size + len(self.symbols)
        self._merges(names, np.array([-model.get_score(i) for i in range(size)]))
        self._words({p for p in self.symbols if len(p) > 1})
        self.byte_ids = np.zeros(256, np.uint32)
        for i in own_bytes:
            self.byte_ids[int(names[i][1:-1], 16)] = i
        surface = [p.replace(MARK, " ").encode() for p in names]
        for i in special:
            surface[i] = UNKNOWN_SURFACE.encode() if model.is_unknown(i) else b""
        for i in own_bytes:
            surface[i] = bytes([int(names[i][1:-1], 16)])
        self.surface, self.surface_at, self.surface_len = self._table(surface)
        self.digits, self.digits_at, self.digits_len = self._table([b"%d," % i for i in range(size)])
        self.silent = np.zeros(size, bool)
        self.silent[[i for i in special if not model.is_unknown(i)]] = True
        self.spaced = np.array([p.startswith(MARK) for p in names])
        self.known: dict[str, bytes] = {}

    def _merges(self, names: list[str], cost: np.ndarray) -> None:
        """Pairs of symbols that make a piece, by a key of both, with the piece's rank; which merges may go together."""
        base = self.base = 2 * self.size + 1
        rank_of = np.unique(cost, return_inverse=True)[1].tolist()
        found: dict[int, int] = {}
        alone: set[int] = set()
        for piece, i in self.symbols.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is None or b is None:
                    continue
                found[a * base + b] = i
                # A merge that makes a part of this piece, no better than it, is followed by this piece's at once.
                alone.update(s for s in (a, b) if s < self.size and rank_of[i] <= rank_of[s])
        keys = sorted(found)
        self.keys = np.array(keys, np.int64)
        self.made = np.array([found[k] for k in keys], np.int32)
        self.ranks = np.array([rank_of[found[k]] for k in keys], np.int32)
        self.alone = np.zeros(self.size, bool)
        self.alone[sorted(alone)] = True
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        self.pair_of = dict(zip(keys, zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def _words(self, long: set[str]) -> None:
        """The cut into words: before ``▁`` or a mark that only marks precede in pieces, around characters of one piece."""
        before: dict[str, set[str]] = defaultdict(set)
        for p in long:
            for a, b in zip(p, p[1:], strict=False):
                before[b].add(a)
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("pieces that hold a space after a letter")
        marks: set[str] = set()
        for c in map(chr, range(33, 127)):
            need, todo = set(), [c]
            while todo and not any(x.isalnum() and x.isascii() for x in todo):
                need.update(todo)
                todo = [a for x in todo for a in before[x] if a not in need and a != MARK]
            if not todo and not c.isalnum():
                marks |= need
        inside = {c for p in long for c in p}
        single = "".join(re.escape(chr(c)) for c in range(128) if chr(c) != " " and chr(c) not in inside and chr(c) not in marks)
        marked = "".join(map(re.escape, sorted(marks))) or MARK
        rest = f"[^{MARK}{marked}{single}]"
        self.split = re.compile(f"{MARK}+[{marked}]*{rest}*|[{marked}]+{rest}*|{rest}+" + (f"|[{single}]+" if single else "")).findall

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; NONE where there is none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.ranks[at], NONE).astype(np.int32), np.where(there, self.made[at], -1).astype(np.int32)

    def rounds(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Finished words in groups: (numbers of the words, their counts of symbols, all their symbols). Symbols below 0 are
        characters without one: -1 - code point."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        count = np.array([len(w) for w in words], np.int64)
        number = np.arange(len(words))
        symbol = self.char_symbol[code]
        symbol = np.where(symbol < 0, -1 - code, symbol)
        last = np.cumsum(count) - 1
        rank, made = self._pairs(symbol, np.append(symbol[1:], -1))
        rank[last] = NONE
        done = []
        while len(number):
            first = np.cumsum(count) - count
            least = np.minimum.reduceat(rank, first)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, count)
                done.append((number[over], count[over], symbol[gone]))
                symbol, rank, made = symbol[~gone], rank[~gone], made[~gone]
                number, count, least = number[~over], count[~over], least[~over]
                if not len(number):
                    break
            ends = np.cumsum(count)
            at = np.flatnonzero(rank == np.repeat(least, count))
            word = np.searchsorted(ends, at, side="right")
            # Of pairs that share a symbol the left one goes first; so every second of a chain stays for the next round.
            begins = np.append(True, (at[1:] != at[:-1] + 1) | (word[1:] != word[:-1]))
            start = np.flatnonzero(begins)
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            take = place % 2 == 0
            head = np.append(True, word[1:] != word[:-1])
            if (single := self.alone[made[at]]).any():
                # Where one of a word's merges may be followed by a better one, only the leftmost is taken.
                any_single = np.zeros(len(number), bool)
                any_single[word[single]] = True
                take &= head | ~any_single[word]
            at, word = at[take], word[take]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # as each one taken leaves a gap behind it
            symbol, rank, made = symbol[keep], rank[keep], made[keep]
            count = count - np.bincount(word, minlength=len(count))
            last = np.cumsum(count) - 1
            new = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            rank[new], made[new] = self._pairs(symbol[new], symbol[np.minimum(new + 1, len(symbol) - 1)])
            rank[last] = NONE
        return done

    def ordered(self, word: str) -> np.ndarray:
        """The symbols of one word of any length, merged in order by a heap."""
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int32)
        symbols = self.char_symbol[code]
        symbol = np.where(symbols < 0, -1 - code, symbols).tolist()
        after, before = [*range(1, len(symbol)), -1], [-1, *range(len(symbol) - 1)]
        pair, base = self.pair_of, self.base
        heap = [(p[0], i, a, b, p[1]) for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if a >= 0 and b >= 0 and (p := pair.get(a * base + b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and symbol[x] >= 0 and symbol[y] >= 0 and (p := pair.get(symbol[x] * base + symbol[y])):
                    heapq.heappush(heap, (p[0], x, symbol[x], symbol[y], p[1]))
        return np.array([s for s in symbol if s is not None], np.int32)

    def _ids(self, count: np.ndarray, symbol: np.ndarray) -> list[bytes]:
        """The ids of words, as bytes, from their symbols: characters without a piece become those of their bytes."""
        if ((symbol < 0) | (symbol >= self.size)).any():
            texts = {s: self.byte_ids[list((chr(-1 - s) if s < 0 else self._char(s)).encode())] for s in np.unique(symbol[(symbol < 0) | (symbol >= self.size)]).tolist()}
            parts = [texts[s] if s < 0 or s >= self.size else np.array([s], np.uint32) for s in symbol.tolist()]
            at = np.cumsum(count).tolist()
            return [np.concatenate(parts[b - n : b]).tobytes() for n, b in zip(count.tolist(), at, strict=True)]
        data, at = symbol.astype(np.uint32).tobytes(), (4 * np.cumsum(count)).tolist()
        return [data[b - 4 * n : b] for n, b in zip(count.tolist(), at, strict=True)]

    def _char(self, symbol: int) -> str:
        return next(c for c, s in self.symbols.items() if s == symbol)

    def _learn(self, words: Iterable[str]) -> None:
        together: list[str] = []
        size = 0
        for word in words:
            if len(word) > LONG:
                symbol = self.ordered(word)
                self.known[word] = self._ids(np.array([len(symbol)]), symbol)[0]
                continue
            together.append(word)
            size += len(word)
            if size >= TOGETHER:
                self._merge(together)
                together, size = [], 0
        if together:
            self._merge(together)

    def _merge(self, words: list[str]) -> None:
        for number, count, symbol in self.rounds(words):
            self.known.update(zip([words[k] for k in number.tolist()], self._ids(count, symbol), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The uint32 ids of each text."""
        cut = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = {w for words in cut for w in words if w not in self.known}
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known.clear()
            missing = {w for words in cut for w in words}
        self._learn(missing)
        known = self.known
        out = [np.frombuffer(b"".join([known[w] for w in words]), np.uint32) for words in cut]
        for word in [w for w in missing if len(w) > LONG]:
            del known[word]
        return out

    @staticmethod
    def _gather(ids: np.ndarray, table: np.ndarray, at: np.ndarray, size: np.ndarray) -> bytes:
        sizes = size[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return table[np.repeat(at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        data = self._gather(ids, self.surface, self.surface_at, self.surface_len)
        spoken = np.flatnonzero(~self.silent[ids])
        if len(spoken) and self.spaced[ids[spoken[0]]]:
            data = data[1:]
        return data.decode("utf-8", "textquarry.each_byte")

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._gather(ids, self.digits, self.digits_at, self.digits_len)[:-1]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def pieces_query(documents: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document: what encoding its whole text and decoding that gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary(model, folder))
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            rows = [(len(i), digest(encoder.written(i)), digest(encoder.decode(i).encode())) for i in ids]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(documents.sparkSession)
    return text_of(documents, "doc_id").mapInArrow(lean(run), SCHEMA)
