"""SentencePiece BPE by vectorised merge rounds, and decoding by table.

A text is cut into words where no piece can lie across. All new words of a batch stand in one flat array of symbols. In each
round every word takes the best rank among its pairs, merges the pairs of that rank from the left, all words at once,
and drops out when no pair is left. That is what the library does one pair at a time: the next best pair, the leftmost of
equals. A merge may make a pair that ranks better than the one just merged; pieces for which such a longer piece exists
are merged one place at a time. Words over ``LONG`` symbols are first cut where the two characters stand side by side in no
piece; what is longer still goes through a heap, so that the time stays near-linear for any text.

The model must take texts as they are (identity normalisation, a space put before, bytes for unknown characters).

Edge cases: a null text encodes like an empty one, to the end id alone; null ids decode to null. Spaces and the piece
alphabet's own space sign are one, as in the library. Bytes that are no UTF-8 decode to U+FFFD each. Repeated rows are rows
of their own; other columns stay, and may have any names but the result's.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import public_path

SPACE = "▁"
LONG = 256
MEMO_WORDS = 200_000
_BATCH_CHARS = 1 << 20
_SLICE = 500
_NONE = np.iinfo(np.int32).max
_coders: dict[str, Coder] = {}
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


class Coder:
    """encode(texts) and decode(ids) of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(model.decode(model.encode(x)) != x for x in (" a  ﬁ ", "\t①\n")):
            raise ValueError(f"{path}: only vocabularies that take texts as they are")
        n = model.get_piece_size()
        self.end = model.eos_id()
        pieces = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self._read_pieces(pieces, n, {p: model.get_score(i) for p, i in pieces.items()})
        shown = [b""] * n
        for p, i in pieces.items():
            shown[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            shown[i] = bytes([b])
        for i in range(n):
            if model.is_unknown(i):
                shown[i] = model.decode([i]).encode()
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.begins_with_space = np.zeros(n, bool)
        self.begins_with_space[[i for p, i in pieces.items() if p[0] == SPACE]] = True
        self.memo: dict[str, bytes] = {}

    def _read_pieces(self, pieces: dict[str, int], n: int, scores: dict[str, float]) -> None:
        """Symbols are pieces, and from n on characters that only longer pieces hold; ``other`` is any other character."""
        symbols = dict(pieces)
        for c in sorted(set("".join(pieces))):
            symbols.setdefault(c, n + len(symbols) - len(pieces))
        self.pieces_end, self.other = n, n + len(symbols) - len(pieces)
        self.of_char = np.full(0x110000, self.other, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = {x: k for k, x in enumerate(sorted({scores[p] for p in pieces if len(p) > 1}, reverse=True))}
        rank = {p: order[scores[p]] for p in pieces if len(p) > 1}
        self.one_at_a_time = np.zeros(len(order) + 1, bool)
        self.width = self.other + 1
        keys, into, ranks, beside = [], [], [], set()
        for p, r in rank.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                beside.add((p[k - 1], p[k]))
                if left in symbols and right in symbols:
                    keys.append(symbols[left] * self.width + symbols[right])
                    into.append(pieces[p])
                    ranks.append(r)
                for part in (left, right):
                    if rank.get(part, -1) >= r:
                        self.one_at_a_time[rank[part]] = True
        order_of = np.argsort(keys)
        self.keys, self.into, self.ranks = (np.array(x, t)[order_of] for x, t in ((keys, np.int64), (into, np.int32), (ranks, np.int32)))
        self.beside = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in beside], np.int64))
        # places where texts can be cut before they are looked at: after another character, before a space; round a line end
        self.cuts = "".join(c for c in "\n\r\t" if c not in symbols)
        if any(b == SPACE != a for a, b in beside):
            self.word = re.compile(r"(?s).+")
        else:
            self.word = re.compile(rf" *[^ {self.cuts}]+| +" + (rf"|[{self.cuts}]" if self.cuts else ""))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the two make, its rank); the rank is _NONE where they make nothing."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return self.into[at], np.where(hit, self.ranks[at], _NONE)

    # -- merge rounds

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their places) that are left when no word has a pair. Words have one symbol or more."""
        n = len(symbols)
        left = np.full(n, -1, np.int32)  # by place: the symbol that stays there
        place = np.arange(n)
        sym = symbols.astype(np.int32)
        word = np.repeat(np.arange(len(lengths)), lengths)
        fresh = True
        while len(sym):
            if fresh:  # all symbols stand side by side
                m = len(sym)
                last = np.append(word[1:] != word[:-1], True)
                starts = np.flatnonzero(np.append(True, last[:-1]))
                after = np.append(np.where(last, m, np.arange(1, m + 1)), m)
                before = np.append(np.where(np.append(True, last[:-1]), m, np.arange(-1, m - 1)), m)
                into, rank = self.pairs(sym, np.append(sym[1:], 0))
                rank[last] = _NONE
                number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, m)))
                alive = np.ones(m, bool)
                fresh, gone = False, 0
            best = np.minimum.reduceat(rank, starts)
            going = best < _NONE
            ended = ~going[number]
            if not going.any() or gone + np.count_nonzero(ended & alive) > len(sym) // 4:
                done = ended & alive
                left[place[done]] = sym[done]
                stay = alive & ~ended
                if stay.all():
                    break
                sym, place, word = sym[stay], place[stay], word[stay]
                fresh = True
                continue
            at = np.flatnonzero((rank == best[number]) & (rank < _NONE))
            own = number[at]
            first = np.append(True, own[1:] != own[:-1])
            at = at[first | ~self.one_at_a_time[best[own]]]
            # of places that overlap in a row, every other one
            follows = np.append(False, after[at[:-1]] == at[1:])
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            right = after[at]
            beyond = after[right]
            sym[at] = into[at]
            alive[right] = False
            rank[right] = _NONE
            after[at] = beyond
            before[beyond] = at
            gone += len(at)
            changed = np.concatenate([at, before[at]])
            changed = changed[changed < len(sym)]
            nexts = after[changed]
            ends = nexts == len(sym)
            made, new = self.pairs(sym[changed], sym[np.where(ends, 0, nexts)])
            into[changed] = made
            rank[changed] = np.where(ends, _NONE, new)
        kept = np.flatnonzero(left >= 0)
        return left[kept], kept

    def one_by_one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, by a heap of pairs."""
        n = len(symbols)
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        into, rank = self.pairs(symbols[:-1], symbols[1:])
        known: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(r, k, m, sym[k], sym[k + 1]) for k, (r, m) in enumerate(zip(rank.tolist(), into.tolist())) if r < _NONE]
        heapq.heapify(heap)

        def met(k: int) -> None:
            if k < 0 or after[k] >= n:
                return
            pair = sym[k], sym[after[k]]
            if pair not in known:
                m, r = self.pairs(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(m[0]), int(r[0])
            m, r = known[pair]
            if r < _NONE:
                heapq.heappush(heap, (r, k, m, *pair))

        while heap:
            _, k, m, x, y = heapq.heappop(heap)
            j = after[k]
            if sym[k] != x or j >= n or sym[j] != y:
                continue
            sym[k], sym[j] = m, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            met(k)
            met(before[k])
        out = np.array(sym, np.int32)
        kept = np.flatnonzero(out >= 0)
        return out[kept], kept

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, little-endian 32-bit."""
        if not words:
            return []
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in words])
        symbols = self.of_char[points]
        starts = np.cumsum(lengths) - lengths
        parts, heads = lengths, starts
        if (lengths > LONG).any():
            cut = np.zeros(len(points), bool)
            cut[starts] = True
            for a, size in zip(starts[lengths > LONG].tolist(), lengths[lengths > LONG].tolist()):
                two = points[a : a + size].astype(np.int64)
                two = two[:-1] << 21 | two[1:]
                at = np.minimum(np.searchsorted(self.beside, two), len(self.beside) - 1)
                cut[a + 1 : a + size] = self.beside[at] != two
            heads = np.flatnonzero(cut)
            parts = np.diff(np.append(heads, len(points)))
        short = parts <= LONG
        kept, places = self.rounds(symbols[np.repeat(short, parts)], parts[short])
        places = np.flatnonzero(np.repeat(short, parts))[places]
        if not short.all():
            more = [(a, *self.one_by_one(symbols[a : a + size])) for a, size in zip(heads[~short].tolist(), parts[~short].tolist())]
            kept = np.concatenate([kept, *[s for _, s, _ in more]])
            places = np.concatenate([places, *[a + p for a, _, p in more]])
            order = np.argsort(places)
            kept, places = kept[order], places[order]
        ids, counts = self._with_bytes(kept, points[places])
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(places, np.append(starts, len(points)))].tolist()
        data = ids.astype("<i4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def _with_bytes(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each symbol): characters that are no piece become their UTF-8 bytes' ids."""
        odd = np.flatnonzero(symbols >= self.pieces_end)
        counts = np.ones(len(symbols), np.int64)
        if not len(odd):
            return symbols, counts
        raw = points[odd].astype("<u4").tobytes().decode("utf-32-le").encode()
        own = points[odd]
        counts[odd] = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        ids = np.repeat(symbols, counts)
        ids[np.repeat(symbols >= self.pieces_end, counts)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return ids, counts

    # -- texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many for each text), an end id after each."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, begin = 0, at
            while at < len(texts) and (at == begin or size < _BATCH_CHARS):
                size += len(texts[at] or "")
                at += 1
            out += self._batch(texts[begin:at])
        return np.frombuffer(b"".join(out), "<i4"), np.array([len(x) // 4 for x in out], np.int64)

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, end = self.memo, int(self.end).to_bytes(4, "little")
        found = [self.word.findall(" " + x.replace(SPACE, " ")) if x else [] for x in texts]
        counts = Counter(chain.from_iterable(found))
        fresh = [x for x in counts if x not in memo]
        memo.update(zip(fresh, self.words(fresh)))
        get = memo.__getitem__
        out = [b"".join(map(get, x)) + end for x in found]
        for x in fresh:
            if counts[x] == 1 or len(x) > LONG:
                del memo[x]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, how many for each one)."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(counts), np.int64)
        if ids.min() < 0 or ids.max() >= len(self.sizes):
            raise ValueError("ids that the vocabulary hasn't got")
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        # a step of one from byte to byte, but a jump where the next piece begins
        solid = ids[sizes > 0]
        own, begins = self.sizes[solid], self.places[solid]
        step = np.ones(total, np.int64)
        heads = np.cumsum(own) - own
        step[heads] = begins - np.append(0, begins[:-1] + own[:-1] - 1)
        data = self.shown[np.cumsum(step)]
        # the space that encoding puts before a text goes, if it is a piece's
        lengths = np.diff(ends)
        firsts = ends[:-1][lengths > 0]
        lead = firsts[self.begins_with_space[solid[np.searchsorted(heads, firsts)]]]
        if not self._proper(ids, data, firsts):
            return self._slowly(ids, counts)
        keep = np.ones(total, bool)
        keep[lead] = False
        gone = np.zeros(len(counts), np.int64)
        gone[np.flatnonzero(lengths > 0)[~keep[firsts]]] = 1
        return data[keep], lengths - gone

    def _proper(self, ids: np.ndarray, data: np.ndarray, firsts: np.ndarray) -> bool:
        """Whether each text is UTF-8, with no control id among bytes."""
        odd = self.is_byte[ids]
        if not odd.any():
            return True
        silent = np.flatnonzero(self.sizes[ids[1:-1]] == 0) + 1
        if (odd[silent - 1] & (odd[silent + 1] | (self.sizes[ids[silent + 1]] == 0))).any() or (data[firsts] & 0xC0 == 0x80).any():
            return False
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            return False
        return True

    def _slowly(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of any bytes: those that are no UTF-8 become U+FFFD each."""
        out = []
        ends = np.append(0, np.cumsum(counts)).tolist()
        for a, b in zip(ends, ends[1:]):
            runs, led = [b""], False
            for i in ids[a:b].tolist():
                shown = self.shown[self.places[i] : self.places[i] + self.sizes[i]].tobytes()
                if self.is_byte[i]:
                    runs[-1] += shown
                    led = True
                    continue
                skip = not led and bool(self.begins_with_space[i])
                led = led or len(shown) > 0
                runs += [shown[skip:], b""]
            out.append("".join(x.decode("utf-8", "each-byte") for x in runs).encode())
        return np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out], np.int64)


def coder(path: str) -> Coder:
    """This worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _texts(data: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    ends = pa.py_buffer(np.append(0, np.cumsum(lengths)))
    made = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, ends, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
    return made if valid.all() else pc.if_else(pa.array(valid), made, None)


def _slices(rows: pa.Array) -> list[pa.Array]:
    """Some hundred rows at a time, so that little is unpacked at once."""
    return [rows.slice(at, _SLICE) for at in range(0, max(1, len(rows)), _SLICE)]


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids of a text column, the end id last, as the library gives them."""
    path = path or public_path("piece_bpe_32k.model")

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [coder(path).encode(x.to_pylist()) for x in _slices(texts)]
            ends = np.append(0, np.cumsum(np.concatenate([n for _, n in parts]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([i for i, _ in parts]), pa.int32()))

    return ids(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The texts of an array column of ids; control ids show as nothing."""
    path = path or public_path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            parts = []
            for some in _slices(lists):
                counts = np.asarray(pc.fill_null(pc.list_value_length(some), 0), np.int64)
                parts.append(coder(path).decode(np.asarray(some.flatten(), np.int64), counts))
            data, lengths = (np.concatenate(x) for x in zip(*parts))
            yield _texts(data, lengths, np.asarray(lists.is_valid()))

    return text(ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with ``ids``."""
    return docs.withColumn("ids", encoded(F.col("text"), path))


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What ``encode`` returned, with ``decoded``."""
    return docs.withColumn("decoded", decoded(F.col("ids"), path))
