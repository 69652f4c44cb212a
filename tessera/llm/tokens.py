"""Token ids of whole texts by the tokenizers library, with a memo of words in each Python worker.

Both public vocabularies split a text before their merges, and never across the end of a run of other characters than
white space. So a text's ids are those of its runs in a row; texts with other white space than single spaces and line
ends before words, or with the vocabulary's added tokens, are left to the library in larger pieces. Texts are taken some megabytes at a time: each run that
isn't in the memo is encoded once by the library, many in one call, and those met twice stay in the memo, which is
emptied at ``MEMO_WORDS``. Arrow splits the texts and numbers their different runs; ids are gathered by these numbers.
"""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the vocabularies' patterns have it.
_WS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_RUN = re.compile(rf"[^{_WS}]+")
#: White space other than spaces and line ends.
_OTHER = _WS.replace(" ", "").replace("\n", "")
#: Letters up to Latin-1 and marks after them (not the apostrophe): runs whose parts need no search.
_LETTERS = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)))
_SIMPLE = re.compile(rf"(\n?)([{_LETTERS}]*)([!-&(-/:-@\[-`{{-~]*)")
#: How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others from 256 on.
_AS_IS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _AS_IS else 256 + sum(x not in _AS_IS for x in range(b)) for b in range(256)}
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words of the memo and characters of a batch, for spaced vocabularies and for others (which share workers with more).
MEMO_WORDS = {True: 400_000, False: 200_000}
_BLOCK = 20_000
_BATCH_CHARS = {True: 6 << 20, False: 4 << 20}
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """ids(texts): the ids of each text, as little-endian unsigned 32-bit integers.

    spaced: a run's leading space belongs to it (byte-level vocabularies); otherwise white space is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        model["merges"] = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        #: The vocabulary's merges without the library's own cache of words: what comes here is not in the memo.
        self.merges = BPE(**{k: v for k, v in model.items() if k != "type" and v is not None}, cache_capacity=0).tokenize
        self.memo: dict[str, bytes] = {}

    def of(self, text: str | None) -> bytes:
        return self.ids([text])[0]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= _BATCH_CHARS[self.spaced]:
                out += self._batch(batch)
                batch, size = [], 0
        return out + self._batch(batch)

    def _runs(self, text: str) -> str | None:
        """Runs to look up, with a space between two; None if the text holds an added token or white space that isn't simple.

        Spaced: the first run and those after a line end have it before them, all others mean a space before them.
        """
        if any(x in text for x in self.special):
            return None
        if not self.spaced:
            return " ".join(_RUN.findall(text) if _SEPARATORS.search(text) else text.split())
        return None if _odd(text) else "\n" + text.replace("\n", " \n")

    def _batch(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS[self.spaced]:
            self.memo.clear()
        runs = [self._runs(x) if x else "" for x in texts]
        found = iter(self._looked_up([x for x in runs if x]))
        return [self._whole(text) if own is None else next(found) if own else b"" for text, own in zip(texts, runs)]

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of runs, none of them empty."""
        if not texts:
            return []
        memo = self.memo
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        numbered = split.values.dictionary_encode()
        number, runs = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [(k, x) for k, x in enumerate(runs) if x not in memo]
        self._encode([x for _, x in fresh])
        held = list(map(memo.__getitem__, runs))
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, starts = np.frombuffer(b"".join(held), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if ends[-1] + len(ids) < 1 << 31 else np.int64
        at = np.repeat((starts[number] - ends[:-1]).astype(kind), size)
        at += np.arange(len(at), dtype=kind)
        data = ids[at].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        counts = np.bincount(number).tolist()
        for k, x in fresh:
            if counts[k] == 1:
                del memo[x]
        lead = 4 if self.spaced else 0  # the line end before the first run isn't the text's
        return [data[a + lead : b] for a, b in zip(cuts, cuts[1:])]

    def _encode(self, runs: list[str]) -> None:
        """Ids of runs into the memo: simple ones by their parts, the rest as texts of their own."""
        parts: dict[str, bytes] = {"": b""}
        line_end = self._part("\n") if self.spaced else b""
        rest, hard = [], []
        memo, merges, space = self.memo, self.merges, chr(_BYTES[32]) if self.spaced else ""
        for run in runs:
            if run.isalpha() and run.isascii():  # most runs: the vocabulary writes ASCII letters as they are
                memo[run] = array("I", [x.id for x in merges(space + run if self.spaced else run.lower())]).tobytes()
            else:
                rest.append(run)
        for run in rest:
            found = _SIMPLE.fullmatch(run)
            if not found:
                hard.append(run)
                continue
            lead, letters, marks = found.groups()
            if not self.spaced:
                pieces = (letters.lower(), marks)
            elif lead:
                pieces = (letters, marks)
            else:
                pieces = (" " + letters, marks) if letters else ("", " " + marks)
            if pieces[0] not in parts and not lead and letters in memo:  # a run of its own too
                parts[pieces[0]] = memo[letters]
            for piece in pieces:
                if piece not in parts:
                    parts[piece] = self._part(piece)
            memo[run] = (line_end if lead else b"") + parts[pieces[0]] + parts[pieces[1]]
        for at in range(0, len(hard), _BLOCK):
            block = hard[at : at + _BLOCK]
            texts = [x if x[0] == "\n" and self.spaced else " " + x for x in block]
            found = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            last = np.fromiter((b for _, b in found.offsets), np.int64, len(ids))
            cuts = np.searchsorted(last, np.cumsum([len(x) for x in texts]), side="right").tolist()
            data, begin = ids.tobytes(), 0
            for run, cut in zip(block, cuts):
                memo[run] = data[4 * begin : 4 * cut]
                begin = cut

    def _part(self, piece: str) -> bytes:
        """Ids of a piece that the vocabulary's pattern takes whole, by the merges alone."""
        if piece.isascii():
            found = self.merges(piece.replace(" ", chr(_BYTES[32])).replace("\n", chr(_BYTES[10])))
        else:
            found = self.merges(piece.encode().decode("latin-1").translate(_BYTES))
        return array("I", [x.id for x in found]).tobytes()

    def _whole(self, text: str) -> bytes:
        """By the pieces that the vocabulary's pattern never joins, each encoded on its own; with added tokens at once."""
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = _CHUNK.findall(text)
        different = list(dict.fromkeys(chunks))
        found = self.tokenizer.encode_batch(different, add_special_tokens=False)
        known = {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(different, found)}
        return b"".join(map(known.__getitem__, chunks))


def _odd(text: str) -> bool:
    """Whether there is more than single spaces, and one or two line ends, before words."""
    if "  " in text or " \n" in text or text[-1] == " " or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"):
        return True
    if text.isascii():
        return any(x in text for x in "\t\r\x0b\x0c")
    return any(x in text for x in _OTHER)


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
