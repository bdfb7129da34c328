"""The lower-casing word BPE of the tokenizers library, by compiled transducers.

Its normaliser and pre-tokeniser never look across ASCII white space, so the
ids of a text are those of its pieces one after another. Pieces of the
transducers' alphabet (ASCII and Western European letters, no special string)
go through them in batches; any other piece goes to the library as it stands.
A vocabulary file of another kind is encoded by the library text by text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from . import automaton
from .common import hold

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What the compilation relies on.
_EXPECTED_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of other characters that a worker keeps, each of so many characters at most; beyond, it starts anew.
MAX_PIECES, MAX_PIECE = 50_000, 100
#: Bytes that go through the transducers at a time, about.
BATCH_BYTES = 1 << 19
_BLANKS = re.compile("[ \t-\r]+")


class Vocabulary:
    """Ids and counts of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = automaton.load_model(path)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [x.get("type") for x in splits]
        specials = all(t["content"].startswith("<|") for t in spec.get("added_tokens", ()))
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == _EXPECTED_SPLIT and kinds == ["Split", "ByteLevel"] and specials
        self.machine = automaton.Machine(spec["model"]) if self.by_word else None
        self.pieces: dict[str, bytes] = {}

    def encode_raw(self, text: str) -> bytes:
        """By the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            found = self.encode_raw(text)
            if len(self.pieces) > MAX_PIECES:
                self.pieces.clear()
            if len(text) <= MAX_PIECE:
                self.pieces[text] = found
        return found

    def _read(self, raws: list[bytes], ids: bool) -> list:
        """Ids (as bytes) or numbers of tokens of plain lower-cased texts."""
        out: list = []
        at = 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (size < BATCH_BYTES or end == at):
                size += len(raws[end]) + 1
                end += 1
            data = np.frombuffer(b"\n".join([*raws[at:end], b""]), dtype=np.uint8)  # of a longer text the machine reads segments
            symbols, place = automaton.symbols_of(data)
            ended, change = self.machine.run(symbols, ids)
            stops = place[np.cumsum([len(r) + 1 for r in raws[at:end]]) - 1]
            if ids:
                token = self.machine.tokens(symbols, ended)
                found = token >= 0
                raw, ends = token[found].astype("<u4").tobytes(), np.cumsum(found, dtype=np.int64)[stops].tolist()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
            else:
                total = np.cumsum(change, dtype=np.int64)[stops]
                out += np.diff(total, prepend=0).tolist()
            at = end
        return out

    def _each(self, texts: list[str | None], ids: bool) -> list:
        raws = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        lengths = np.array([len(r) + 1 for r in raws], dtype=np.int64)
        data = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
        odd = np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(~automaton.readable(data)), "right")).tolist()
        rest: dict[int, list[str]] = {}
        for k in odd:
            plain = []
            for p in _BLANKS.split(texts[k]):
                low = p.lower().encode("utf-8", "surrogatepass")
                plain.append((p, low, bool(automaton.readable(np.frombuffer(low, dtype=np.uint8)).all())))
            rest[k] = plain
        whole = [k for k in range(len(texts)) if k not in rest]
        out: list = [None] * len(texts)
        for k, found in zip(whole, self._read([raws[k] for k in whole], ids)):
            out[k] = found
        for k, plain in rest.items():
            own = iter(self._read([low for _, low, ok in plain if ok], ids))
            parts = [next(own) if ok else self.piece(p) if ids else len(self.piece(p)) // 4 for p, _, ok in plain]
            out[k] = b"".join(parts) if ids else sum(parts)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit bytes. A null text has none."""
        return self._each(texts, True) if self.by_word else [self.encode_raw(t) if t else b"" for t in texts]

    def count(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens of whole texts: sums over the transitions."""
        return self._each(texts, False) if self.by_word else [len(self.encode_raw(t)) // 4 if t else 0 for t in texts]


@functools.lru_cache(maxsize=1)
def load(path: str) -> Vocabulary:
    """The vocabulary of this process: Python workers serve many tasks, and keep what they have compiled until another operator's task comes."""
    hold(load.cache_clear)
    return Vocabulary(path)
