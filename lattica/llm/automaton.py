"""Word BPE as a cascade of two deterministic transducers, run over whole batches.

The first cuts text into pre-tokens: it reads lower-cased UTF-8 bytes and
writes symbols, one for each byte, with an END after every pre-token (white
space is written as END alone). It looks two bytes ahead and one back.

The second reads symbols and emits tokens. It is compiled from the merges
alone. An encoding is valid if and only if each of its adjacent pairs is, and
every prefix of a pre-token has one valid encoding; so a prefix's last token
and its count follow from those of shorter prefixes. A state keeps just what
later ones need: the longest suffix read that begins some token, and for each
of its own suffixes that begin one, the last token before it and the tokens
emitted since. Each transition carries the change of the number of tokens
(it may be negative: a longer token can replace two), END the rest, and leads
back to the start state. States and transitions are made when they are first
met, and kept.

A stream is read in segments of equal chunks that run in lockstep, first all
from the start state. That gives each chunk's map of states at one entry; a
chunk with an END has a constant map. The exits of one turn are tried as the
entries of the next chunks in the following turn, until the maps' composition,
by a parallel prefix scan, says every chunk's true entry; few symbols suffice
for most runs to meet what they wrote before, and end there. Where TURNS turns
don't tell all entries, the chunks left are run one after another.

Tables have room for ROOM states, whatever the text: when they are full, within
a segment too, the two thirds visited most are kept, with all states in use.
"""

from __future__ import annotations

import json

import numpy as np

#: Symbols of a chunk and of a segment; turns in which entries of chunks are guessed.
CHUNK, SEGMENT, TURNS = 512, 1 << 20, 6
#: States that a machine has at most: 408 bytes of tables each, about 350 of keys; known pairs of tokens.
ROOM, MAX_FITS = 3 << 16, 1 << 19
_BLANKS, _DIGITS = b" \t\n\r\x0b\x0c", b"0123456789"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Second bytes of the lower-case letters U+00DF to U+00FF without the division sign.
_SECOND = bytes(b for b in range(0x9F, 0xC0) if b != 0xB7)
END, NONE, LEAD = 0, 255, 0xC3
_READ = _DIGITS + b"abcdefghijklmnopqrstuvwxyz" + _PUNCTUATION + bytes([LEAD]) + _SECOND
WIDTH = len(_READ) + 1
_LETTER, _DIGIT, _OTHER, _BLANK = range(4)
#: A table entry is the next state's number (25 bits), and in its low bits the change of the number of tokens.
_BITS, _BIAS = 7, 64
_LOW = (1 << _BITS) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its symbol and its kind."""
    symbol, kind = np.full(256, NONE, dtype=np.uint8), np.full(256, _OTHER, dtype=np.uint8)
    for k, b in enumerate(_READ, 1):
        symbol[b] = k
    symbol[list(_BLANKS)] = END
    kind[list(_BLANKS)] = _BLANK
    kind[list(_DIGITS)] = _DIGIT
    kind[ord("a") : ord("z") + 1] = _LETTER
    kind[0x80:] = _LETTER
    return symbol, kind


_SYMBOL, _KIND = _tables()


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: themselves if printable Latin-1, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut(data: np.ndarray) -> np.ndarray:
    """The first transducer: whether a pre-token begins at each byte. ``data``: lower-cased plain bytes."""
    kind = _KIND[data]
    before = np.concatenate([[_BLANK], kind[:-1]])
    begins = (kind != before) | (kind == _DIGIT)
    quote = np.flatnonzero((data == ord("'")) & (before != _OTHER))
    if len(quote):
        padded = np.concatenate([data, np.full(3, 32, dtype=np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, n in ((quote[short], 2), (quote[long & ~short], 3)):
            for k in range(1, n):
                begins[at + k] = False
            begins[(at + n)[at + n < len(data)]] = True
    return begins


class Machine:
    """The second transducer. ``model``: the vocabulary file's model."""

    def __init__(self, model: dict):
        letters, vocab, suffix = byte_letters(), model["vocab"], model["end_of_word_suffix"]
        n = max(vocab.values()) + 1
        self.size, self.rank = [0] * n, [-1] * n
        self.left, self.right = [-1] * n, [-1] * n
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for s, i in vocab.items():
            ends = s.endswith(suffix)
            raw = bytes(letters[c] for c in (s[: -len(suffix)] if ends else s))
            (self.last if ends else self.inner)[raw] = i
            self.size[i] = len(raw)
        self.pairs: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i = vocab[a + b]
            self.rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
            self.pairs[vocab[a] << 32 | vocab[b]] = r
        self.begins = {x[:k] for x in self.inner for k in range(1, len(x))} | {x[:k] for x in self.last for k in range(1, len(x) + 1)}
        self.sizes = np.array(self.size, dtype=np.int64)
        self.reset()

    def reset(self) -> None:
        self.nodes: dict[bytes, int] = {b"": 0}
        self.suffixes: list[list[bytes]] = [[b""]]  # of each node those that begin a token, shortest first
        self.arcs: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = [()]  # state 0 is none
        self.table = np.zeros(ROOM * WIDTH, dtype=np.uint32)
        self.prefix_token, self.end_token = np.zeros(ROOM, dtype=np.int32), np.full(ROOM, -1, dtype=np.int32)
        self.visits = np.zeros(ROOM, dtype=np.int64)
        self.start = self._state((0, -1, 0))

    def shrink(self, used: list[np.ndarray]) -> np.ndarray:
        """Keep the two thirds of ROOM that were visited most and the states in use, with the transitions among them; the others are made again when met. The new numbers of the old ones, 0 for none."""
        n = len(self.keys)
        visits = self.visits[:n].copy()
        visits[: self.start + 1] = np.iinfo(np.int64).max
        for u in used:
            visits[u] = np.iinfo(np.int64).max
        n_used = int((visits == np.iinfo(np.int64).max).sum())
        keep = np.sort(np.argsort(-visits, kind="stable")[: max(ROOM * 2 // 3, n_used)])
        to = np.zeros(n, dtype=np.uint32)
        to[keep] = np.arange(len(keep), dtype=np.uint32)
        table = self.table.reshape(-1, WIDTH)
        for at in range(0, len(keep), 4096):  # in place: a state never moves up
            entries = table[keep[at : at + 4096]]
            target = to[entries >> _BITS]
            table[at : at + len(entries)] = np.where(target > 0, target << _BITS | entries & _LOW, 0)
        table[len(keep) : n] = 0
        for name, none in (("prefix_token", 0), ("end_token", -1), ("visits", 0)):
            held = getattr(self, name)
            held[: len(keep)] = held[keep]
            held[len(keep) :] = none
        self.visits //= 2
        if len(self.arcs) >= MAX_FITS:
            self.arcs.clear()
        self.keys = [self.keys[k] for k in keep.tolist()]
        self.states = {key: k for k, key in enumerate(self.keys) if k}
        return to

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.prefix_token[found] = key[1]
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a followed by token b as it is: no merge across their border comes before one that made them."""
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            rank, limit = self.rank, 1 << 60
            while True:
                across = self.pairs.get(a << 32 | b)
                if across is not None and across < limit:
                    found = False
                    break
                if rank[a] > rank[b]:  # undo the later merge of the two at the border
                    limit, a = rank[a], self.right[a]
                elif rank[b] >= 0:
                    limit, b = rank[b] + 1, self.left[b]
                else:
                    found = True
                    break
            if len(self.fits) >= MAX_FITS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _node(self, text: bytes) -> int:
        found = self.nodes.get(text)
        if found is None:
            found = self.nodes[text] = len(self.suffixes)
            self.suffixes.append([b"", *(x for k in range(len(text) - 1, -1, -1) if (x := text[k:]) in self.begins)])
        return found

    def _arc(self, node: int, byte: int) -> tuple:
        """(the next node, tokens that may end here with the place of what precedes them, places that are carried on)."""
        own = self.suffixes[node]
        longer = [s + bytes([byte]) for s in own]
        tokens = [(2 * k + 1, self.inner[x]) for k, x in reversed([*enumerate(longer)]) if x in self.inner]
        follow = max((x for x in longer if x in self.begins), key=len, default=b"")
        to = self._node(follow)
        place = {x: 2 * k + 1 for k, x in enumerate(longer)}
        return to, tokens, [place[x] for x in self.suffixes[to][1:]]

    def step(self, state: int, symbol: int) -> int:
        """Make a transition; its table entry."""
        key, fits = self.keys[state], self.fits
        if symbol == END:
            to, change = self.start, 0
            if state != self.start:
                own = self.suffixes[key[0]]
                for k in range(len(own) - 1, 0, -1):
                    token, before = self.last.get(own[k]), key[2 * k + 1]
                    if token is not None and (before < 0 or self.fit(before, token)):
                        break
                else:
                    raise ValueError("the merges leave a pre-token without an encoding")
                self.end_token[state] = token
                change = 1 - key[2 * k + 2]
        else:
            at = key[0] << 8 | symbol
            arc = self.arcs.get(at)
            if arc is None:
                arc = self.arcs[at] = self._arc(key[0], _READ[symbol - 1])
            node, tokens, carried = arc
            for place, token in tokens:
                before = key[place]
                if before < 0:
                    break
                known = fits.get(before << 32 | token)
                if known or known is None and self.fit(before, token):
                    break
            else:
                raise ValueError("the merges leave a prefix without an encoding")
            change = 1 - key[place + 1]
            new = [node, token, 0]
            for p in carried:
                new += key[p], key[p + 1] + change
            to = self._state(tuple(new))
        if not -_BIAS <= change < _BIAS:
            raise OverflowError(f"a transition changes the number of tokens by {change}")
        entry = to << _BITS | (_BIAS + change)
        self.table[state * WIDTH + symbol] = entry
        return entry

    def take(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Table entries of one step of all chunks; new transitions are made."""
        at = state * WIDTH
        at += symbols
        entry = self.table.take(at)
        if not entry.all():
            for x in np.unique(at[entry == 0]).tolist():
                self.step(x // WIDTH, x % WIDTH)
            entry = self.table.take(at)
        return entry

    def run(self, symbols: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """If ids are wanted, at each symbol the token that ends there if the pre-token's prefix does (at an END: its last token, or -1), and the change of the number of tokens. The stream begins after an END and ends with one."""
        state, tokens, changes = self.start, [], []
        for at in range(0, len(symbols), SEGMENT):
            t, c, state = _Segment(self, symbols[at : at + SEGMENT], state, ids).read()
            tokens.append(t)
            changes.append(c)
        return (np.concatenate(tokens), np.concatenate(changes)) if tokens else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int8))

    def tokens(self, symbols: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """The token that ends at each symbol, or -1: followed back from every END, all pre-tokens at once."""
        out = np.full(len(symbols), -1, dtype=np.int32)
        at = np.flatnonzero((symbols == END) & (ended >= 0))
        token, at = ended[at], at - 1
        for _ in range(64):
            if not len(at):
                return out
            out[at] = token
            at = at - self.sizes[token]
            at = at[at >= 0]
            at = at[symbols[at] != END]
            token = ended[at]
        for place in at.tolist():  # few pre-tokens have so many tokens
            while place >= 0 and symbols.item(place) != END:
                found = ended.item(place)
                out[place] = found
                place -= self.size[found]
        return out


class _Segment:
    """A stretch of symbols in equal chunks: the states after each symbol, and what the machine says there."""

    def __init__(self, machine: Machine, symbols: np.ndarray, entry: int, ids: bool):
        self.machine, self.length, self.ids = machine, len(symbols), ids
        self.n = n = -(-self.length // CHUNK)
        stream = np.zeros(n * CHUNK, dtype=np.uint8)
        stream[: self.length] = symbols
        stream = stream.reshape(n, CHUNK)
        self.chunks = np.ascontiguousarray(stream.T)
        ends = stream == END
        self.first = np.where(ends.any(axis=1), ends.argmax(axis=1), CHUNK)
        self.states = np.zeros((CHUNK, n), dtype=np.uint32)
        self.ended = np.zeros((CHUNK, n) if ids else (0, 0), dtype=np.int32)
        self.change = np.zeros((CHUNK, n), dtype=np.int8)
        # each turn's entries and exits of all chunks: the maps as far as known
        now = np.full(n, machine.start, dtype=np.int64)
        now[0] = entry
        self.entries, self.exits = [now], []

    def sweep(self) -> None:
        """Run all chunks from their first entries."""
        m, state, settled = self.machine, self.entries[0], 0
        packed = np.empty((CHUNK, self.n), dtype=np.uint32)
        for i in range(CHUNK):
            if len(m.keys) + self.n >= ROOM:
                self.settle(packed, settled, i)
                settled, state = i, self.renumber(m.shrink([state, *self.entries]), state)
            packed[i] = entry = m.take(state, self.chunks[i])
            state = (entry >> _BITS).astype(np.int64)
        self.settle(packed, settled, CHUNK)

    def settle(self, packed: np.ndarray, begin: int, end: int) -> None:
        """Write down what the entries of some steps say, while their states have these numbers."""
        m = self.machine
        after = packed[begin:end] >> _BITS
        self.states[begin:end] = after
        self.change[begin:end] = (packed[begin:end] & _LOW).astype(np.int8) - np.int8(_BIAS)
        if self.ids:
            before = np.concatenate([self.states[begin - 1 : begin] if begin else self.entries[0][None].astype(np.uint32), after[:-1]])
            self.ended[begin:end] = m.prefix_token.take(after)
            ends = self.chunks[begin:end] == END
            last = before[ends]
            self.ended[begin:end][ends] = np.where(last == m.start, -1, m.end_token.take(last))
        m.visits[: len(m.keys)] += np.bincount(after.reshape(-1), minlength=len(m.keys))

    def walk(self, at: np.ndarray, state: np.ndarray) -> None:
        """Run chunks ``at`` from other states, until they come to what stands there already, or after an END."""
        m = self.machine
        for i in range(CHUNK):
            if not len(at):
                break
            if len(m.keys) + len(at) >= ROOM:
                state = self.renumber(m.shrink([state, *self.entries, *self.exits]), state)
            symbols = self.chunks[i, at]
            entry = m.take(state, symbols)
            new = (entry >> _BITS).astype(np.int64)
            if self.ids:
                self.ended[i, at] = np.where(symbols == END, np.where(state == m.start, -1, m.end_token[state]), m.prefix_token[new])
            self.change[i, at] = (entry & _LOW).astype(np.int8) - np.int8(_BIAS)
            m.visits[new] += 1
            more = (self.states[i, at] != new) & (self.first[at] > i)
            self.states[i, at] = new
            at, state = at[more], new[more]

    def renumber(self, to: np.ndarray, state: np.ndarray) -> np.ndarray:
        self.states = to[self.states]
        self.entries, self.exits = ([to[x].astype(np.int64) for x in held] for held in (self.entries, self.exits))
        return to[state].astype(np.int64)

    def true_entries(self) -> np.ndarray:
        """Of each chunk the turn whose entry is the true one, -1 if unknown: the composition of all maps before it, by a prefix scan."""
        entries, exits = np.stack(self.entries, axis=1), np.stack(self.exits, axis=1)
        turns = entries.shape[1]
        same = exits[:-1, :, None] == entries[1:, None, :]
        # row k says which turn of this chunk follows turn k of the one before; the last column stands for unknown
        maps = np.full((self.n, turns + 1), turns, dtype=np.int64)
        maps[1:, :turns] = np.where(same.any(axis=2), same.argmax(axis=2), turns)
        maps[0] = 0
        distance = 1
        while distance < self.n:
            maps[distance:] = np.take_along_axis(maps[distance:], maps[:-distance], axis=1)
            distance *= 2
        return np.where(maps[:, 0] == turns, -1, maps[:, 0])

    def read(self) -> tuple[np.ndarray, np.ndarray, int]:
        every = np.arange(self.n)
        self.sweep()
        self.exits.append(self.states[-1].astype(np.int64))
        standing = np.zeros(self.n, dtype=np.int64)  # the turn whose run is written in the arrays
        for turn in range(1, TURNS + 1):
            true = self.true_entries()
            if (true >= 0).all():
                break
            wanted = np.concatenate([self.entries[0][:1], self.exits[-1][:-1]])
            todo = np.flatnonzero(wanted != self.entries[-1])
            self.entries.append(wanted)
            self.walk(todo, wanted[todo])
            self.exits.append(self.states[-1].astype(np.int64))
            standing[:] = turn
        true = self.true_entries()
        again = np.flatnonzero((true >= 0) & (np.stack(self.entries)[true, every] != np.stack(self.entries)[standing, every]))
        self.walk(again, np.stack(self.entries)[true[again], again])
        for c in np.flatnonzero(true < 0).tolist():
            entry = np.array([int(self.states[-1, c - 1])])
            if entry[0] != (self.entries[-1][c]):
                self.walk_one(c, entry)
        last = (self.length - 1) % CHUNK
        state = int(self.states[last, self.n - 1])
        return self.ended.T.reshape(-1)[: self.length], self.change.T.reshape(-1)[: self.length], state

    def walk_one(self, c: int, entry: np.ndarray) -> None:
        """One chunk, symbol by symbol."""
        m = self.machine
        if len(m.keys) + CHUNK >= ROOM:
            entry = self.renumber(m.shrink([entry, *self.entries, *self.exits, self.states[-1]]), entry)
        state, start = int(entry[0]), m.start
        for i, symbol in enumerate(self.chunks[:, c].tolist()):
            found = m.table.item(state * WIDTH + symbol) or m.step(state, symbol)
            new = found >> _BITS
            if self.ids:
                self.ended[i, c] = (m.end_token.item(state) if state != start else -1) if symbol == END else m.prefix_token.item(new)
            self.change[i, c] = (found & _LOW) - _BIAS
            if self.states[i, c] == new or symbol == END:
                self.states[i, c] = new
                break
            self.states[i, c] = new
            state = new


def symbols_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of plain bytes that end with a blank, and the place of each byte's symbol."""
    symbol = _SYMBOL[data]
    # an END before every pre-token that follows another one directly
    extra = cut(data) & (symbol != END)
    extra[1:] &= symbol[:-1] != END
    extra[:1] = False
    place = np.cumsum(extra, dtype=np.int32)
    place += np.arange(len(data), dtype=np.int32)
    out = np.zeros(int(place[-1]) + 1 if len(data) else 0, dtype=np.uint8)
    out[place] = symbol
    return out, place


def readable(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to text that the transducers read: no special string, no character beyond their alphabet."""
    ok = _SYMBOL[data] != NONE
    lead = data == LEAD
    second = np.isin(data, list(_SECOND))
    ok[1:] &= lead[:-1] == second[1:]
    if len(data):
        ok[0] &= not second[0]
        ok[-1] &= not lead[-1]
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    ok[special] = False
    return ok


def load_model(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
