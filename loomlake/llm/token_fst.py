"""Token counts: a byte-pair tokenizer compiled to deterministic transducers.

Two transducers run one after the other.

1. The word transducer reads character classes and emits the starts of pre-tokens. It has 13 states, so the effect
   of a chunk of text is a map of 13 states to 13 states. Chunks are mapped independently, the maps are composed by a
   parallel prefix scan, and a second pass emits from the state each chunk really begins in.
2. The token transducer reads the bytes of a pre-token. A state is the set of suffixes that a vocabulary entry can
   still extend, each with the token that ends before it and its token count. Of two-token sequences only those are
   followed that byte-pair encoding itself gives (a sequence is its encoding exactly if all its neighbours are), so
   one token can end at each byte. A transition is annotated with the change of the number of tokens and the token
   that ends there. States are compiled when text first reaches them; past ``max_states`` all are forgotten and
   compiled anew, which bounds memory and changes no result. Pre-tokens are lanes run in step; a long one is cut in
   chunks, each a map of entry states to exit states and token counts, and these maps are composed by the prefix scan.

Counts equal those of the ``tokenizers`` library for byte-level vocabularies with the usual split pattern, and so do
the ids that ``Encoder.encode`` reads off the transitions; it keeps those of up to ``max_words`` pre-tokens, then
forgets them all, which changes no result. Added special tokens in a text are single tokens, as the
library has it. Null texts count as empty; empty texts have 0 tokens; repeated rows give repeated results; an empty
table gives an empty table; very long texts and words are taken whole; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlake.llm.common import batches, joined, mix64, ragged, span_hashes, texts_of

# Character classes and states of the word transducer.
STMD, R, V, E, L, LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, RESET = range(12)
BEGIN, LETTERS, NUMBERS, OTHERS, SPACE1, WHITE1, SPACES, WHITES, Q, Q_R, Q_V, Q_L, ENDED = range(13)
#: Pre-tokens of more bytes are cut in chunks; rounds of guessing their entry states.
LONG, CHUNK, SPECULATE = 1024, 256, 96
#: New pre-tokens of at most so many bytes are merged together by ``Encoder.merged``, in matrices of these widths.
WIDTHS = (8, 16, 32)
NO_MERGE = np.int32((1 << 31) - 1)
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    step, emit = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    letters = (STMD, R, V, E, L, LETTER)

    def after(c: int) -> int:
        return LETTERS if c in letters else {NUMBER: NUMBERS, SPACE: SPACE1, WHITE: WHITE1, QUOTE: Q, OTHER: OTHERS}[c]

    for q in range(13):
        for c in range(RESET):
            to, out = after(c), HERE
            if q in (LETTERS, NUMBERS, OTHERS) and to == q:
                out = 0
            elif q in (OTHERS, Q) and c in (QUOTE, OTHER):
                to, out = OTHERS, 0
            elif q in (SPACE1, SPACES, WHITE1, WHITES):
                if c in (SPACE, WHITE):
                    to, out = (SPACES if c == SPACE else WHITES), 0
                else:  # the last white character stands alone, or before the word if it is a space
                    out = (BEFORE if q in (SPACES, WHITES) else 0) | (HERE if q in (WHITE1, WHITES) else 0)
                    to = OTHERS if to == Q and q in (SPACE1, SPACES) else to
            elif q == Q and c in letters:
                to, out = {STMD: (ENDED, 0), R: (Q_R, 0), V: (Q_V, 0), L: (Q_L, 0)}.get(c, (LETTERS, HERE))
            elif q in (Q_R, Q_V, Q_L):
                if c == (L if q == Q_L else E):
                    to, out = ENDED, 0
                elif c in letters:  # no contraction: the letter before began a word
                    to, out = LETTERS, BEFORE
                else:
                    out = BEFORE | HERE
            step[q, c], emit[q, c] = to, out
        step[q, RESET], emit[q, RESET] = BEGIN, BEFORE if q in (Q_R, Q_V, Q_L) else 0
    return step, emit


STEP, EMIT = _word_table()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        kind = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
        out = np.where(kind == ord("L"), LETTER, np.where(kind == ord("N"), NUMBER, OTHER)).astype(np.uint8)
        out[WHITE_SPACE] = WHITE
        for c, to in {" ": SPACE, "'": QUOTE, "r": R, "v": V, "e": E, "l": L, **dict.fromkeys("stmd", STMD)}.items():
            out[ord(c)] = to
        _CLASSES.append(out)
    return _CLASSES[0]


#: The word transducer with states times 12, so that a state and a class add up to a place in the table.
_NEXT = (STEP * np.uint8(12)).ravel()


def _after(state: np.ndarray, part: np.ndarray) -> np.ndarray:
    for c in part:
        state = _NEXT[state + c]
    return state


def chunk_maps(symbols: np.ndarray, tail: int = 8) -> np.ndarray:
    """symbols (steps, chunks) -> (states, chunks): the state after each chunk for each state before it.

    The last symbols of most chunks lead all states to one, whatever stands before them; only the others are run whole.
    """
    every = np.repeat(np.arange(13, dtype=np.uint8)[:, None] * np.uint8(12), symbols.shape[1], 1)
    maps = _after(every, symbols[-tail:])
    rest = (maps != maps[0]).any(0)
    if rest.any():
        maps[:, rest] = _after(every[:, rest], symbols[:, rest])
    return maps // np.uint8(12)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk maps, in a logarithmic number of steps."""
    maps, d = maps.copy(), 1
    while d < maps.shape[1]:
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d].copy(), 0)
        d *= 2
    return maps


def scan_counts(maps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As scan(), for maps that also emit: the counts along the way are added up."""
    maps, counts, d = maps.copy(), counts.copy(), 1
    while d < maps.shape[1]:
        before = maps[:, :-d].copy()
        counts[:, d:] = counts[:, :-d] + np.take_along_axis(counts[:, d:], before, 0)
        maps[:, d:] = np.take_along_axis(maps[:, d:], before, 0)
        d *= 2
    return maps, counts


def word_starts(symbols: np.ndarray, chunk: int = 128) -> np.ndarray:
    """True where a pre-token starts. symbols: classes of all characters, RESET behind each text."""
    n = len(symbols)
    padded = np.full(-(-max(n, 1) // chunk) * chunk, RESET, np.uint8)
    padded[:n] = symbols
    by_step = np.ascontiguousarray(padded.reshape(-1, chunk).T)
    maps = chunk_maps(by_step)
    # a map that leads all states to one is its own composition with those before it
    through = scan(maps) if (maps != maps[0]).any() else maps
    state = np.concatenate([[np.uint8(BEGIN)], through[BEGIN, :-1]]) * np.uint8(12)
    at = np.empty_like(by_step)
    for i, c in enumerate(by_step):
        np.add(state, c, out=at[i])
        state = _NEXT[at[i]]
    out = EMIT.ravel()[at.T.ravel()[:n]]
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts & (symbols != RESET)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def _append(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The first n values and then those, in twice the room where it is too small."""
    if n + len(more) > len(held):
        held, old = np.empty(max(2 * len(held), n + len(more)), held.dtype), held
        held[:n] = old[:n]
    held[n : n + len(more)] = more
    return held


class Known:
    """The ids of pre-tokens met before, by the 64-bit hashes of their bytes (not 0)."""

    def __init__(self):
        self.n = self.n_ids = 0
        self.bits = 16
        self.hash, self.first, self.count, self.ids = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 17, np.int32)
        self._room()

    def _room(self) -> None:
        self.keys, self.row = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        mask = len(self.keys) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == hashes, self.row[at], np.int32(-1))
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            key = self.keys[at[open_]]
            found = key == hashes[open_]
            out[open_[found]] = self.row[at[open_[found]]]
            open_ = open_[~found & (key != 0)]
        return out

    def _put(self, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        keys = self.hash[rows]
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(rows))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        self.row[at] = rows

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> int:
        """Keep new and distinct hashes with their ids, one after the other; the row of the first."""
        begin = self.n
        self.hash, self.count = _append(self.hash, begin, hashes), _append(self.count, begin, counts)
        self.first = _append(self.first, begin, self.n_ids + np.cumsum(counts) - counts)
        self.ids = _append(self.ids, self.n_ids, ids)
        self.n, self.n_ids = begin + len(hashes), self.n_ids + len(ids)
        if 2 * self.n > 1 << self.bits:
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self._room()
            self._put(np.arange(self.n))
        else:
            self._put(np.arange(begin, self.n))
        return begin


#: One (node, token before, its count) of a state; states are kept packed, as there are many.
_STATE = struct.Struct("iii")


_PAIR_BITS = 18


def _tables(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Hash tables (multiplier, keys, values) without probing: what finds its place taken goes into the next one."""
    out = []
    while len(keys):
        odd = mix64(np.array([len(out) + 1], np.uint64))[0] | np.uint64(1)
        at = (keys.view(np.uint64) * odd >> np.uint64(64 - _PAIR_BITS)).view(np.int64)
        held, own = np.full(1 << _PAIR_BITS, -1 << 40, np.int64), np.zeros(1 << _PAIR_BITS, np.int32)
        held[at], own[at] = keys, values
        out.append((odd, held, own))
        left = held[at] != keys
        keys, values = keys[left], values[left]
    return out


class Encoder:
    """The compiled transducers of one vocabulary file."""

    def __init__(self, path: str, max_states: int = 1_000_000, max_words: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        letters, model = _byte_letters(), spec["model"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        # the first one in the text, and of those that begin there the longest
        self.specials = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: as_bytes(s) for s, i in model["vocab"].items() if s not in {x["content"] for x in spec["added_tokens"]}}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[id_of[a], id_of[b]] = (rank, id_of[a + b])
        self.rank = {t: rank for rank, t in self.merges.values()}
        self.halves = {t: pair for pair, (_, t) in self.merges.items()}
        merges = [(a << 20 | b, rank, t) for (a, b), (rank, t) in self.merges.items()]
        self.made = np.zeros(len(model["merges"]), np.int32)
        self.made[[m[1] for m in merges]] = [m[2] for m in merges]
        self.pairs = _tables(np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges], np.int32))
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        nodes: dict[bytes, int] = {b"": 0}
        self.child: dict[int, int] = {}
        self.open: set[int] = set()
        for t in id_of:
            for i in range(1, len(t) + 1):
                if t[:i] not in nodes:
                    up = nodes[t[: i - 1]]
                    nodes[t[:i]] = len(nodes)
                    self.child[up << 8 | t[i - 1]] = nodes[t[:i]]
                    self.open.add(up)
        self.token_at: list[int | None] = [None] * len(nodes)
        short = {i: b for i, b in self.bytes_of.items() if len(b) <= WIDTHS[-1]}
        data, offsets = joined([*short.values()])
        counts, ids = self.merged(data, offsets[:-1], np.diff(offsets))
        own = dict(zip(short, zip(counts.tolist(), ids[np.cumsum(counts) - counts].tolist())))
        for i, b in self.bytes_of.items():
            if own[i] == (1, i) if i in own else self.bpe(b) == [i]:
                self.token_at[nodes[b]] = i
        self.neighbours: dict[int, bool] = {}
        self.max_states, self.max_words = max_states, max_words
        self.known = Known()
        self.forget()

    def bpe(self, data: bytes) -> list[int]:
        """Byte-pair encoding by its definition: the pair of lowest rank first."""
        ids = [self.byte_id[b] for b in data]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [self.merges[ids[best[1]], ids[best[1] + 1]][1]]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        """Whether byte-pair encoding of the two tokens' bytes gives just them.

        Merges inside the tokens are undone, the last first; the pieces that then meet at the border must not have a
        merge that would have come earlier (of equal ranks the left one comes first).
        """
        known = self.neighbours.get(a << 20 | b)
        if known is not None:
            return known
        key, limit = a << 20 | b, 1 << 60
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge[0] < limit:
                known = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                known = True
                break
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self.neighbours) > 1_000_000:
            self.neighbours.clear()
        self.neighbours[key] = known
        return known

    def forget(self) -> None:
        start = _STATE.pack(0, -1, 0)
        self.states, self.index = [start], {start: 0}
        self.bits = 17
        self._room()

    def _room(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.delta = np.zeros(1 << self.bits, np.int32)
        self.token = np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _compile(self, keys: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(state after, tokens more, token that ends) of the transitions of states and bytes.

        The entries of a state stand by depth, as each begins behind the one before it: equal sets are equal bytes."""
        child, token_at, open_, neighbours, states, index = self.child.get, self.token_at, self.open, self.neighbours.get, self.states, self.index
        after, changes, tokens = [], [], []
        for key in keys:
            live, byte = [], key & 255
            for node, last, count in _STATE.iter_unpack(states[key >> 8]):
                node = child(node << 8 | byte)
                if node is None:
                    continue
                ends = token_at[node]
                if ends is not None:
                    follows = last < 0 or neighbours(last << 20 | ends)
                    if follows is None:
                        follows = self.may_follow(last, ends)
                    if follows:
                        token, change = ends, count + 1
                if node in open_:
                    live.append((node, last, count))
            flat = []
            for node, last, count in live:
                flat += (node, last, count - change)
            flat += (0, token, 0)
            state = array("i", flat).tobytes()
            to = index.get(state)
            if to is None:
                to = index[state] = len(states)
                states.append(state)
            after.append(to)
            changes.append(change)
            tokens.append(token)
        return after, changes, tokens

    def _add(self, keys: np.ndarray, *values) -> None:
        """Put new transitions into the table, which is kept half empty."""
        rows = [keys, *(np.array(v, np.int32) for v in values)]
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            held = self.keys >= 0
            rows = [np.concatenate([x[held], more]) for x, more in zip((self.keys, self.to, self.delta, self.token), rows)]
            while 2 * self.used > 1 << self.bits:
                self.bits += 1
            self._room()
            self.used = len(rows[0])
        keys, *values = rows
        at, left, mask = self._slots(keys), np.arange(len(keys)), len(self.keys) - 1
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        self.to[at], self.delta[at], self.token[at] = values

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The table slots of transitions, compiled where they are not yet known."""
        while True:
            mask = len(self.keys) - 1
            at = self._slots(keys)
            open_ = np.flatnonzero(self.keys[at] != keys)
            missing = []
            while len(open_):
                gone = self.keys[at[open_]] < 0
                missing.append(open_[gone])
                open_ = open_[~gone]
                at[open_] = (at[open_] + 1) & mask
                open_ = open_[self.keys[at[open_]] != keys[open_]]
            if not missing or not (new := np.unique(keys[np.concatenate(missing)])).size:
                return at
            self._add(new, *self._compile(new.tolist()))

    def _walk(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, last=None, place=None) -> tuple[np.ndarray, np.ndarray]:
        """(state, tokens) after each byte span from its state; spans are lanes run in step, longest first. With ``last``:
        the token that ends at each byte is put there, from the span's place on."""
        state, count = state.copy(), np.zeros(len(begin), np.int64)
        steps = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 0), side="right")
        for i, n in enumerate(steps):
            slot = self._find(state[:n] << 8 | data[begin[:n] + i])
            state[:n] = self.to[slot]
            count[:n] += self.delta[slot]
            if last is not None:
                last[place[:n] + i] = self.token[slot]
        return state, count

    def long_word(self, data: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(starts, lengths, entry states of the chunks of a long pre-token, its number of tokens).

        Each chunk is a map of entry states to (exit state, tokens) over the states that can come in: first the one that
        the chunk before it leads the start state to, then the exits of the maps so far, until they are closed. Equal
        chunks share their maps. The maps are composed by a prefix scan. Chunks whose maps are still open after
        ``SPECULATE`` rounds get their true entry state one after the other."""
        begin = np.arange(start, start + length, CHUNK)
        size = np.minimum(CHUNK, start + length - begin)
        _, one, content = np.unique(span_hashes(data, begin, begin + size), return_index=True, return_inverse=True)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def learn(pairs: list[tuple[int, int]]) -> None:
            c, s = np.array(pairs, np.int64).T
            order = np.argsort(-size[one[c]], kind="stable")
            c, s = c[order], s[order]
            to, n = self._walk(data, begin[one[c]], size[one[c]], s)
            known.update(zip(zip(c.tolist(), s.tolist()), zip(to.tolist(), n.tolist())))

        names = content.tolist()
        learn([(c, 0) for c in range(len(one))])
        inside = [{0}] + [{known[c, 0][0]} for c in names[:-1]]
        for _ in range(SPECULATE):
            if want := {(c, s) for c, states in zip(names, inside) for s in states if (c, s) not in known}:
                learn(sorted(want))
            grown = False
            for c, states, after in zip(names, inside, inside[1:]):
                new = {known[c, s][0] for s in states} - after
                grown |= bool(new)
                after |= new
            if not grown:
                break
        else:  # the true entry states, in turn
            entry, total = [0], 0
            for c in names:
                if (c, entry[-1]) not in known:
                    learn([(c, entry[-1])])
                to, n = known[c, entry[-1]]
                entry.append(to)
                total += n
            return begin, size, np.array(entry[:-1], np.int64), total
        states = [sorted(x) for x in inside]
        at = [{s: i for i, s in enumerate(x)} for x in states]
        width = max(map(len, states))
        maps, counts = np.zeros((width, len(names)), np.int64), np.zeros((width, len(names)), np.int64)
        for i, c in enumerate(names):
            for j, s in enumerate(states[i]):
                to, n = known[c, s]
                maps[j, i], counts[j, i] = at[i + 1][to] if i + 1 < len(names) else 0, n
        maps, counts = scan_counts(maps, counts)
        entry = [0, *(states[i + 1][k] for i, k in enumerate(maps[0, :-1].tolist()))]
        return begin, size, np.array(entry, np.int64), int(counts[0, -1])

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts of byte spans, and with ids their ids one span after the other."""
        if len(self.states) > self.max_states:
            self.forget()
        place = np.cumsum(lengths) - lengths
        is_long = lengths > LONG
        short, counts = np.flatnonzero(~is_long), np.zeros(len(starts), np.int64)
        lanes = [(starts[short], lengths[short], np.zeros(len(short), np.int64), place[short])]
        for k in np.flatnonzero(is_long).tolist():
            begin, size, entry, counts[k] = self.long_word(data, int(starts[k]), int(lengths[k]))
            if ids:
                lanes.append((begin, size, entry, place[k] + begin - starts[k]))
        begin, size, entry, at = (np.concatenate(x) for x in zip(*lanes))
        order = np.argsort(-size, kind="stable")
        last = np.zeros(int(lengths.sum()), np.int32) if ids else None
        _, n = self._walk(data, begin[order], size[order], entry[order], last, at[order])
        own = order < len(short)
        counts[short[order[own]]] = n[own]
        if not ids:
            return counts, None
        # walk back from the last byte: the token that ends there, then the one that ends before it
        size = self._sizes()
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for k in np.flatnonzero(is_long).tolist():
            ends, i, found = last[place[k] : place[k] + lengths[k]].tolist(), int(lengths[k]) - 1, []
            while i >= 0:
                found.append(ends[i])
                i -= self.size_list[ends[i]]
            out[first[k] : first[k] + counts[k]] = found[::-1]
        lane = short[lengths[short] > 0]
        at, put = place[lane] + lengths[lane] - 1, first[lane] + counts[lane] - 1
        low = place[lane]
        while len(at):
            t = last[at]
            out[put] = t
            at = at - size[t]
            keep = at >= low
            at, put, low = at[keep], put[keep] - 1, low[keep]
        return counts, out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of token pairs; a token of -1 has none."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), NO_MERGE)
        for odd, keys, ranks in self.pairs:
            at = (key.view(np.uint64) * odd >> np.uint64(64 - _PAIR_BITS)).view(np.int64)
            np.copyto(out, ranks[at], where=keys[at] == key)
        return out

    def merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``words`` with ids. Byte-pair encoding by its definition, of all spans up to the largest of ``WIDTHS`` at a
        time: each round merges the pair of lowest rank, the first of equal ones, of each span that has one. For spans met
        once this is less work than to compile their transitions; longer ones go through the token transducer."""
        byte_id, none = np.array(self.byte_id, np.int32), np.int32(-1)
        if not hasattr(self, "byte_ranks"):
            self.byte_ranks = self._ranks(np.repeat(byte_id, 256), np.tile(byte_id, 256))
        counts, found = np.zeros(len(starts), np.int64), []
        for low, width in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            if not len(rows):
                continue
            place = np.arange(width + 1, dtype=np.int8)
            inside = place < lengths[rows, None]
            byte = data[np.minimum(starts[rows, None] + place, len(data) - 1)]
            # behind the last token there is an end, which also stands before the first one
            token = np.where(inside, byte_id[byte], none)
            rank = np.full(token.shape, NO_MERGE)
            rank[:, :-1] = np.where(inside[:, 1:], self.byte_ranks[byte[:, :-1].astype(np.int64) << 8 | byte[:, 1:]], NO_MERGE)
            after = np.tile(np.minimum(place + np.int8(1), np.int8(width)), (len(rows), 1))
            before = np.tile(np.append(np.int8(width), place[:-1]), (len(rows), 1))
            # flat views; the rows that may have a merge left, by their first places
            tokens, ranks, afters, befores = token.ravel(), rank.ravel(), after.ravel(), before.ravel()
            w = np.arange(len(rows))
            while len(w):
                part = rank if len(w) == len(rows) else rank[w]
                at = part.argmin(1)
                at += w * (width + 1)
                best = ranks[at]
                more = best != NO_MERGE
                if not more.all():
                    w, at, best = w[more], at[more], best[more]
                begin = w * (width + 1)
                gone = begin + afters[at]
                behind, ahead = begin + afters[gone], begin + befores[at]
                made = self.made[best]
                tokens[at], tokens[gone], ranks[gone] = made, none, NO_MERGE
                afters[at], befores[behind] = afters[gone], befores[gone]
                both = self._ranks(np.concatenate([made, tokens[ahead]]), np.concatenate([tokens[behind], made]))
                ranks[at], ranks[ahead] = both[: len(w)], both[len(w) :]
            keep = token >= 0
            counts[rows] = keep.sum(1)
            found.append((rows, token[keep]))
        rows = np.flatnonzero(lengths > WIDTHS[-1])
        if len(rows):
            counts[rows], ids = self.words(data, starts[rows], lengths[rows], True)
            found.append((rows, ids))
        out, first = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, ids in found:
            out[ragged(first[rows], counts[rows])] = ids
        return counts, out

    def _sizes(self) -> np.ndarray:
        if not hasattr(self, "size"):
            self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
            for i, b in self.bytes_of.items():
                self.size[i] = len(b)
            self.size_list = self.size.tolist()
        return self.size

    def _segments(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, list[tuple[int, int]]]:
        """Texts split at special tokens: segments, the text of each, and (segment index before which, id) of specials."""
        parts, owner, special = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.specials.finditer(t) if self.special else ():
                parts.append(t[at : m.start()])
                owner.append(i)
                special.append((len(parts), self.special[m[0]]))
                at = m.end()
            parts.append(t[at:] if at else t)
            owner.append(i)
        return parts, np.array(owner, np.int64), special

    def _split(self, texts: list[bytes]):
        """(segments, the text of each, specials, bytes, the starts, lengths, hashes and segments of their pre-tokens)."""
        parts, owner, special = self._segments(texts)
        strings = [p.decode("utf-8", "replace") for p in parts]
        points = np.frombuffer("\0".join([*strings, ""]).encode("utf-32-le"), np.uint32)
        # the character behind each segment is no character of it
        behind = np.cumsum([len(s) + 1 for s in strings]) - 1
        symbols = classes()[points]
        symbols[behind] = RESET
        begin = np.flatnonzero(word_starts(symbols))
        width = (points >= 0x80).astype(np.int8)
        width += points >= 0x800
        width += points >= 0x10000
        width += np.int8(1)
        width[behind] = 0
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        start = offset[begin]
        length = np.diff(np.append(start, len(data)))
        segment = np.searchsorted(behind, begin, side="left")
        return parts, owner, special, data, start, length, span_hashes(data, start, start + length), segment

    def count(self, texts: list[bytes]) -> np.ndarray:
        _, owner, special, data, start, length, hashes, segment = self._split(texts)
        _, one, same = np.unique(hashes, return_index=True, return_inverse=True)
        counts, _ = self.words(data, start[one], length[one], False)
        out = np.bincount(owner[segment], counts[same], len(texts)).astype(np.int64)
        for k, _ in special:
            out[owner[k - 1]] += 1
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Pre-tokens met before are looked up, also those of earlier calls."""
        parts, owner, special, data, start, length, hashes, segment = self._split(texts)
        if self.known.n > self.max_words or self.known.n_ids > 8 * self.max_words:
            self.known = Known()
        known = self.known
        hashes[hashes == 0] = 1
        row = known.find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            _, one, same = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            row[new] = known.add(hashes[one], *self.merged(data, start[one], length[one])) + same
        counts = known.count[row]
        all_ids = known.ids[ragged(known.first[row], counts)]
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ends = total[np.searchsorted(segment, np.arange(len(parts)), side="right")]
        if not special:
            return np.split(all_ids, ends[:-1])
        pieces, at = [[] for _ in texts], 0
        before = dict(special)
        for k, e in enumerate(ends.tolist(), 1):
            pieces[owner[k - 1]].append(all_ids[at:e])
            at = e
            if k in before:
                pieces[owner[k - 1]].append(np.array([before[k]], np.int32))
        return [np.concatenate(p) for p in pieces]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker; its compiled states serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups(texts: list[bytes], most: int = 1_000_000):
    """Index ranges of texts with about so many bytes."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of df. path: a byte-level vocabulary file."""

    def run(rows):
        for b in batches(rows):
            texts = texts_of(b.column(1))
            counts = np.concatenate([encoder(path).count(texts[i:j]) for i, j in groups(texts)])
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
