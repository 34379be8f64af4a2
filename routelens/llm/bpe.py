"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens. At first one state reads every byte and stays.
The gadget of a merge (u, v) copies the state that u leads to, removes the copy's arc v (u may no longer be followed by v), and
lets the arc u lead to the copy and a new arc uv lead where v led. After the last merge the automaton accepts exactly the
token sequences that the merges, applied one by one, leave behind. Its states are numbered by the arc that leads to them. A row of
the state table holds the arcs that gadgets removed from the state, with their ranks, and the state that it was copied from, with
the rank until which it shares that state's row; so the table has an entry for each merge, not one for each pair of tokens.

Texts are pre-split by classes of characters, a chunk of texts at a time, and each distinct word of the chunk is encoded once. The
bytes of all these words drive a second table, the byte transitions over the arc labels, which gives the labels that start at each
byte. Then all words run through the automaton in step, byte by byte: of the labels that start at a byte, those that are arcs of
the state reached there lead to the states at their ends. Every prefix of a word has one accepted path, so just one arc arrives at
each byte, and nothing is tried and taken back. The ids are the arcs on the way back from the last state. Both tables are arrays
with hashed keys; arcs enter theirs when first asked for. Decoding emits the arc labels, which are the tokens' bytes.

Null text counts as empty: no ids, decoded to the empty string. Very long texts are split into pieces at word starts, so that the
tables of a chunk stay small; words over LONG_WORD bytes run through the automaton alone. Repeated rows are encoded again; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .words import chunks, prefix_hashes, text_buffer

#: The table of known arcs doubles from the first of these sizes to the second, and starts anew beyond.
LEAST_ARC_BITS, ARC_BITS, LONG_WORD = 16, 21, 256
#: Characters of a text that are split at a time.
PIECE = 1 << 18
LETTER, NUMBER, SPACE, OTHER = range(4)
#: What the pre-splitting of byte-level BPE parts from a word after an apostrophe. Fixed value.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_KINDS: list[np.ndarray] = []


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in shown else next(hidden)): b for b in range(256)}


def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    if not _KINDS:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for first, last in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(first, last)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, every):
                    kinds[first + m.start() : first + m.end()] = kind
        _KINDS.append(kinds)
    return _KINDS[0]


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start among code points. first: whether a text starts there; one entry more than points.

    Words are runs of letters, of digits or of other characters, each with one blank before it if there is one; contractions
    after an apostrophe; and the white space between, of which the last character stands alone unless it is that blank.
    """
    n, kind = len(points), character_kinds()[points]
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:n]
    begins = ~same
    space, blank = kind == SPACE, points == 32
    after_space, after_blank = np.zeros(n, bool), np.zeros(n, bool)
    after_space[1:], after_blank[1:] = space[:-1] & ~first[1:n], blank[:-1] & ~first[1:n]
    start = begins & (space | ~after_blank)
    start[np.flatnonzero(begins & ~space & after_space) - 1] = True
    quote = np.flatnonzero(begins & (points == 39) & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    todo = quote
    for letters in CONTRACTIONS:
        fits = todo + len(letters) < n
        for k, c in enumerate(letters, 1):
            at = np.minimum(todo + k, n - 1)
            fits &= (points[at] == ord(c)) & ~first[at]
        start[todo[fits] + 1] = False
        end = todo[fits] + 1 + len(letters)
        start[end[end < n]] = True
        todo = todo[~fits]
    return start


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pieces(text: str) -> Iterator[str]:
    """text in pieces of about PIECE characters that start where words do."""
    at = 0
    while len(text) - at > 2 * PIECE:
        size = PIECE
        while True:
            points = code_points(text[at : at + size])
            kind = character_kinds()[points]
            first = np.zeros(len(points) + 1, bool)
            first[0] = True
            # starts behind white space aside, neither what follows a start nor what stands before it matters to the other
            sure = 1 + np.flatnonzero(word_starts(points, first)[1:-8] & (kind[:-9] != SPACE))
            if len(sure) or at + size >= len(text):
                break
            size *= 2
        if not len(sure):
            break
        yield text[at : at + int(sure[-1])]
        at += int(sure[-1])
    yield text[at:]


class HashedTable:
    """Values of 64-bit keys from 0 on, in arrays with open addressing."""

    def __init__(self, bits: int, kind: type):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = todo[there == keys[todo]]
            out[hit] = self.values[slot[hit]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct ones that are not there."""
        slot, self.used = self._slot(keys), self.used + len(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]  # of several with one slot the last gets it
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)


    def roomy(self, more: int, most_bits: int) -> HashedTable:
        """A table at most half full with so many keys more: this one, a larger one with its keys, or an empty one if that had over most_bits."""
        if 2 * (self.used + more) <= len(self.keys):
            return self
        bits = (2 * (self.used + more) - 1).bit_length()
        if bits > most_bits:
            return HashedTable(max(most_bits, 1 + more.bit_length()), self.values.dtype.type)
        out, here = HashedTable(bits, self.values.dtype.type), np.flatnonzero(self.keys >= 0)
        out.put(self.keys[here], self.values[here])
        return out


class Automaton:
    """Compiled from the text of a tokenizer file with a byte-level BPE model."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        every = [labels.get(i, b"") for i in range(max(labels, default=-1) + 1)]
        self.label_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.label_size = np.array([len(x) for x in every], np.int64)
        self.label_start = np.cumsum(self.label_size) - self.label_size

        #: The state table: arcs removed from a state, the state it was copied from, and the rank at which it was (-1: none).
        self.removed: dict[int, int] = {}
        self.copied, self.born = array("i", [-1]) * len(every), array("i", [-1]) * len(every)
        #: The arc along which each arc was added.
        self.along = array("i", [-1]) * len(every)
        for c in letters:
            if c in vocab:
                self.born[vocab[c]] = 0
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(vocab[a], vocab[b], vocab[a + b], rank)
        self._compile_bytes()
        self.arcs = HashedTable(LEAST_ARC_BITS, np.int8)

    def _gadget(self, u: int, v: int, uv: int, rank: int) -> None:
        if self.born[u] >= 0 and self.born[v] >= 0 and self.born[uv] < 0 and self._arc(u, v, rank):
            self.removed[u << 32 | v] = rank
            self.along[uv], self.copied[uv], self.born[uv] = u, v, rank

    def _arc(self, state: int, token: int, now: int) -> bool:
        """Whether a state has an arc, once the gadgets before `now` are in place.

        It lacks the arc if, in its row or those it was copied from, the arc itself was removed, or one along which the arc was
        added was removed before that.
        """
        removed, born = self.removed, self.born
        part, until = token, now
        while True:
            at, limit = state, until
            while True:
                rank = removed.get(at << 32 | part)
                if rank is not None and rank < limit:
                    return False
                limit = min(limit, born[at])
                if self.copied[at] < 0:
                    break
                at = self.copied[at]
            if self.along[part] < 0:
                return True
            until = min(until, born[part] + 1)  # a merge (u, u) takes the arc u from the copy before uv is added
            part = self.along[part]

    def _compile_bytes(self) -> None:
        """Byte transitions over the labels of all arcs, and the arc whose label ends at each node (-1: none)."""
        token = np.flatnonzero(np.frombuffer(self.born, np.int32) >= 0)
        node, n, length = np.zeros(len(token), np.int64), 1, 0
        keys, ends = [np.zeros(0, np.int64)], []
        while len(token):
            over = self.label_size[token] == length
            ends.append((node[over], token[over]))
            node, token = node[~over], token[~over]
            key, which = np.unique(node << 8 | self.label_bytes[self.label_start[token] + length], return_inverse=True)
            keys.append(key)
            node, n, length = n + which, n + len(key), length + 1
        self.token_at = np.full(n, -1, np.int32)
        for node, token in ends:
            self.token_at[node] = token
        self.steps = HashedTable(2 + n.bit_length(), np.int32)
        self.steps.put(np.concatenate(keys), np.arange(1, n, dtype=np.int32))

    def has_arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 32 | token
        found = self.arcs.get(key)
        if len(new := np.unique(key[found < 0])):
            self.arcs = self.arcs.roomy(len(new), ARC_BITS)
            self.arcs.put(new, np.array([self._arc(k >> 32, k & 0xFFFFFFFF, 1 << 60) for k in new.tolist()], np.int8))
            missing = np.flatnonzero(found < 0)
            found[missing] = self.arcs.get(key[missing])
        return found > 0

    def _labels_at(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and token of the labels that start at these places of data and go no farther than the place's end."""
        node, length = self.steps.get(data[at].astype(np.int64)), 1
        starts, lengths, tokens = [], [], []
        while len(at):
            at, node = at[node >= 0], node[node >= 0]
            token = self.token_at[node]
            some = token >= 0
            starts.append(at[some])
            lengths.append(np.full(len(starts[-1]), length, np.int32))
            tokens.append(token[some])
            more = at + length < end[at]
            at = at[more]
            node = self.steps.get(node[more].astype(np.int64) << 8 | data[at + length])
            length += 1
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(tokens)

    def encode_words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie end to end in data, one word after another, and the number of each word's."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(size), np.int64)
        first = (np.cumsum(size) - size).astype(np.int32)
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        end = (first + size.astype(np.int32))[word]
        start, length, token = self._labels_at(data, np.arange(len(data), dtype=np.int32), end)
        into = (start - first[word[start]]).astype(np.uint16)
        order = np.argsort(into, kind="stable")
        slot = (start + word[start])[order]  # a word of n bytes has n + 1 places
        after, token, length = slot + length[order], token[order], length[order]
        borders = np.searchsorted(into[order], np.arange(int(size.max(initial=0)) + 1))
        state, back = np.full(len(data) + len(size), -2, np.int32), np.zeros(len(data) + len(size), np.int32)
        begin = first + np.arange(len(size), dtype=np.int32)
        state[begin] = -1  # the first state has every arc
        for lo, hi in zip(borders, borders[1:]):
            before = state[slot[lo:hi]]
            if (before == -2).any():
                raise ValueError("the vocabulary lacks a byte")
            ok = before == -1 if lo == 0 else self.has_arcs(before, token[lo:hi])
            to = after[lo:hi][ok]
            state[to], back[to] = token[lo:hi][ok], length[lo:hi][ok]
        place = begin + size
        if (state[place] == -2).any():
            raise ValueError("the vocabulary lacks a byte")
        passed = np.zeros(len(state), bool)
        while len(place := place[state[place] >= 0]):
            passed[place] = True
            place = place - back[place]
        here = np.flatnonzero(passed)
        return state[here].astype(np.uint32), np.bincount(np.repeat(np.arange(len(size)), size + 1)[here], minlength=len(size))

    def encode_long(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        n, data = len(word), np.frombuffer(word, np.uint8)
        state, back, known = [-2] * (n + 1), [0] * (n + 1), {}
        state[0] = -1
        for lo in range(0, n, PIECE):
            start, length, token = self._labels_at(data, np.arange(lo, min(lo + PIECE, n)), np.broadcast_to(n, n))
            order = np.argsort(start, kind="stable")
            for i, size, part in zip(start[order].tolist(), length[order].tolist(), token[order].tolist(), strict=True):
                before = state[i]
                if before == -2:
                    raise ValueError("the vocabulary lacks a byte")
                there = before == -1 or known.get((before, part))
                if there is None:
                    there = known[before, part] = self._arc(before, part, 1 << 60)
                if there:
                    state[i + size], back[i + size] = part, size
        if state[n] == -2:
            raise ValueError("the vocabulary lacks a byte")
        ids, i = [], n
        while i:
            ids.append(state[i])
            i -= back[i]
        return ids[::-1]

    def _parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Pieces of a text, and special tokens with their ids (-1 for others)."""
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern is not None else ():
            yield from ((p, -1) for p in pieces(text[at : m.start()]))
            yield m[0], self.special[m[0]]
            at = m.end()
        yield from ((p, -1) for p in pieces(text[at:]))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, one after another, and the bounds of each text's."""
        data, offsets = text_buffer(texts)
        whole = data.tobytes()
        if any(s.encode() in whole for s in self.special) or len(whole) > 4 * PIECE:
            parts = [list(self._parts(t)) for t in texts.to_pylist()]
            own = [part for p in parts for part in p]
            found = [self._encode_flat([t.encode()], np.array([0, len(t.encode())])) if i < 0 else (np.array([i], np.uint32), np.array([0, 1])) for t, i in own]
            ids = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint32)
            total = np.concatenate(([0], np.cumsum([len(f[0]) for f in found], dtype=np.int64)))
            return ids, total[np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))]
        return self._encode_flat([whole], offsets)

    def _encode_flat(self, data: list[bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data[0]
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        points = code_points(raw.decode())
        at = np.zeros(len(points) + 1, np.int64)  # byte of each code point
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        lo = at[np.flatnonzero(word_starts(points, first))]
        hi = np.append(lo[1:], len(raw))
        _, one, word = np.unique(prefix_hashes(np.frombuffer(raw, np.uint8), lo, hi), return_index=True, return_inverse=True)
        size = (hi - lo)[one]
        short = size <= LONG_WORD
        bytes_at, _ = _gathered(lo[one], hi[one] - lo[one], np.flatnonzero(short))
        ids, count = self.encode_words(np.frombuffer(raw, np.uint8)[bytes_at], size[short])
        long = [np.array(self.encode_long(raw[lo[k] : hi[k]]), np.uint32) for k in one[~short]]
        size = np.zeros(len(one), np.int64)
        size[short], size[~short] = count, [len(x) for x in long]
        begin = np.zeros(len(one), np.int64)
        begin[short], begin[~short] = np.cumsum(count) - count, len(ids) + np.cumsum(size[~short]) - size[~short]
        ids = np.concatenate([ids, *long])
        flat, total = _gathered(begin, size, word)
        return ids[flat], total[np.searchsorted(lo, offsets)]

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the arcs, one after another, and the byte where each starts (one more entry)."""
        flat, total = _gathered(self.label_start, self.label_size, ids)
        return self.label_bytes[flat], total

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_ids(np.frombuffer(ids, "<u4"))[0].tobytes().decode("utf-8", "replace")


def _gathered(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values of the ragged rows `of`, one row after another, and where each begins (one more entry)."""
    own = size[of]
    total = np.concatenate(([0], np.cumsum(own)))
    return np.repeat(start[of] - total[:-1], own) + np.arange(total[-1]), total


_COMPILED: dict[int, Automaton] = {}


def _compiled(tokenizer_json: str) -> Automaton:
    """One automaton for each worker and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Automaton(tokenizer_json)
    return _COMPILED[key]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts from bytes; those that are not UTF-8 get replacement characters."""
    raw = data.tobytes()
    try:
        raw.decode()
        return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())
    except UnicodeDecodeError:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.string())


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and decoded text of every document.

    The tokenizer file has a fixed size and is read on the driver; executors get it as a broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(spec.value)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for lo, hi in chunks(text_buffer(texts)[1]):
                ids, bounds = automaton.encode_texts(texts[lo:hi])
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((bounds * 4).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                decoded, at = automaton.decode_ids(ids)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], packed.cast(pa.binary()), _strings(decoded, at[bounds])], names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_documents()."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
