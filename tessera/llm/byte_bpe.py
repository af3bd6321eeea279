"""Byte-level BPE encoding and decoding with a public rank file.

1. Pre-tokenisation without a regex. The code points of an Arrow slice become an
   array of symbols: letter, number, other mark, white space, and what their next
   neighbours make of them (an apostrophe that opens a contraction, the last blank
   of a run). An automaton of eight states over these symbols says where a piece
   starts. Its transition functions form a small monoid, so that composing them is
   one table look-up, and composing is associative: blocks of symbols are scanned
   side by side, then the blocks' totals, then every state follows at once.
2. The pieces' bytes are hashed to 64 bits; distinct pieces that the worker has not
   met yet are merged pair by pair, lowest rank first, leftmost of equals, and kept;
   a round joins one pair in each of them at once.
3. Tokens carry the byte offset at which they start in their text; decoding writes
   the tokens' bytes to these places.

Letters, numbers and white space are those of the tokeniser library's own tables
(read from it once, by single code points): other Unicode versions differ.

Defined cases: a null or empty text has no tokens and decodes to no bytes; rows are
encoded one by one, so equal rows give equal rows; an empty table gives an empty
table; strings that name special tokens are ordinary text; bytes that are not UTF-8
are marks and come back unchanged; ids outside the vocabulary are an error when decoded;
of the input's columns those in `carry` are returned.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import support as S

TOKENIZERS = "/opt/tokenizers"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES, CACHE_IDS = 600_000, 1 << 24
BLOCK = 64
LAST_CODE_POINT = 0x10FFFF

# ---------------------------------------------------------------- code points and their symbols

LETTER, NUMBER, MARK, BLANK, SPACE = range(5)
#: A run of white space goes on (or the text ends); its last blank leads the piece after it; its last other space stands alone.
LETTERS, NUMBERS, MARKS, OPENS_1, OPENS_2, IN_SPACE, LEADING_BLANK, LONE_SPACE = range(8)


def code_point_classes() -> np.ndarray:
    """Class of every code point, by the tables of the tokeniser library."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, LAST_CODE_POINT + 1)]))
    out = np.full(LAST_CODE_POINT + 1, MARK, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        members = bytes(tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)).decode()
        out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = BLANK
    return out


def code_points(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the byte at which each starts."""
    lead = (buf & 0xC0) != 0x80
    lead[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(lead)
    if len(starts) == len(buf):
        return buf, starts
    wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
    b0 = wide[starts]
    out = b0.copy()
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        own = np.flatnonzero(b0 >= least)
        value = b0[own] & mask
        for k in range(1, more + 1):
            value = value << 6 | wide[starts[own] + k] & 0x3F
        out[own] = value
    return np.minimum(out, LAST_CODE_POINT), starts


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Automaton symbols of the code points; `first` are the places at which rows start. Those get 8 added."""
    kind = classes[points]
    out = kind.copy()  # letters, numbers and marks are their own symbols
    last = np.zeros(len(points) + 2, bool)  # of a row
    last[first[first > 0] - 1] = True
    last[len(points) - 1] = True
    space = np.flatnonzero(kind >= BLANK)
    before_text = ~last[space] & (np.append(kind, SPACE)[space + 1] < BLANK)
    out[space] = np.where(before_text, np.where(kind[space] == BLANK, LEADING_BLANK, LONE_SPACE), IN_SPACE)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        ahead = np.append(points, [0, 0])
        one, two, ends_1, ends_2 = ahead[quotes + 1], ahead[quotes + 2], last[quotes], last[quotes + 1]
        out[quotes[~ends_1 & np.isin(one, [ord(c) for c in "stmd"])]] = OPENS_1
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[quotes[~ends_1 & ~ends_2 & pair]] = OPENS_2
    out[first] += 8
    return out


# ---------------------------------------------------------------- the automaton and its scan

FRESH, IN_LETTERS, IN_NUMBERS, IN_MARKS, IN_SPACES, AFTER_BLANK, WANTS_1, WANTS_2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at the symbol."""
    if symbol == LETTERS:
        if state in (WANTS_1, WANTS_2):
            return (FRESH if state == WANTS_1 else WANTS_1), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBERS:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol == MARKS or (symbol in (OPENS_1, OPENS_2) and state in (IN_MARKS, AFTER_BLANK)):
        return IN_MARKS, state not in (IN_MARKS, AFTER_BLANK)
    if symbol in (OPENS_1, OPENS_2):
        return (WANTS_1 if symbol == OPENS_1 else WANTS_2), True
    if symbol == IN_SPACE:
        return IN_SPACES, state != IN_SPACES
    return (AFTER_BLANK if symbol == LEADING_BLANK else FRESH), True


class Automaton:
    """Transition functions as elements of a monoid: `product` composes, `apply` gives the state, `starts` the output."""

    def __init__(self):
        steps = [[_step(FRESH if s >= 8 else q, s % 8) for q in range(8)] for s in range(16)]
        self.starts = np.array([[s >= 8 or out for _, out in row] for s, row in enumerate(steps)])
        generators = [tuple(q for q, _ in row) for row in steps]
        found = {tuple(range(8)): 0}  # the identity
        queue = list(found)
        for f in queue:
            for g in generators:
                h = tuple(g[q] for q in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        n = len(queue)
        assert n <= 256  # elements are bytes
        self.generators = np.array([found[g] for g in generators], np.uint8)
        self.apply = np.array(queue, np.uint8)
        self.n, self.product = n, np.array([found[tuple(g[q] for q in f)] for f in queue for g in queue], np.uint8)

    def compose(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.product[left.astype(np.int32) * self.n + right]

    def prefixes(self, elements: np.ndarray) -> np.ndarray:
        """Composition of all elements up to each place, itself included."""
        n = len(elements)
        if n <= BLOCK:
            out = elements.copy()
            for i in range(1, n):
                out[i : i + 1] = self.compose(out[i - 1 : i], out[i : i + 1])
            return out
        blocks = np.zeros((-(-n // BLOCK), BLOCK), np.uint8)
        blocks.ravel()[:n] = elements
        rows = np.ascontiguousarray(blocks.T)  # row r holds place r of every block
        for r in range(1, BLOCK):
            rows[r] = self.compose(rows[r - 1], rows[r])
        before = np.concatenate([np.zeros(1, np.uint8), self.prefixes(rows[-1])[:-1]])
        return self.compose(before[None, :], rows).T.ravel()[:n]

    def piece_starts(self, symbol: np.ndarray) -> np.ndarray:
        """Which symbols start a piece; the first must start a row."""
        if not len(symbol):
            return np.zeros(0, bool)
        after = self.apply[self.prefixes(self.generators[symbol]), FRESH]
        before = np.concatenate([np.full(1, FRESH, np.uint8), after[:-1]])
        return self.starts[symbol, before]


@cache
def automaton() -> Automaton:
    return Automaton()


def piece_bounds(buf: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte at which every piece starts; pieces fill the rows without gaps."""
    if not len(buf):
        return np.zeros(0, np.int64)
    points, starts = code_points(buf, at)
    first = np.searchsorted(starts, at[:-1][np.diff(at) > 0])
    return starts[automaton().piece_starts(symbols(points, first, classes))]


# ---------------------------------------------------------------- pair merging


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all neighbouring parts the pair of lowest rank is joined, leftmost of equals, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # both parts must be as they were: i still starts a part, and the part after it ends at `stop`
        if gone[i] or end[i] >= n or gone[end[i]] or end[end[i]] != stop:
            continue
        gone[end[i]] = 1
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


class Vocabulary:
    """Ranks, and for pairs of ids the id of their joined bytes, in an open hash table."""

    NONE = np.int64(1) << 40  # above every id

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.size = np.full(max(self.ranks.values()) + 1, -1, np.int64)
        self.of_byte = np.full(256, -1, np.int64)
        pairs = []
        for token, i in self.ranks.items():
            self.size[i] = len(token)
            if len(token) == 1:
                self.of_byte[token[0]] = i
            pairs += [(a << 32 | b, i) for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        own = np.array(pairs, np.int64).reshape(-1, 2)
        self.bits = max(4, len(own).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE)
        slot = self._slot(own[:, 0])
        while len(own):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = own[free, 0]  # of several for one slot the last stays
            placed = self.keys[slot] == own[:, 0]
            self.values[slot[placed]] = own[placed, 1]
            own, slot = own[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's joined bytes, NONE if they are no token."""
        keys = left << 32 | right
        out, slot, open_ = np.full(len(keys), self.NONE), self._slot(keys), np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            out[open_] = np.where(held == keys, self.values[slot], out[open_])
            more = np.flatnonzero((held >= 0) & (held != keys))
            open_, keys, slot = open_[more], keys[more], slot[more] + 1 & (1 << self.bits) - 1
        return out


@cache
def vocabulary(data: bytes) -> Vocabulary:
    """Kept by the worker for all its tasks."""
    return Vocabulary(data)


#: Pieces of more bytes are merged one by one with a heap.
LONG_PIECE = 48


def merge_all(pieces: list[bytes], known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and how many each has; a round joins one pair in every piece that has one."""
    whole = np.fromiter((known.ranks.get(piece, -1) for piece in pieces), np.int64, len(pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = (whole >= 0).astype(np.int64)
    parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]  # pieces and their ids
    for i in np.flatnonzero((whole < 0) & (lengths > LONG_PIECE)).tolist():
        parts.append((np.array([i]), np.array(merge(pieces[i], known.ranks), np.int64)))
        counts[i] = len(parts[-1][1])
    own = np.flatnonzero((whole < 0) & (lengths <= LONG_PIECE))
    sizes = lengths[own]
    ids = known.of_byte[np.frombuffer(b"".join([pieces[i] for i in own.tolist()]), np.uint8)]
    rank = np.full(len(ids), known.NONE)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    inner = np.flatnonzero(~last)
    rank[inner] = known.joined(ids[inner], ids[inner + 1])
    while len(own):
        starts = np.cumsum(sizes) - sizes
        # the lowest rank of each piece, then its leftmost place
        best = np.minimum.reduceat(rank << 22 | np.arange(len(rank)) - np.repeat(starts, sizes), starts)
        done = best >= known.NONE << 22
        if done.any():
            rows = np.repeat(done, sizes)
            counts[own[done]] = sizes[done]
            parts.append((own[done], ids[rows]))
            own, sizes, best, ids, rank = own[~done], sizes[~done], best[~done], ids[~rows], rank[~rows]
            if not len(own):
                break
            starts = np.cumsum(sizes) - sizes
        at = starts + (best & (1 << 22) - 1)
        ids[at] = best >> 22
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        ids, rank = ids[kept], rank[kept]
        sizes = sizes - 1
        starts = np.cumsum(sizes) - sizes
        at = at - np.arange(len(at))  # one part less for each piece before
        inner = at + 1 < starts + sizes
        rank[at] = known.NONE
        rank[at[inner]] = known.joined(ids[at[inner]], ids[at[inner] + 1])
        left = at[at > starts] - 1
        rank[left] = known.joined(ids[left], ids[left + 1])
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for which, found in parts:
        out[S.ranges(first[which], counts[which])] = found
    return out, counts


class Encoder:
    """Ids of distinct pieces, kept up to CACHE_PIECES pieces and CACHE_IDS ids."""

    def __init__(self, known: Vocabulary, classes: np.ndarray):
        self.vocabulary, self.classes = known, classes
        self._clear(CACHE_PIECES)

    def _clear(self, room: int) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length = np.empty(room, np.int64), np.empty(room, np.int64)

    def _lookup(self, hashes: np.ndarray, piece_at) -> np.ndarray:
        """Cache places of distinct hashes; piece_at gives the bytes of the i-th."""
        if len(self.known) + len(hashes) > len(self.start) or self.used > CACHE_IDS:
            self._clear(max(CACHE_PIECES, len(hashes)))
        keys, known = hashes.tolist(), self.known
        places = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(places < 0)
        if len(new):
            ids, counts = merge_all([piece_at(i) for i in new.tolist()], self.vocabulary)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + len(ids), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            first = len(known)
            self.start[first : first + len(new)], self.length[first : first + len(new)] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
            places[new] = np.arange(first, first + len(new))
            known.update(zip(hashes[new].tolist(), range(first, first + len(new)), strict=True))
        return places

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, their offsets in the bytes of their row, and the rows' bounds among them."""
        starts = piece_bounds(buf, at, self.classes)
        ends = np.append(starts[1:], len(buf))
        distinct, first, back = np.unique(S.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        data = buf.tobytes()
        places = self._lookup(distinct, lambda i: data[starts[first[i]] : ends[first[i]]])[back]
        counts = self.length[places]
        ids = self.flat[S.ranges(self.start[places], counts)]
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, at)]
        # tokens fill the rows like pieces do, so they start where their sizes add up to
        sizes = self.vocabulary.size[ids]
        places_in_all = np.cumsum(sizes) - sizes
        return ids, places_in_all - np.repeat(at[:-1], np.diff(bounds)), bounds


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _rank_file(tokenizers: str, name: str) -> bytes:
    with open(f"{tokenizers}/{name}", "rb") as f:
        return f.read()


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, n_carried: int) -> Iterator[pa.RecordBatch]:
    for part, buf, at in S.slices(batches, "_text"):
        ids, offsets, bounds = encoder.encode(buf, at)
        yield pa.RecordBatch.from_arrays([*part.columns[:n_carried], _lists(ids, bounds), _lists(offsets, bounds)], names=[*part.schema.names[:n_carried], "ids", "offsets"])


def _inputs(docs: DataFrame, tokenizers: str, ranks: str, carry: tuple[str, ...]):
    """The carried columns and the text, their DDL, and what tasks need: a file and a table of fixed size."""
    S.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((_rank_file(tokenizers, ranks), code_point_classes()))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields]
    return docs.select(*carry, docs["text"].alias("_text")), kept, shared


def encode(docs: DataFrame, *, tokenizers: str = TOKENIZERS, ranks: str = BYTE_RANKS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `carry`, ids array<int>, offsets array<int> (bytes of the text before each token)."""
    source, kept, shared = _inputs(docs, tokenizers, ranks, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, classes = shared.value
        yield from _encoded(batches, Encoder(vocabulary(data), classes), len(carry))

    return source.mapInArrow(run, ", ".join([*kept, "ids array<int>", "offsets array<int>"]))


class Spelling:
    """Texts by id, one after another."""

    def __init__(self, texts: dict[int, bytes], n: int):
        self.size = np.full(n, -1, np.int64)
        for i, text in texts.items():
            self.size[i] = len(text)
        held = np.maximum(self.size, 0)
        self.start, self.flat = np.cumsum(held) - held, np.frombuffer(b"".join(texts[i] for i in sorted(texts)), np.uint8)

    def write(self, ids: np.ndarray, out: np.ndarray, places: np.ndarray) -> None:
        """The texts of the ids into `out`, each from its place on."""
        sizes = self.size[ids]
        out[S.ranges(places, sizes)] = self.flat[S.ranges(self.start[ids], sizes)]


@cache
def spellings(data: bytes) -> tuple[Spelling, Spelling]:
    """Of each id the token's bytes, and a comma with its decimal number."""
    known = vocabulary(data)
    n = len(known.size)
    return Spelling({i: t for t, i in known.ranks.items()}, n), Spelling({i: b",%d" % i for i in range(n)}, n)


def _decoded(ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray, tokens: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of `counts` tokens, each token at its offset, and the rows' bounds."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens.size) or (tokens.size[ids] < 0).any()):
        raise ValueError("an id is not in the vocabulary")
    ends, full = np.cumsum(counts) - 1, counts > 0
    n_bytes = np.zeros(len(counts), np.int64)
    n_bytes[full] = offsets[ends[full]] + tokens.size[ids[ends[full]]]
    bounds = np.concatenate([[0], np.cumsum(n_bytes)])
    out = np.zeros(bounds[-1], np.uint8)
    tokens.write(ids, out, np.repeat(bounds[:-1], counts) + offsets)
    return out, bounds


def decode(encoded: DataFrame, *, tokenizers: str = TOKENIZERS, ranks: str = BYTE_RANKS) -> DataFrame:
    """encoded (..., ids, offsets) with the bytes of all tokens, each at its offset, as `decoded` binary."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(_rank_file(tokenizers, ranks))
    names = encoded.columns
    ids_at, offsets_at = names.index("ids"), names.index("offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = spellings(shared.value)
        for batch in batches:
            ids, counts = S.int_lists(batch.column(ids_at))
            out, bounds = _decoded(ids, S.int_lists(batch.column(offsets_at))[0], counts, tokens)
            column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, "decoded"])
        S.trim()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*kept, "decoded binary"]))


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())


def round_trip(docs: DataFrame, *, tokenizers: str = TOKENIZERS, ranks: str = BYTE_RANKS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `carry`, n_tokens, ids_sha256 and decoded_sha256 of texts that are encoded and decoded again in one pass.

    What encode() returns and decode() makes of it, without carrying the ids through the JVM.
    """
    source, kept, shared = _inputs(docs, tokenizers, ranks, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, classes = shared.value
        tokens, numbers = spellings(data)
        for part in _encoded(batches, Encoder(vocabulary(data), classes), len(carry)):
            (ids, counts), (offsets, _) = S.int_lists(part.column(len(carry))), S.int_lists(part.column(len(carry) + 1))
            out, ends = _decoded(ids, offsets, counts, tokens)
            decoded = _digests(out, ends[:-1], ends[1:])
            sizes = numbers.size[ids]
            places = np.cumsum(sizes) - sizes
            listed = np.zeros(int(sizes.sum()), np.uint8)
            numbers.write(ids, listed, places)
            bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            # no comma before a row's first number
            written = _digests(listed, np.minimum(bounds[:-1] + 1, bounds[1:]), bounds[1:])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(counts), written, decoded], names=[*carry, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, ", ".join([*kept, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))
