"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised: every code point of a slice of texts gets a symbol (letter, number, space, other blank,
other, or an apostrophe before an ending), and a symbol is a transition function over the eight states of the pattern's
automaton. Functions are composed by an associative scan: LANE code points in every lane, all lanes at once, then the lanes
by doubling; the states that result tell where pieces begin. The byte slices of pieces go through a cache of merged pairs.
Ids are kept packed; the vocabulary is one array of bytes with offsets, so that decoding is a gather. A map over whole
texts: no shuffle; the cache is bounded by CACHE entries.

Defined results: null or empty text has no ids; repeated rows are encoded each for itself; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common

CACHE = 1_000_000
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: 1.1 MB, built once a worker."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            lo, hi = (a, b) if a > 0xDFFF or b < 0xD800 else (a, b)
            out[lo : hi + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x1C:0x20] = OTHER  # blank for Python, not for Unicode's White_Space
    return out


#: States after a code point: within letters, numbers or others; after a space or another blank; one or two letters before the
#: end of an ending such as 's or 're; after it, and before a text.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT, DONE = range(8)
SPACE, ENDING_OF_ONE, ENDING_OF_TWO, SYMBOLS, STATES, LANE = 4, 5, 6, 7, 8, 64


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """For every symbol and state: the state that follows, and whether a piece begins. Of blanks a piece may begin at the last, too."""
    follows, begins = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        follows[symbol] = state
        begins[symbol, [state, AFTER_SPACE]] = False
    follows[LETTER, TWO_LEFT], follows[LETTER, ONE_LEFT] = ONE_LEFT, DONE
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, state in ((SPACE, AFTER_SPACE), (BLANK, AFTER_BLANK)):
        follows[symbol] = state
        begins[symbol, [AFTER_SPACE, AFTER_BLANK]] = False
    for symbol, state in ((ENDING_OF_ONE, ONE_LEFT), (ENDING_OF_TWO, TWO_LEFT)):
        follows[symbol] = state
        follows[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    return follows, begins


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of every code point; an apostrophe before s, t, d, m or re, ve, ll of the same text has its own."""
    out = classes()[points]
    out[points == 0x20] = SPACE
    marks, n = np.flatnonzero(points == 0x27), len(points)
    if len(marks):
        text = np.cumsum(first)
        at = lambda k: np.where((marks + k < n) & (text[np.minimum(marks + k, n - 1)] == text[marks]), points[np.minimum(marks + k, n - 1)], 0)
        one, two = at(1), at(2)
        out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = ENDING_OF_ONE
        out[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = ENDING_OF_TWO
    return out


def states_before(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before every code point, by a scan over composed transition functions. A text begins in DONE, whatever was before."""
    follows = automaton()[0]
    n = len(symbols)
    lanes = -(-n // LANE)
    # A text's first code point has a constant function: such symbols are numbered behind the others.
    table = np.concatenate([follows, np.repeat(follows[:, DONE :], STATES, axis=1)]).ravel()
    code = np.zeros(lanes * LANE, np.int16)
    code[:n] = (symbols + SYMBOLS * first.astype(np.uint8)).astype(np.int16) * STATES
    code = np.ascontiguousarray(code.reshape(lanes, LANE).T)
    whole = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)  # state before a lane -> state after it
    for k in range(LANE):
        whole = table[code[k] + whole]
    shift = 1
    while shift < lanes:  # f[i] after f[i - shift]
        whole[:, shift:] = np.take_along_axis(whole[:, shift:], whole[:, :-shift].astype(np.intp), axis=0)
        shift *= 2
    state = np.full(lanes, DONE, np.uint8)
    state[1:] = whole[DONE, :-1]
    out = np.empty((LANE, lanes), np.uint8)
    for k in range(LANE):
        out[k] = state
        state = table[code[k] + state]
    out = out.T.ravel()[:n]
    out[first] = DONE
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece begins. points: the code points of texts put together; first: True where a text begins."""
    symbols = symbols_of(points, first)
    start = automaton()[1].ravel()[symbols.astype(np.intp) * STATES + states_before(symbols, first)]
    # The last of several blanks begins a piece if something else follows it in its text.
    blank = (symbols == BLANK) | (symbols == SPACE)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
    return start


class Codec:
    """Encodes and decodes with one vocabulary of ranks; made once a worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted(self.ranks.items(), key=lambda e: e[1])
        # All tokens' bytes in one array; offsets by id, gaps between ids empty.
        sizes = np.zeros(by_id[-1][1] + 1 if by_id else 0, np.int64)
        sizes[[v for _, v in by_id]] = [len(k) for k, _ in by_id]
        self.vocabulary, self.ends = np.frombuffer(b"".join(k for k, _ in by_id), np.uint8), np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.packed: dict[bytes, bytes] = {}
        self.whole = {k: v.to_bytes(4, "little") for k, v in self.ranks.items()}
        self.packed.update(self.whole)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the neighbouring pair of lowest rank again and again."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        pair = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """As merge, with a heap and a linked list: n log n for pieces of any length."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive: list[bytes | None] = list(parts)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if alive[i] is None or j >= n or alive[i] + alive[j] != both:  # type: ignore[operator]
                continue
            alive[i], alive[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for a in (prior[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (r := ranks.get(alive[a] + alive[b])) is not None:  # type: ignore[operator]
                    heapq.heappush(heap, (r, a, alive[a] + alive[b]))  # type: ignore[operator]
        return [ranks[p] for p in alive if p is not None]

    def learn(self, missing: list[bytes]) -> None:
        for p in missing:
            ids = self.merge(p)
            self.packed[p] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        whole = b"".join(raw)
        if not whole:
            return [b""] * len(texts)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum([len(r) for r in raw])
        first = np.zeros(len(points), bool)
        begins = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
        first[begins[begins < len(points)]] = True
        cut = np.append(at[np.flatnonzero(piece_starts(points, first))], len(whole))
        bounds = cut.tolist()
        pieces = [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if len(self.packed) > CACHE:
            self.packed = dict(self.whole)
        ids = common.lookup(pieces, self.packed, self.learn)
        text_end = np.searchsorted(cut, ends).tolist()
        out, begin = [], 0
        for end in text_end:
            out.append(b"".join(ids[begin:end]))
            begin = max(begin, end)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, gathered by their offsets."""
        which = np.frombuffer(ids, "<u4")
        begins, sizes = self.begins[which], self.ends[which] - self.begins[which]
        ends = np.cumsum(sizes)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
        return self.vocabulary[places].tobytes()


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Rows:
    def __init__(self, path: str | None) -> None:
        self.path = path

    def __call__(self, ids: list, texts: list[str]) -> dict:
        c = codec(self.path or default_path())
        packed = c.encode(texts)
        return {
            "doc_id": ids,
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed],
        }


class _Ids:
    def __init__(self, path: str | None) -> None:
        self.path = path

    def __call__(self, ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in codec(self.path or default_path()).encode(texts)]}


def encode_ids(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and ids: the ids of every text. path: a file of ranks that executors see; by default the public one."""
    return common.map_texts(df, _Ids(path), "doc_id long, ids array<int>", text, key)


def byte_bpe(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with digests of its ids and of the bytes they decode to."""
    return common.map_texts(df, _Rows(path), SCHEMA, text, key)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(common.documents(spark, sf_dir))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
