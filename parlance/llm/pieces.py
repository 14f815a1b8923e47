"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary is read from a public tokenizer's file; nothing is trained. Encoding follows the agenda rule: of all
candidate merges of neighbouring symbols the one whose merged piece has the best score comes first, the leftmost among
equals. With dropout p, the candidate that comes first is passed over for good if a keyed hash of (seed, key of the text,
number of the chunk in it, step of the agenda) falls below p: each occurrence of a word draws for itself, reruns agree, and
any segmentation decodes to the same text.

Chunks of a slice are encoded together. Occurrences of a word share the work as long as their draws agree: a state is a
chunk after some steps, and each step splits its occurrences into those that merge and those that pass over."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, fresh
from .words import Prefix, U, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20260
NONE = np.int32(2**31 - 1)
#: Chunks of more code points than this have an agenda of their own each.
LONG_CHUNK = 64
#: Bytes of text, or code points of one long text, that are encoded at once.
SLICE = 1 << 19
MASK = (1 << 64) - 1
_A, _B, _C = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] numbers, then the same of start[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Pieces as bytes (a blank for the word mark), characters' ids, and the merges with their ranks.

    No piece may hold a blank but at its start, or a line break: so no piece reaches over the edge of a chunk, which is
    blanks and what follows up to the next blank or line break, or a line break."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte: dict[int, int], blank: str = "▁"):
        texts = [p.replace(blank, " ") if n else "" for p, n in zip(pieces, normal, strict=True)]
        if any("\n" in t for t in texts) or any(" " in t.lstrip(" ") for t in texts):
            raise ValueError("a piece reaches over a chunk's edge")
        ids = {t: i for i, t in enumerate(texts) if t}
        raw = [t.encode() for t in texts]
        for value, i in byte.items():
            raw[i] = bytes([value])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.byte = np.array([byte.get(v, 0) for v in range(256)], np.int32)
        chars = {ord(t): i for t, i in ids.items() if len(t) == 1}
        self.chars = np.full(max(chars) + 2, -1, np.int32)
        self.chars[list(chars)] = list(chars.values())
        order = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-scores[i], i)))}
        merges = {(ids[t[:k]] << 32) + ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.keys = np.array([*merges], np.int64)
        self.into = np.array([*merges.values()], np.int32)
        self.rank = np.array([order[i] for i in self.into.tolist()], np.int32)
        bits = max(4, (4 * len(self.keys)).bit_length())
        self.shift = U(64 - bits)
        slots = [-1] * (1 << bits)
        for i, at in enumerate(self._slot(self.keys).tolist()):
            while slots[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            slots[at] = i
        self.slots = np.array(slots, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(_A)) >> self.shift).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair's merge and the piece that it makes; rank NONE where there is none."""
        key = (left.astype(np.int64) << 32) + right
        slot = self._slot(key)
        at = self.slots[slot]
        others = np.flatnonzero((at >= 0) & (self.keys[at] != key))
        while len(others):
            slot[others] = (slot[others] + 1) & (len(self.slots) - 1)
            at[others] = self.slots[slot[others]]
            others = others[(at[others] >= 0) & (self.keys[at[others]] != key[others])]
        return np.where(at >= 0, self.rank[at], NONE), self.into[at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes that ids stand for, with the blank that encoding puts first."""
        return self.flat[ragged(self.start[ids], self.start[ids + 1] - self.start[ids])]


def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
    if len(byte) < 256:
        raise ValueError("lossless decoding needs a vocabulary with byte fallback")
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return Vocabulary([sp.id_to_piece(i) for i in every], [sp.get_score(i) for i in every], [not special(i) for i in every], byte)


class Encoder:
    def __init__(self, vocab: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.limit, self.seed = vocab, int(dropout * 2**32), seed
        self.known: dict[int, tuple[int, int]] = {}  # merges for the agenda of long chunks, read when one comes

    def passed(self, salt: np.ndarray, step: int) -> np.ndarray:
        """Whether occurrences of these salts pass over the candidate of this step."""
        return (mix(salt + U((step * _A) & MASK)) >> U(32)) < U(self.limit)

    def salts(self, keys: np.ndarray, number: np.ndarray) -> np.ndarray:
        """One hash for each occurrence, of the text's key and the number of the chunk in it."""
        return mix(mix(keys + U((self.seed * _C) & MASK)) + number.astype(U) * U(_B))

    def texts(self, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each text, whether they decode to its bytes) of texts with their keys' hashes."""
        n = np.diff(off)
        some = n > 0
        raw = np.full(len(data) + int(some.sum()), 32, np.uint8)  # a blank before each text that is not empty
        raw[np.arange(len(data)) + np.repeat(np.cumsum(some), n)] = data
        byte_off = off + np.concatenate([[0], np.cumsum(some)])
        code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        char_off = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[byte_off]
        breaks, blanks = code == 10, code == 32
        start = breaks.copy()
        start[1:] |= breaks[:-1] | (blanks[1:] & ~blanks[:-1])
        start[char_off[:-1][some]] = True
        first = np.append(np.flatnonzero(start), len(code))
        row = np.searchsorted(char_off, first[:-1], side="right") - 1
        head = np.searchsorted(row, np.arange(len(n)))
        salt = self.salts(keys[row], np.arange(len(row)) - head[row])
        ids, many = [], np.zeros(len(n), np.int64)
        i = 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(first, first[i] + SLICE, side="right")) - 1)
            made, sizes = self.chunks(code[first[i] : first[j]], first[i : j + 1] - first[i], salt[i:j])
            many += np.bincount(row[i:j], sizes, len(n)).astype(np.int64)
            ids.append(made)
            i = j
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(many)])
        back = self.v.decode(ids)
        bytes_upto = np.concatenate([[0], np.cumsum(self.v.start[ids + 1] - self.v.start[ids])])[upto]
        if (bytes_upto == byte_off).all():
            wrong = np.concatenate([[0], np.cumsum(back != raw)])[byte_off]
            return ids, many, np.diff(wrong) == 0
        fine = [back[bytes_upto[k] : bytes_upto[k + 1]].tobytes() == raw[byte_off[k] : byte_off[k + 1]].tobytes() for k in range(len(n))]
        return ids, many, np.array(fine, bool)

    def chunks(self, code: np.ndarray, first: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each chunk) of the chunks that begin at `first` (the last one is the end)."""
        size = np.diff(first)
        char = self.v.chars[np.minimum(code, len(self.v.chars) - 1)]
        sym = np.where(char >= 0, char, -1 - code.astype(np.int32))  # below 0: a character that no piece has
        short = np.flatnonzero(size <= LONG_CHUNK)
        name = Prefix(code.astype(U) + U(1))(first[short], first[short + 1])
        _, one, state = np.unique(name, return_index=True, return_inverse=True)
        one = short[one]
        pool, lens, final = self._states(sym[ragged(first[one], size[one])], size[one], state, salt[short])
        where = np.zeros(len(size), np.int64)
        where[short] = final
        for k in np.flatnonzero(size > LONG_CHUNK).tolist():
            where[k] = len(lens)
            pool.append(self._agenda(sym[first[k] : first[k + 1]], salt[k : k + 1]))
            lens.append(len(pool[-1]))
        flat, lens = np.concatenate(pool) if pool else np.zeros(0, np.int32), np.array(lens, np.int64)
        strange = np.flatnonzero(flat < 0)
        if len(strange):  # its UTF-8 bytes
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in flat[strange].tolist()]
            many = np.ones(len(flat), np.int64)
            many[strange] = [len(r) for r in raw]
            fill = np.repeat(flat < 0, many)
            lens = np.diff(np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(lens)])])
            flat = np.repeat(flat, many)
            flat[fill] = self.v.byte[np.frombuffer(b"".join(raw), np.uint8)]
        at = np.concatenate([[0], np.cumsum(lens)])
        return flat[ragged(at[where], lens[where])], lens[where]

    def _states(self, sym: np.ndarray, size: np.ndarray, state: np.ndarray, salt: np.ndarray) -> tuple[list[np.ndarray], list[int], np.ndarray]:
        """Distinct chunks (symbols and sizes) and the chunk of each occurrence: symbols and sizes of all results, and the
        result of each occurrence. A round takes each state's next candidate."""
        pool, lens, final, seen = [], [], np.zeros(len(state), np.int64), np.arange(len(state))
        rank, into = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        pair = np.ones(len(sym), bool)
        pair[np.cumsum(size) - 1] = False
        pair = np.flatnonzero(pair)
        rank[pair], into[pair] = self.v.merge(sym[pair], sym[pair + 1])
        step = 0
        while len(size):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, size)
                pool.append(sym[gone])
                ended = over[state]
                final[seen[ended]] = len(lens) + np.cumsum(over)[state[ended]] - 1
                lens += size[over].tolist()
                seen, state = seen[~ended], (np.cumsum(~over) - 1)[state[~ended]]
                sym, rank, into = sym[~gone], rank[~gone], into[~gone]
                size, best = size[~over], best[~over]
                if not len(size):
                    break
            own = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == best[own])
            hit = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
            made, lost = np.ones(len(size), bool), np.zeros(len(size), bool)
            if self.limit:
                passed = self.passed(salt[seen], step)
                lost[state[passed]] = True
                made[:] = False
                made[state[~passed]] = True
            left = made[own]
            left[hit[made] + 1] = False
            place = np.cumsum(left) - 1
            joined = sym.copy()
            joined[hit] = into[hit]
            new = [joined[left], rank[left], into[left], size[made] - 1]
            ends = np.cumsum(new[3])
            at = place[hit[made]]
            new[1][at] = NONE
            redo = np.concatenate([at[at > ends - new[3]] - 1, at[at < ends - 1]])
            new[1][redo], new[2][redo] = self.v.merge(new[0][redo], new[0][redo + 1])
            if lost.any():
                again = lost[own]
                passed_rank = rank.copy()
                passed_rank[hit] = NONE
                new = [np.concatenate(x) for x in zip(new, (sym[again], passed_rank[again], into[again], size[lost]), strict=True)]
                state = np.where(passed, made.sum() + np.cumsum(lost)[state] - 1, np.cumsum(made)[state] - 1)
            sym, rank, into, size = new
            step += 1
        return pool, lens, final

    def _agenda(self, sym: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The same for one long chunk, with a heap: its symbols at the end. Memory follows the chunk's length."""
        if not self.known:
            self.known = dict(zip(self.v.keys.tolist(), zip(self.v.rank.tolist(), self.v.into.tolist(), strict=True), strict=True))
        n, s = len(sym), sym.tolist()
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            found = self.known.get((s[i] << 32) + s[j]) if s[i] >= 0 and s[j] >= 0 else None
            if found:
                heapq.heappush(heap, (found[0], i, j, s[i], s[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        step, draws = 0, np.zeros(0, bool)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if s[i] != a or nxt[i] != j or s[j] != b:
                continue
            if step == len(draws):
                draws = np.concatenate([draws, [self.passed(salt, step + k)[0] for k in range(64)]]) if self.limit else np.zeros(step + 64, bool)
            step += 1
            if draws[step - 1]:
                continue
            s[i], s[j], nxt[i] = m, None, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                offer(i, nxt[j])
            if prv[i] >= 0:
                offer(prv[i], i)
        return np.array([x for x in s if x is not None], np.int32)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The UTF-8 bytes that ids stand for, without the blank that encoding puts first."""
    return vocab.decode(ids).tobytes()[1:]


FIELDS = [T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType()), T.StructField("lossless", T.BooleanType())]


def encode(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with tokens (ids), n_tokens, and lossless: whether decoding them gave the text's bytes again.

    Null texts give null tokens, 0 and true; empty texts no tokens. The draws of a row depend on its key (where that is
    null, on its text), so equal rows get equal tokens. dropout=0 gives the plain BPE segmentation. Columns of those names
    are replaced. Texts of any length are encoded whole, some SLICE code points at a time; what is held at once grows with
    the longest text and, for its longest stretch without blank or line break, by some 300 bytes a character."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # one vocabulary file, about 3 MB
    state: list[Encoder] = []

    def make(keys: pa.Array, column: pa.Array) -> list[pa.Array]:
        if not state:
            state.append(Encoder(shared.value, dropout, seed))
        hashes = keys.to_numpy(zero_copy_only=False).view(U)
        parts = [state[0].texts(data, off, hashes[i : i + len(off) - 1]) for i, data, off in slices(column, SLICE)]
        ids, many, fine = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
        off = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        nulls = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
        tokens = pa.ListArray.from_arrays(pa.array(off, mask=nulls), pa.array(ids))
        return [tokens, pa.array(many.astype(np.int32)), pa.array(fine)]

    own = F.when(F.col(key).isNull(), F.xxhash64(F.col(text), F.lit(1))).otherwise(F.xxhash64(F.col(key)))
    x = fresh(docs, "draw")
    return append(docs.withColumn(x.draw, own), [x.draw, text], FIELDS, make).drop(x.draw)


def decode(tokens: DataFrame, vocab: Vocabulary, column: str = "tokens") -> DataFrame:
    """tokens with decoded, the text that each row's ids stand for; null ids give null. Bytes that are no UTF-8, which
    encoding never makes, become the replacement character."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)

    def make(ids: pa.Array) -> list[pa.Array]:
        out = [None if x is None else decode_ids(shared.value, np.array(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()]
        return [pa.array(out, pa.string())]

    return append(tokens, [column], [T.StructField("decoded", T.StringType())], make)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")
