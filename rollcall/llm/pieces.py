"""SentencePiece encoding and decoding with n-best segmentations.

A text falls into units that no piece crosses. Forward and backward Viterbi scores of all distinct units of a batch are
computed together, by length; they give each unit's best segmentation and how much its second best loses. The n best
segmentations of a text differ from the best only in its n - 1 units with the least loss: over the lattice of these a
backward A-star search runs, for which the forward scores are an exact heuristic. Long units have their lattice made
band by band, so time is linear in the text and memory bounded by a few numbers for each of its characters.

Segmentations are ranked by the sum of their pieces' log-probabilities, as a unigram model ranks them. A BPE model's
scores are no log-probabilities but the ranks of its merges, most frequent first; from these the log-probabilities of
Zipf's law are taken. The best segmentation by these is not what merging gives in the model's own encoder.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm import codes as C
from rollcall.llm.common import documents, rebatched
from rollcall.llm.tokens import vocabulary_path

MARK, LONGEST, BLOCK = "▁", 24, 1 << 21
#: Ends of a band of a long unit's lattice.
BAND = 1 << 14
PENALTY = 10.0
#: Scores are multiples of this, so that sums are exact and equal ones are equal in any order.
GRAIN = 2.0**-20


def log_probabilities(score: np.ndarray) -> np.ndarray:
    """Piece scores as log-probabilities: those of a unigram model as they are, merge ranks (whole numbers) by Zipf's law."""
    if len(score) > 1 and (score == np.floor(score)).all():
        rank = np.empty(len(score))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
        weight = 1 / (rank + 2.7)
        score = np.log(weight / weight.sum())
    return np.round(score / GRAIN) * GRAIN


class Pieces:
    """A SentencePiece model's pieces, with blanks for their blank marks. Characters without a piece become byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.text: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        self.bytes: list[int] = [0] * 256
        self.score = np.zeros(self.size)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            self.score[i] = sp.get_score(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                self.ids[self.text[-1]] = i
        whole = list(self.ids.values())
        self.score[whole] = log_probabilities(self.score[whole])
        self.fallback = float(self.score[whole].min()) - PENALTY
        self.longest = max(len(p.decode()) for p in self.ids)
        blob = b"".join(self.ids)
        size = np.array([len(p) for p in self.ids])
        ends = np.cumsum(size)
        h = C.spans(C.prefix(C.TABLE[np.frombuffer(blob, np.uint8)]), ends - size, ends)
        # piece numbers by 20 bits of their hash; those whose place is taken go to the next table, by other bits
        self.hash_of = np.zeros(self.size, dtype=np.uint64)
        self.hash_of[list(self.ids.values())] = h
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.array(list(self.ids.values()))
        for shift in (44, 22, 0):
            slots = np.full(1 << 20, -1, dtype=np.int32)
            at = self.places(self.hash_of[left], np.uint64(shift))
            slots[at] = left
            self.tables.append((np.uint64(shift), slots))
            left = left[slots[at] != left]
        if len(left):
            raise ValueError("too many pieces share a place")
        used = set(blob)
        self.alone = np.array([c < 128 and c != 32 and c not in used for c in range(256)])  # such a byte is a unit by itself
        crossing = [p for p in self.ids if b" " in p.lstrip(b" ")]
        if crossing:
            raise ValueError("pieces with blanks inside are not supported")

    @staticmethod
    def places(h: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((h >> shift) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for none."""
        shift, slots = self.tables[0]
        out = slots[self.places(h, shift)].astype(np.int64)
        out[self.hash_of[out] != h] = -1
        for shift, slots in self.tables[1:]:
            k = slots[self.places(h, shift)]
            rare = np.flatnonzero(k >= 0)
            hit = rare[self.hash_of[k[rare]] == h[rare]]
            out[hit] = k[hit]
        return out

    def expand(self, char: bytes) -> list[int]:
        return [self.bytes[b] for b in char]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, without the blank that encoding puts first."""
        return b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")[1:]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The piece lattice of a unit: for each end the (start, id or -1, score) of the pieces that end there, starts ascending."""

    def __init__(self, pieces: Pieces, unit: bytes):
        self.pieces, self.raw = pieces, np.frombuffer(unit, np.uint8)
        self.places = np.append(np.flatnonzero((self.raw & 0xC0) != 0x80), len(self.raw))
        self.n = len(self.places) - 1
        self.bands: dict[int, tuple] = {}
        self.forward = array("d", bytes(8 * (self.n + 1)))
        for j in range(1, self.n + 1):
            self.forward[j] = max(self.forward[i] + s for i, _, s in self.into(j))

    def _band(self, band: int) -> tuple[int, list[int], list[int], list[int], list[float]]:
        p, low, high = self.pieces, band * BAND + 1, min(self.n, (band + 1) * BAND)
        base = self.places[max(0, low - p.longest)]
        sums = C.prefix(C.TABLE[self.raw[base : self.places[high]]])
        at = self.places - base if self.n <= BAND else None
        starts, ends, ids = [], [], []
        for size in range(1, min(p.longest, high) + 1):
            end = np.arange(max(low, size), high + 1)
            a, b = (at[end - size], at[end]) if at is not None else (self.places[end - size] - base, self.places[end] - base)
            k = p.lookup(C.spans(sums, a, b))
            hit = np.flatnonzero(k >= 0) if size > 1 else np.arange(len(k))
            starts.append(end[hit] - size)
            ends.append(end[hit])
            ids.append(k[hit])
        start, end, k = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        order = np.lexsort((start, end))
        start, end, k = start[order], end[order], k[order]
        score = np.where(k >= 0, p.score[k], p.fallback)
        return low, np.searchsorted(end, np.arange(low, high + 2)).tolist(), start.tolist(), k.tolist(), score.tolist()

    def into(self, end: int) -> Iterator[tuple[int, int, float]]:
        band = (end - 1) // BAND
        if band not in self.bands:
            while len(self.bands) > 1:
                self.bands.pop(next(iter(self.bands)))
            self.bands[band] = self._band(band)
        low, at, start, k, score = self.bands[band]
        a, b = at[end - low], at[end - low + 1]
        return zip(start[a:b], k[a:b], score[a:b], strict=True)

    def ids(self, start: int, k: int) -> list[int]:
        """The ids of an edge: its piece, or the byte pieces of a character that has none."""
        return [k] if k >= 0 else self.pieces.expand(self.raw[self.places[start] : self.places[start + 1]].tobytes())


class SmallLattice(Lattice):
    """The same for a unit of few characters, by look-ups of its substrings."""

    def __init__(self, pieces: Pieces, unit: bytes):
        self.pieces, self.chars = pieces, [c.encode() for c in unit.decode()]
        self.n = len(self.chars)
        self.edges: list[list[tuple[int, int, float]]] = [[] for _ in range(self.n + 1)]
        for i in range(self.n):
            piece = b""
            for j in range(i, min(self.n, i + pieces.longest)):
                piece += self.chars[j]
                k = pieces.ids.get(piece, -1)
                if k >= 0 or j == i:
                    self.edges[j + 1].append((i, k, float(pieces.score[k]) if k >= 0 else pieces.fallback))
        self.forward = [0.0]
        for into in self.edges[1:]:
            self.forward.append(max(self.forward[i] + s for i, _, s in into))

    def into(self, end: int) -> Iterator[tuple[int, int, float]]:
        return iter(self.edges[end])

    def ids(self, start: int, k: int) -> list[int]:
        return [k] if k >= 0 else self.pieces.expand(self.chars[start])


def lattice(pieces: Pieces, unit: bytes) -> Lattice:
    return SmallLattice(pieces, unit) if len(unit) <= 4 * LONGEST else Lattice(pieces, unit)


def n_best(units: list[Lattice], n: int) -> list[tuple[float, list[list[int]]]]:
    """The n highest-scoring segmentations of some units in a row, best first, as the ids of each unit. Of equal ones
    that with the longer last piece comes first, then that with the longer piece before, and so on.

    Forward Viterbi scores are the best that can still be gained on the way to the start, so an open path's sum is the
    score of its best completion, and completions of different paths differ: no more paths than answers that are still
    wanted need be kept open.
    """
    before = [0.0]
    for u in units:
        before.append(before[-1] + u.forward[u.n])
    agenda: list[tuple] = [(before[-1], 0.0, len(units) - 1, units[-1].n, None)]
    out: list[tuple[float, list[list[int]]]] = []
    while agenda and len(out) < n:
        _, gained, u, at, path = agenda.pop(0)
        while not at and u:
            u, at = u - 1, units[u - 1].n
        if at:
            unit, most = units[u], before[u] + gained
            agenda = [(most + unit.forward[i] + s, gained + s, u, i, (u, i, k, path)) for i, k, s in unit.into(at)] + agenda
            agenda.sort(key=lambda x: -x[0])  # stable: what continues the path that was first comes before its equals
            del agenda[n - len(out) :]
            continue
        ids: list[list[int]] = [[] for _ in units]
        while path is not None:
            u, i, k, path = path
            ids[u] += units[u].ids(i, k)
        out.append((gained, ids))
    return out


def _viterbi(p: Pieces, sums: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best score, loss of the second best, and the best path's starts and ids from the end, of units with one length.

    pos: byte place of every character border, a row per unit.
    """
    u, n = pos.shape[0], pos.shape[1] - 1
    score, piece = np.full((n, n + 1, u), -np.inf), np.full((n, n + 1, u), -1, dtype=np.int64)
    for i in range(n):
        for j in range(i + 1, min(n, i + p.longest) + 1):
            k = p.lookup(C.spans(sums, pos[:, i], pos[:, j]))
            score[i, j] = np.where(k >= 0, p.score[k], p.fallback if j == i + 1 else -np.inf)
            piece[i, j] = k
    forward, back = np.full((n + 1, u), -np.inf), np.zeros((n + 1, u), dtype=np.int64)
    forward[0] = 0
    for j in range(1, n + 1):
        total = forward[:j] + score[:j, j]
        back[j] = np.argmax(total, axis=0)
        forward[j] = np.take_along_axis(total, back[j][None], axis=0)[0]
    behind = np.full((n + 1, u), -np.inf)
    behind[n] = 0
    for i in range(n - 1, -1, -1):
        behind[i] = (score[i, i + 1 :] + behind[i + 1 :]).max(axis=0)
    through = forward[:n, None] + score + behind[None]
    starts, ids = np.full((u, n), -1, dtype=np.int64), np.full((u, n), -1, dtype=np.int64)
    at, row = np.full(u, n), np.arange(u)
    for step in range(n):
        go = row[at > 0]
        if not len(go):
            break
        i = back[at[go], go]
        starts[go, step], ids[go, step] = i, piece[i, at[go], go]
        through[i, at[go], go] = -np.inf
        at[go] = i
    return forward[n], forward[n] - through.reshape(-1, u).max(axis=0), starts, ids


def _unit_starts(p: Pieces, raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a unit: a blank after something else, a byte that is in no piece, and what follows that."""
    space, alone = raw == 32, p.alone[raw]
    start = np.zeros(len(raw) + 1, dtype=bool)
    start[:-1] = space
    start[1:-1] &= ~space[:-1]
    start[:-1] |= alone
    start[1:] |= alone
    return start


#: The ids of the best segmentation of a stretch, its score, and of the units with the least loss: loss, first and last + 1 place in the ids, bytes.
Stretch = tuple[np.ndarray, float, list[tuple[float, int, int, bytes]]]


def _encode_block(p: Pieces, raw: np.ndarray, offs: np.ndarray, n: int) -> Iterator[Stretch]:
    """The best segmentation of each text, or stretch of one, and the n - 1 units that lose least by another."""
    start = _unit_starts(p, raw)
    start[offs] = True
    begin = np.flatnonzero(start[:-1])
    end = np.append(begin[1:], len(raw))
    uoff = np.searchsorted(begin, offs)
    sums = C.prefix(C.TABLE[raw])
    _, first, which = np.unique(C.word_codes(raw, begin, end), return_index=True, return_inverse=True)
    a, b = begin[first], end[first]
    border = np.append((raw & 0xC0) != 0x80, True)
    places = np.flatnonzero(border)
    rank = np.cumsum(border) - 1
    ca, cb = rank[a], rank[b]
    length = cb - ca
    best, loss = np.zeros(len(a)), np.full(len(a), np.inf)
    ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(a)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        if size > LONGEST:
            for r in rows.tolist():
                two = n_best([lattice(p, raw[a[r] : b[r]].tobytes())], 2)
                best[r], ids[r] = two[0][0], np.array(two[0][1][0])
                loss[r] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            continue
        for k in range(0, len(rows), 8192):
            part = rows[k : k + 8192]
            best[part], loss[part], starts, found = _viterbi(p, sums, places[ca[part][:, None] + np.arange(size + 1)])
            bare = ((found < 0) & (starts >= 0)).any(axis=1)
            found, steps = found[:, ::-1], (starts >= 0).sum(axis=1)
            for r, line, m, odd in zip(part.tolist(), found, steps.tolist(), bare.tolist(), strict=True):
                ids[r] = line[size - m :]
                if odd:
                    ids[r] = np.array(n_best([lattice(p, raw[a[r] : b[r]].tobytes())], 1)[0][1][0])
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    at = np.cumsum(sizes) - sizes
    tokens = flat[C.ragged(at[which], sizes[which])]
    edge = np.concatenate([[0], np.cumsum(sizes[which])])
    for d in range(len(offs) - 1):
        x, y = uoff[d], uoff[d + 1]
        mine, origin = which[x:y], edge[x]
        least = []
        if n > 1 and len(mine):
            for i in np.argsort(loss[mine], kind="stable")[: n - 1].tolist():
                if np.isfinite(loss[mine[i]]):
                    least.append((float(loss[mine[i]]), int(edge[x + i] - origin), int(edge[x + i + 1] - origin), raw[a[mine[i]] : b[mine[i]]].tobytes()))
        yield tokens[origin : edge[y]], float(best[mine].sum()), least


def _answers(p: Pieces, parts: list[Stretch], n: int, with_ids: bool) -> list[tuple[float, np.ndarray | None]]:
    """The n best segmentations of a text from those of its stretches; ids of all but the best only if asked for."""
    sizes = [len(x) for x, _, _ in parts]
    ids = np.concatenate([x for x, _, _ in parts]) if len(parts) > 1 else parts[0][0]
    total = sum(t for _, t, _ in parts)
    out = [(total, ids)]
    least = sorted(((loss, at + x, at + y, unit) for at, (_, _, few) in zip(np.cumsum([0, *sizes[:-1]]).tolist(), parts, strict=True) for loss, x, y, unit in few), key=lambda u: u[0])
    if n == 1 or not least:
        return out
    chosen = sorted(least[: n - 1], key=lambda u: u[1])
    units = [lattice(p, unit) for *_, unit in chosen]
    base = total - sum(u.forward[u.n] for u in units)
    for score, own in n_best(units, n)[1:]:
        other = None
        if with_ids:
            cuts = [0, *(z for _, x, y, _ in chosen for z in (x, y)), len(ids)]
            kept = [ids[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
            other = np.concatenate([z for k, o in zip(kept, [*own, []], strict=True) for z in (k, np.array(o, dtype=np.int64))])
        out.append((base + score, other))
    return out


def encode_batch(path: str, texts: list[str], n: int = 1, with_ids: bool = False) -> Iterator[list[tuple[float, np.ndarray | None]]]:
    """(score, ids) of the n best segmentations of each text, best first; the empty text has one, without ids.

    Ids of others than the best are None unless asked for. Texts of more than BLOCK bytes are taken in stretches of
    whole units.
    """
    p = load(path)
    raw, offsets = C.utf8(pa.array([f" {t}" if t else "" for t in texts], pa.large_string()))
    for i, j in C.blocks(offsets, BLOCK):
        part, offs = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) <= BLOCK:
            for x in _encode_block(p, part, offs, n):
                yield _answers(p, [x], n, with_ids)
            continue
        cuts, starts = [0], np.flatnonzero(_unit_starts(p, part))
        while cuts[-1] < len(part):
            far = np.searchsorted(starts, cuts[-1] + BLOCK, side="right")
            near = int(starts[far - 1]) if far and starts[far - 1] > cuts[-1] else (int(starts[far]) if far < len(starts) else len(part))
            cuts.append(near if len(part) - cuts[-1] > BLOCK else len(part))
        del starts
        stretches = [x for c, e in zip(cuts[:-1], cuts[1:], strict=True) for x in _encode_block(p, part[c:e], np.array([0, e - c]), n)]
        yield _answers(p, stretches, n, with_ids)


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded boolean"


def _encode(path: str, n: int, with_ids: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in rebatched(batches):
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for text, answers in zip(texts, encode_batch(path, texts, n, with_ids), strict=True):
                ids = answers[0][1]
                back = p.decode(ids.tolist()) == text
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [round(s, 4) for s, _ in answers], back, [x.tolist() for _, x in answers] if with_ids else None))
            c = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
            names = ["n_pieces", "ids_crc32", "scores", "decoded", "ids"]
            m = 5 if with_ids else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(c[:m], kinds[:m], strict=True))], names=["doc_id", *names[:m]])

    return f


def encode_documents(docs: DataFrame, n: int = 3, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit), the scores of the n best segmentations, best first, and
    whether decoding gives the text back; with_ids the ids of the n best too, a list for each.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no pieces and a score of 0. One row per
    input row; an empty table gives no rows. Equal scores: the segmentation with the longer last piece is the best.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")
    return documents(docs).select("doc_id", "text").mapInArrow(_encode(path, n, with_ids), SCHEMA + (", ids array<array<int>>" if with_ids else ""))
