"""Pair the sentences of two texts that are translations of one another.

Word vectors come from the corpus itself: each document with all its translations has a random vector, and
a word's vector is the sum over the documents it stands in, so words that say the same in any two languages
have like vectors. A line's vector is the weighted sum of its words'. The lines of two texts are coupled by
entropic optimal transport with a null line on either side (Sinkhorn scaling); what moves enough mass is a
link. Links that share a line form a group: one to one, a merge, a split, or several with several; a line in
no group was left out or put in.

Each original travels once with up to BUNDLE of its translations (a bundle); an original with very many
translations is dealt out over several tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.garbled import SAME_SHAPE
from quire.llm.lines import TOP, Lines, binary, chunks, clipped, flat, lines_of
from quire.runtime import cut, release, ship, small, spread

#: Words are told apart by a hash of this many bits: the table of their vectors has at most 2**BITS x DIM numbers.
BITS, DIM = 17, 96
#: Texts that are packed together; words of the bundles that are aligned together.
STEP, WORDS = 400, 400_000
#: Translations, and words, after which a bundle is closed and the next one begun.
BUNDLE, BUNDLE_WORDS = 64, 100_000
#: Translations of one original that a task gets at most.
SALT = 4096
#: Cells of a pair of texts up to which its plan is held whole; beyond, it is computed by blocks of rows.
CELLS = 2_000_000
#: Weight of the entropy, Sinkhorn steps, and the cost of leaving a line without partner.
EPSILON, SWEEPS, NULL_COST = 0.05, 40, 0.62
#: What it costs to move a line from a text's beginning to the other's end.
FAR_COST = 0.15
#: Share of the smaller line's mass that a link has to move.
LEAST_MOVED = 0.4
#: A link is kept from this share on if its cosine isn't too low, or else from SURE_COSINE on.
SURE_SHARE, LEAST_COSINE, SURE_COSINE = 0.5, 0.03, 0.2
#: Rounds in which word vectors are learned anew from linked lines, the Sinkhorn steps in them, and how far the
#: vectors' principal directions are brought to equal strength.
ROUNDS, LEARN_SWEEPS, BALANCE = 2, 10, 0.25
#: Weight of a number in a line's vector.
NUMBER_WEIGHT = 6.0
#: Slots from here on are numbers, not words.
_NUMBER = np.uint32(1 << 31)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points; their class (1 letter, 2 digit); powers for hashing."""
    fold = np.arange(TOP, dtype=np.uint32)
    kind = np.zeros(TOP, np.uint8)
    same = dict(zip(*SAME_SHAPE, strict=True))  # letters that look alike are one letter here
    for code in range(TOP):
        c = chr(code)
        k = unicodedata.category(c)
        if k == "Cf" or code == TOP - 1:
            fold[code] = 0
            continue
        c = chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else c
        c = same.get(c, c)
        low = c.lower()
        c = low if len(low) == 1 else c
        fold[code] = ord(c)
        k = unicodedata.category(c)
        kind[code] = 1 if k[0] in "LM" else 2 if k == "Nd" else 0
    power = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
    return fold, kind, power


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word or number in a prose line: its hash, its line, and whether it is a number."""
    fold, kind, power = _tables()
    codes = clipped(lines.codes)
    low = fold[codes]
    keep = low > 0
    at = np.flatnonzero(keep)
    low, cls = low[at], kind[codes[at]]
    # a point or comma between digits belongs to the number, and is written as a point
    if len(low) > 2:
        inner = np.flatnonzero(((low[1:-1] == 44) | (low[1:-1] == 46)) & (cls[:-2] == 2) & (cls[2:] == 2)) + 1
        low = low.copy()
        cls = cls.copy()
        low[inner], cls[inner] = 46, 2
    begun = np.zeros(len(lines.codes) + 1, np.int32)
    begun[lines.start] = 1
    line = np.cumsum(begun)[at] - 1
    cls = np.where(lines.prose[np.minimum(line, len(lines.prose) - 1)], cls, 0) if len(lines.prose) else cls
    first = np.flatnonzero((cls > 0) & (cls != np.concatenate([[0], cls[:-1]])))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.astype(bool)
    inside = np.flatnonzero(cls > 0)
    word = np.cumsum((cls > 0) & (cls != np.concatenate([[0], cls[:-1]])))[inside] - 1
    place = inside - first[word]
    h = np.add.reduceat(low[inside].astype(np.uint64) * power[np.minimum(place, 63)] + place.astype(np.uint64), np.flatnonzero(np.append(True, word[1:] != word[:-1])))
    return _scramble(h + cls[first].astype(np.uint64) * _MIX), line[first], cls[first] == 2


def signs_of(ids: np.ndarray) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each number."""
    out = np.empty((len(ids), DIM), np.float32)
    for k in range(0, DIM, 64):
        h = _scramble(ids.astype(np.uint64) * _MIX + np.uint64(k + 1))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)[:, : min(64, DIM - k)]
        out[:, k : k + bits.shape[1]] = bits * np.float32(2) - 1
    return out


class Words:
    """The prose lines of a batch of texts as word slots, flat: of each line its text, number and words; of each
    word its line. sizes: how many lines each text has; many: how many words each line has."""

    def __init__(self, sizes: np.ndarray, number: np.ndarray, many: np.ndarray, slots: np.ndarray):
        self.sizes = sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.number, self.many = number.astype(np.int64), many.astype(np.int64)
        self.slots = slots
        self.line = np.repeat(np.arange(len(many)), self.many)
        self.starts = np.concatenate([[0], np.cumsum(self.many)]).astype(np.int64)


def pack(texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text three lists of numbers: its prose lines, how many words each has, the words' slots."""
    lines = lines_of(texts)
    h, line, number = words_of(lines)
    slot = np.where(number, h.astype(np.uint32) | _NUMBER, h.astype(np.uint32) & np.uint32((1 << BITS) - 1)).astype(np.uint32)
    rows = np.flatnonzero(lines.prose)
    many = np.bincount(line, minlength=len(lines.start))[rows]
    per_text = np.bincount(lines.text[rows], minlength=len(texts))
    words = np.bincount(lines.text[rows], many, len(texts)).astype(np.int64)
    return binary(lines.number[rows].astype(np.int32), per_text), binary(many.astype(np.int32), per_text), binary(slot, words)


class Sums:
    """Sums of context vectors for each word slot."""

    def __init__(self):  # noqa: ANN204
        self.table = np.zeros((1 << BITS, DIM), np.float32)
        self.count = np.zeros(1 << BITS, np.int64)
        self.total = np.zeros(DIM)
        self.texts = 0

    def add(self, slot: np.ndarray, which: np.ndarray, context: np.ndarray) -> None:
        """Add context[which[i]] to the vector of slot[i]."""
        if not len(slot):
            return
        order = np.argsort(slot, kind="stable")
        s = slot[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(first, len(s)))
        self.table[s[first]] += gather_sum(context, which[order], first, n)
        self.count[s[first]] += n

    def add_texts(self, words: Words, group: np.ndarray, counted: np.ndarray) -> None:
        """Each counted text's group vector for the words it has; a word counts once a text."""
        text = words.text[words.line]
        real = (words.slots < 1 << BITS) & counted[text]
        pair = np.unique(words.slots[real].astype(np.int64) * len(group) + text[real])
        r = signs_of(group)
        self.add(pair // max(len(group), 1), pair % max(len(group), 1), r)
        self.total += r[counted].sum(0)
        self.texts += int(counted.sum())

    def add_lines(self, words: Words, line: np.ndarray, context: np.ndarray) -> None:
        """The context vector of each given line (repeats allowed) for the words of that line."""
        n = words.many[line]
        word = np.repeat(words.starts[line] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        which = np.repeat(np.arange(len(line)), n)
        real = words.slots[word] < 1 << BITS
        self.add(words.slots[word[real]], which[real], context)
        self.total += context.sum(0)
        self.texts += len(line)

    def rows(self) -> pa.RecordBatch:
        """One row a slot seen, and one (slot -1) for all contexts: how many, and their mean."""
        seen = np.flatnonzero(self.count)
        n = np.concatenate([[max(self.texts, 1)], self.count[seen]])
        vectors = (np.concatenate([self.total[None], self.table[seen]]) / n[:, None]).astype(np.float16)  # means, in half precision
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], seen]), pa.int32()), pa.array(np.concatenate([[self.texts], self.count[seen]]), pa.int64()), binary(vectors.ravel(), np.full(len(n), DIM))], names=["slot", "n", "mean"]
        )


class Vectors:
    """Unit word vectors and their weights: a rare word counts more. Only words that were seen have a row; they
    travel in half precision."""

    def __init__(self, slot: np.ndarray, sums: np.ndarray, count: np.ndarray, mean: np.ndarray, texts: int, balance: float = 0.0):
        """balance: how far the principal directions are brought to equal strength (0 not, 0.5 fully)."""
        v = (sums - count[:, None] * mean[None]).astype(np.float32)
        if balance and len(v):
            x = v / np.sqrt(np.maximum(count, 1))[:, None].astype(np.float32)
            value, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
            v = v @ (axes * np.maximum(value, max(value.max() * 1e-4, 1e-12)) ** -balance).astype(np.float32)
        self.slot = slot.astype(np.int32)
        self.unit = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)).astype(np.float16)
        self.weight = np.log((texts + 1) / (np.minimum(count, texts) + 1)).clip(0.1).astype(np.float32)
        self.unseen = np.float32(np.log(texts + 1.0))

    def ready(self) -> Vectors:
        """Lay out the tables for lookups, once a process: row 0 stands for words never seen and for numbers."""
        if not hasattr(self, "row"):
            self.row = np.zeros(1 << BITS, np.int32)
            self.row[self.slot] = np.arange(1, len(self.slot) + 1)
            self.mass = np.concatenate([[self.unseen], self.weight]).astype(np.float32)
            self.heavy = np.concatenate([np.zeros((1, DIM), np.float32), self.unit.astype(np.float32) * self.weight[:, None]])
        return self

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("slot", "unit", "weight", "unseen")}

    def of_lines(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A unit vector for each line, the weight of its words, and a unit vector without its numbers."""
        self.ready()
        number = np.flatnonzero(words.slots >= _NUMBER)
        row = self.row[np.where(words.slots < _NUMBER, words.slots, 0)]
        row[number] = 0
        plain = gather_sum(self.heavy, row, words.starts[:-1], words.many)
        weight = self.mass[row]
        weight[number] = NUMBER_WEIGHT
        mass = np.zeros(len(words.many), np.float32)
        has = np.flatnonzero(words.many)
        if len(has):
            mass[has] = np.add.reduceat(weight, words.starts[has])
        out = plain
        if len(number):  # few, and in order of their lines
            line = words.line[number]
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            out = plain.copy()
            out[line[first]] += np.add.reduceat(signs_of(words.slots[number]) * np.float32(NUMBER_WEIGHT / np.sqrt(DIM)), first)
        return _unit(out), mass, _unit(plain)


def gather_sum(source: np.ndarray, index: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Row sums of source over index[starts[i] : starts[i] + counts[i]]; segments of equal length go together."""
    out = np.zeros((len(starts), source.shape[1]), np.float32)
    order = np.argsort(counts, kind="stable")
    many, first = np.unique(counts[order], return_index=True)
    for n, a, b in zip(many.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if n:
            rows = order[a:b]
            out[rows] = np.take(source, index[starts[rows][:, None] + np.arange(n)], axis=0, mode="clip").sum(1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-6)


def transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Plans of a batch of problems: cost (batch, n, m), masses a (batch, n), b (batch, m), 0 where padded.

    A null line on each side takes any mass at NULL_COST; entropic Sinkhorn scaling, SWEEPS times.
    """
    k, n, m = cost.shape
    c = np.full((k, n + 1, m + 1), NULL_COST, np.float32)
    c[:, :n, :m] = cost
    c[:, n, m] = 0
    a = np.concatenate([a, b.sum(1, keepdims=True)], 1)
    b = np.concatenate([b, a[:, :n].sum(1, keepdims=True)], 1)
    g = np.exp(-c / np.float32(EPSILON)) + np.float32(1e-12)
    v = np.ones_like(b)
    for _ in range(sweeps):
        u = a / np.maximum(np.matmul(g, v[:, :, None])[:, :, 0], 1e-30)
        v = b / np.maximum(np.matmul(u[:, None, :], g)[:, 0], 1e-30)
    return u[:, :n, None] * g[:, :n, :m] * v[:, None, :m]


def transport_by_blocks(va: np.ndarray, vb: np.ndarray, a: np.ndarray, b: np.ndarray, sweeps: int = SWEEPS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The plan of one large problem, by blocks of rows: first row, cosines, mass moved.

    The same scaling as transport(): u of a block depends only on its rows and v, so a sweep is one pass over
    the blocks, which are computed anew from the vectors each time; no more than CELLS cells are held.
    """
    n, m = len(va), len(vb)
    rows = max(1, CELLS // m)
    null = np.float32(np.exp(-NULL_COST / EPSILON) + 1e-12)
    a0, b0 = np.float32(b.sum()), np.float32(a.sum())
    v, v0 = np.ones(m, np.float32), np.float32(1)
    u = np.ones(n, np.float32)

    def block(i: int) -> tuple[np.ndarray, np.ndarray]:
        cos = va[i : i + rows] @ vb.T
        return cos, np.exp(-(1 - cos + np.float32(FAR_COST) * _far(n, m, i, min(i + rows, n))) / np.float32(EPSILON)) + np.float32(1e-12)

    for _ in range(sweeps):
        u0 = a0 / max(null * v.sum() + v0, np.float32(1e-30))
        down = np.full(m, u0 * null, np.float32)
        for i in range(0, n, rows):
            g = block(i)[1]
            u[i : i + rows] = a[i : i + rows] / np.maximum(g @ v + null * v0, 1e-30)
            down += u[i : i + rows] @ g
        v, v0 = b / np.maximum(down, 1e-30), b0 / max(null * u.sum() + u0, np.float32(1e-30))
    for i in range(0, n, rows):
        cos, g = block(i)
        yield i, cos, u[i : i + rows, None] * g * v[None]


def _far(n: int, m: int, start: int, stop: int) -> np.ndarray:
    """How far apart two lines stand in their texts of n and m lines, for some rows."""
    at = np.arange(start, stop, dtype=np.float32) / np.float32(max(n - 1, 1))
    return np.minimum(np.abs(at[:, None] - np.arange(m, dtype=np.float32) / np.float32(max(m - 1, 1))), 1)


def align(a: Words, b: Words, of: np.ndarray, vectors: Vectors, sweeps: int = SWEEPS) -> tuple[np.ndarray, ...]:
    """Links between the lines of the i-th text of a and text of[i] of b: line of a and line of b (places in a and
    b), share of the smaller line's mass that is moved, cosine; and all lines' vectors without numbers."""
    (va, ma, wa), (vb, mb, wb) = vectors.of_lines(a), vectors.of_lines(b)
    ia, ib = np.flatnonzero(ma > 0), np.flatnonzero(mb > 0)
    na = np.bincount(a.text[ia], minlength=len(a.sizes))
    per_b = np.bincount(b.text[ib], minlength=len(b.sizes))
    sa, sb = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(per_b)])[of]
    nb = per_b[of]
    shape = 2 ** np.ceil(np.log2(np.maximum(np.maximum(na, nb), 1))).astype(np.int64)
    both = (na > 0) & (nb > 0)
    huge = both & (na * nb > CELLS)
    out: list[tuple[np.ndarray, ...]] = []
    for size in np.unique(shape[both & ~huge]):
        these = np.flatnonzero((shape == size) & both & ~huge)
        step = max(1, CELLS // int(size * size))
        for at in range(0, len(these), step):
            k = these[at : at + step]
            n, m = int(na[k].max()), int(nb[k].max())
            ra, rb = sa[k][:, None] + np.arange(n), sb[k][:, None] + np.arange(m)
            ha, hb = np.arange(n) < na[k][:, None], np.arange(m) < nb[k][:, None]
            ra, rb = ia[np.where(ha, ra, 0)], ib[np.where(hb, rb, 0)]
            cos = np.matmul(va[ra], vb[rb].transpose(0, 2, 1))
            xa, xb = np.where(ha, ma[ra], 0).astype(np.float32), np.where(hb, mb[rb], 0).astype(np.float32)
            scale = np.maximum(xa.sum(1), xb.sum(1))[:, None]
            # lines seldom move far: a slight cost of distance decides between equals
            pa_ = np.arange(n, dtype=np.float32)[None] / np.maximum(na[k] - 1, 1)[:, None].astype(np.float32)
            pb_ = np.arange(m, dtype=np.float32)[None] / np.maximum(nb[k] - 1, 1)[:, None].astype(np.float32)
            far = np.minimum(np.abs(pa_[:, :, None] - pb_[:, None, :]), 1)
            moved = transport(1 - cos + np.float32(FAR_COST) * far, xa / scale, xb / scale, sweeps) * scale[:, :, None]
            share = moved / np.maximum(np.minimum(xa[:, :, None], xb[:, None, :]), 1e-9)
            p, i, j = np.nonzero((share >= LEAST_MOVED) & ha[:, :, None] & hb[:, None, :])
            out.append((ra[p, i], rb[p, j], share[p, i, j], cos[p, i, j]))
    for k in np.flatnonzero(huge).tolist():
        ra, rb = ia[sa[k] : sa[k] + na[k]], ib[sb[k] : sb[k] + nb[k]]
        xa, xb = ma[ra], mb[rb]
        scale = max(xa.sum(), xb.sum())
        for at, cos, moved in transport_by_blocks(va[ra], vb[rb], xa / scale, xb / scale, sweeps):
            share = moved * scale / np.maximum(np.minimum(xa[at : at + len(cos), None], xb[None]), 1e-9)
            i, j = np.nonzero(share >= LEAST_MOVED)
            out.append((ra[at + i], rb[j], share[i, j], cos[i, j]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float32), none.astype(np.float32), wa, wb
    return *(np.concatenate(x) for x in zip(*out)), wa, wb


def packed(df: DataFrame, key: str, origin: str, text: str) -> DataFrame:
    """key, origin, and each text's prose lines as words (pack). The texts themselves go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, 2, STEP):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *pack(part.column(2).to_pylist())], names=["key", "origin", "number", "many", "slots"])

    d = spread(df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.when(F.col(origin) != F.col(key), F.col(origin).cast("bigint")).alias("origin"), text))
    return d.mapInArrow(run, "key bigint, origin bigint, number binary, many binary, slots binary")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts in order of original, part, role (the original first) and key: one row for an original and up to
    BUNDLE translations. A text delivered again is passed over."""
    names = ["original", "counted", "there", "o_number", "o_many", "o_slots", "keys", "sizes", "number", "many", "slots"]
    done: list[tuple] = []
    head: tuple = (None, None)
    first: tuple | None = None
    held: list[tuple] = []
    last = None
    words = total = 0

    def close() -> None:
        nonlocal first, held, words, total
        if first is None and not held:
            return
        _, counted, there, number, many, slots = first or (None, False, False, b"", b"", b"")
        keys, sizes = np.array([r[0] for r in held], np.int64), np.array([len(r[1]) // 4 for r in held], np.int32)
        done.append((head[0], counted, there, number, many, slots, keys.tobytes(), sizes.tobytes(), *(b"".join(r[k] for r in held) for k in (1, 2, 3))))
        total += words + len(slots) // 4
        # the next bundle of this original has it too, but doesn't count it again
        first, held, words = first and (None, False, *first[2:]), [], 0

    kinds = [pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 8]
    for b in batches:
        for original, part, role, key, counted, number, many, slots in zip(*(b.column(k).to_pylist() for k in range(8))):
            if (original, part) != head:
                close()
                head, first, last = (original, part), None, None
            if (role, key) == last:
                continue
            last = (role, key)
            if role == 0:
                first = (None, counted, True, number, many, slots)
                continue
            held.append((key, number, many, slots))
            words += len(slots) // 4
            if len(held) >= BUNDLE or words >= BUNDLE_WORDS:
                close()
            if total >= WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)
                done, total = [], 0
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)


_BUNDLE = "original bigint, counted boolean, there boolean, o_number binary, o_many binary, o_slots binary, keys binary, sizes binary, number binary, many binary, slots binary"


def bundles(df: DataFrame, key: str, origin: str, text: str) -> DataFrame:
    """Originals with their translations, as written bundles. One shuffle of packed texts.

    A text that is both a translation and an original of others plays both roles. Only originals with more
    than SALT translations, and such texts, need a lookup: its table has at most one row for SALT rows of the
    input and one for each such text, and is broadcast only if it is small.
    """
    ids = df.where(F.col(text).isNotNull() & F.col(key).isNotNull() & F.col(origin).isNotNull() & (F.col(origin) != F.col(key))).select(F.col(key).cast("bigint").alias("key"), F.col(origin).cast("bigint").alias("origin"))
    per = ids.groupBy("origin").agg(F.count("*").alias("n")).select(F.col("origin").alias("original"), F.ceil(F.col("n") / SALT).cast("int").alias("parts"))
    both = ids.select(F.col("key").alias("original")).distinct().withColumn("both", F.lit(True))
    special = cut(per.join(both, "original", "left").where("parts > 1 or both"))
    texts = packed(df, key, origin, text)
    roles = F.array(F.struct(F.lit(0).alias("role"), F.col("key").alias("original")), F.struct(F.lit(1).alias("role"), F.col("origin").alias("original")))
    d = texts.withColumn("x", F.explode(F.filter(roles, lambda x: x["original"].isNotNull()))).select("*", "x.*").drop("x")
    d = d.join(small(special), "original", "left").where("role = 1 or origin is null or both")
    parts = F.coalesce("parts", F.lit(1))
    d = d.withColumn("part", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), parts).cast("int")))))
    d = d.select("original", "part", "role", "key", (F.col("origin").isNull() & (F.col("part") == 0)).alias("counted"), "number", "many", "slots")
    # so many partitions as the session asks for, not fewer: the work on a bundle is more than its bytes tell
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = cut(d.repartition(n, "original", "part").sortWithinPartitions("original", "part", "role", "key", F.xxhash64("slots"), "slots").mapInArrow(_bundles, _BUNDLE))
    release(special)
    return made


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, Words, np.ndarray, np.ndarray]]:
    """Bundles by the some WORDS words: the rows, their translations, their originals, the row of each
    translation, and its key."""
    for b in batches:
        for part in chunks(b, 10, 1 << 30, 4 * WORDS):
            keys, per_row = flat(part.column(6), np.int64)
            t = Words(flat(part.column(7), np.int32)[0], *(flat(part.column(k), d)[0] for k, d in ((8, np.int32), (9, np.int32), (10, np.uint32))))
            number, sizes = flat(part.column(3), np.int32)
            o = Words(sizes, number, flat(part.column(4), np.int32)[0], flat(part.column(5), np.uint32)[0])
            yield part, t, o, np.repeat(np.arange(part.num_rows), per_row), keys


def _summed(rows: DataFrame, balance: float) -> Vectors:
    """Vectors from the partitions' sums. What comes to the driver is one row a slot: 2**BITS at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(((1 << BITS) + 1, DIM), np.float32)  # touched only where slots are; the last row is slot -1
        count = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            slot, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.append(True, slot[order][1:] != slot[order][:-1]))
            at = slot[order][first]
            table[at] += np.add.reduceat(flat(b.column(2), np.float16)[0].reshape(-1, DIM)[order].astype(np.float32) * n[order, None].astype(np.float32), first)
            count[at] += np.add.reduceat(n[order], first)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(seen == 1 << BITS, -1, seen), pa.int32()), pa.array(count[seen], pa.int64()), binary(table[seen].ravel(), np.full(len(seen), DIM))], names=["slot", "n", "sum"])

    got = rows.repartition("slot").mapInArrow(add, "slot int, n bigint, sum binary").toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    sums = np.frombuffer(b"".join(got.column("sum").to_pylist()), np.float32).reshape(-1, DIM)
    real = slot >= 0
    texts = int(n[~real].sum())
    order = np.argsort(slot[real])
    return Vectors(slot[real][order], sums[real][order], n[real][order], sums[~real].sum(0) / max(texts, 1), max(texts, 1), balance)


def groups(t: np.ndarray, o: np.ndarray, n_t: int, n_o: int) -> np.ndarray:
    """What each link is part of: 0 one to one, 1 a merge (a line of the translation renders several lines), 2 a
    split (several lines render one), 3 several with several. t, o: places of the linked lines."""
    more_t, more_o = np.bincount(t, minlength=n_t)[t] > 1, np.bincount(o, minlength=n_o)[o] > 1
    # a link belongs to the group of both its lines
    wide_t, wide_o = np.zeros(n_t, bool), np.zeros(n_o, bool)
    wide_o[o[more_t]] = True  # lines of originals that are in a merge
    wide_t[t[more_o]] = True  # lines of translations that are in a split
    merge, split = more_t | wide_o[o], more_o | wide_t[t]
    return merge + 2 * split


KINDS = np.array(["one", "merge", "split", "several", "omitted", "added"], dtype=object)


def links(df: DataFrame, key: str = "file_id", origin: str = "origin_id", text: str = "content", rounds: int = ROUNDS) -> DataFrame:
    """Columns translation, line_t, origin, line_o, kind, share, cosine: the lines of each translation (a row with
    an origin) and of its origin that say the same, lines counted from 1.

    kind: one (one to one), merge (the line of the translation renders several), split (several render the
    origin's line), several; omitted (a line of the origin that the translation leaves out; line_t, share and
    cosine are null) or added (a line of the translation that renders none; line_o is null).
    Null texts (links) and origins that aren't there have no rows; empty and blank texts have no lines. Repeated
    keys count once. Word vectors are learned from all texts: first from the documents (a text and its
    translations are one document), then rounds times from the linked lines, with each line pair's own vector
    as context.
    """
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    texts = bundles(df, key, origin, text)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b, t, o, of, _ in _opened(batches):
            group = b.column(0).to_numpy()
            sums.add_texts(t, group[of], np.ones(len(of), bool))
            sums.add_texts(o, group, b.column(1).to_numpy(zero_copy_only=False))
        yield sums.rows()

    vectors = _summed(texts.mapInArrow(by_document, "slot int, n bigint, mean binary"), 0.0)
    for _ in range(rounds):
        held = sc.broadcast(vectors)

        def by_link(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            sums, v = Sums(), held.value
            for _, t, o, of, _ in _opened(batches):
                i, j, _, _, wt, wo = align(t, o, of, v, LEARN_SWEEPS)
                c = _unit(wt[i] + wo[j])
                sums.add_lines(t, i, c)
                sums.add_lines(o, j, c)
            yield sums.rows()

        vectors = _summed(texts.mapInArrow(by_link, "slot int, n bigint, mean binary"), BALANCE)
        held.destroy()
    held = sc.broadcast(vectors)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t, o, of, keys in _opened(batches):
            i, j, share, cos, _, _ = align(t, o, of, held.value)
            keep = (share >= SURE_SHARE) & (cos >= LEAST_COSINE) | (cos >= SURE_COSINE)
            i, j, share, cos = i[keep], j[keep], share[keep], cos[keep]
            # of an original each translation has its own lines
            first = np.concatenate([[0], np.cumsum(o.sizes[of])])
            begin = np.concatenate([[0], np.cumsum(o.sizes)])
            own = first[t.text[i]] + j - begin[of[t.text[i]]]
            kind = groups(i, own, len(t.text), int(first[-1]))
            there = b.column(2).to_numpy(zero_copy_only=False)[of]
            added = np.setdiff1d(np.flatnonzero(there[t.text]), i)
            left = np.setdiff1d(np.arange(first[-1]), own)
            whose = np.searchsorted(first, left, side="right") - 1
            originals = b.column(0).to_numpy()
            n, m = len(added), len(left)
            none = lambda k: pa.nulls(k, pa.int64())
            text_ = np.concatenate([t.text[i], t.text[added], whose])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[text_], pa.int64()), pa.concat_arrays([pa.array(np.concatenate([t.number[i], t.number[added]]), pa.int64()), none(m)]), pa.array(originals[of[text_]], pa.int64()),
                    pa.concat_arrays([pa.array(o.number[j], pa.int64()), none(n), pa.array(o.number[begin[of[whose]] + left - first[whose]], pa.int64())]), pa.array(KINDS[np.concatenate([kind, np.full(n, 5), np.full(m, 4)])], pa.string()),
                    *(pa.concat_arrays([pa.array(x, pa.float32()), pa.nulls(n + m, pa.float32())]) for x in (share, cos)),
                ],
                names=["translation", "line_t", "origin", "line_o", "kind", "share", "cosine"],
            )

    return texts.mapInArrow(final, "translation bigint, line_t bigint, origin bigint, line_o bigint, kind string, share float, cosine float")
