"""Name the language of each text and of each line that deviates from it, by a byte convolutional network.

The network (embedding of bytes, filters of several widths, max pooling, softmax) is trained in numpy on
labelled texts and applied to batches of fixed-length windows. Each line is cut into windows that cover it
whole; texts sum up their lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.garbled import Bigrams, alphabet, count_all, distinct, label_of, labels, main_label
from quire.llm.lines import TOP, Lines, chunks, clipped, lines_of
from quire.runtime import ship, spread

WINDOW = 64
WIDTHS = {2: 32, 3: 64, 4: 64}
EMBED = 8
#: Labelled texts of each label that the network begins with, at most; taken in the order of a hash of their key.
TRAIN_TEXTS = 400
#: Step size of the pass over all texts. A window whose label has at least LEARNED teaches nothing more there; under
#: TRUSTED, its label is taken to be wrong.
REFINE_RATE, LEARNED, TRUSTED = 1e-4, 0.98, 0.1
STEPS, BATCH = 1400, 128
#: Windows that go through the filters together. Speed only.
BLOCK = 32
#: Distinct lines whose scores a Python worker remembers. Memory only.
MEMO = 100_000
#: Texts that are looked at together.
STEP = 400
#: How much more probable (natural logarithm) another language has to be for a line to deviate.
MARGIN = 2.5
#: The same for a line with characters that the other language doesn't use: it may be damaged.
WIDE_MARGIN = 7.0
#: Share of a language's texts from which it is taken to use a character.
USED = 0.05
_NEUTRAL = re.compile(r"\\[A-Za-z]+(?:\{[^{}\n]*\})*|\$[^$\n]*\$|[{}]")


@cache
def _folded() -> np.ndarray:
    """Lower case, ordinary forms, one space and one digit; 0 for characters without width."""
    table = np.arange(TOP, dtype=np.uint32)
    for code in range(TOP):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or kind == "Cs" or code == TOP - 1:
            table[code] = 0
        elif kind == "Zs" or c in "\t\r\v\f":
            table[code] = 32
        elif kind == "Nd":
            table[code] = 48
        else:
            low = (chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else c).lower()
            table[code] = 48 if low.isdigit() and len(low) == 1 else ord(low) if len(low) == 1 else code
    return table


def line_bytes(lines: Lines) -> tuple[list[bytes], np.ndarray]:
    """The prose lines as folded UTF-8, and their places."""
    codes = _folded()[clipped(lines.codes)]
    codes[lines.codes == 10] = 10
    flat = codes[codes > 0].tobytes().decode("utf-32-le")
    all_lines = _NEUTRAL.sub(" ", flat).replace("\x1e", "").encode("utf-8").split(b"\n")
    at = np.flatnonzero(lines.prose)
    return [all_lines[i].strip() for i in at.tolist()], at


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (bytes, padded with spaces) and the number of the line each belongs to; every byte is in one."""
    cuts, owner = [], []
    for i, t in enumerate(texts):
        if len(t) <= WINDOW:
            cuts.append(t.ljust(WINDOW))
            owner.append(i)
            continue
        n = -(-len(t) // WINDOW)
        for k in range(n):
            a = (len(t) - WINDOW) * k // (n - 1)
            cuts.append(t[a : a + WINDOW])
            owner.append(i)
    return np.frombuffer(b"".join(cuts), dtype=np.uint8).reshape(-1, WINDOW), np.array(owner)


class Network:
    """Byte embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        #: The symbols (see alphabet) that each language uses.
        self.native = np.ones((len(langs), len(alphabet()[1])), bool)
        widest, n = max(WIDTHS), sum(WIDTHS.values())
        self.mask = np.concatenate([np.repeat(np.arange(widest * EMBED)[:, None] < w * EMBED, k, 1) for w, k in WIDTHS.items()], 1).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": (rng.normal(0, 1, (widest * EMBED, n)) / np.sqrt(3 * EMBED)).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": (rng.normal(0, 1, (n, len(langs))) / np.sqrt(n)).astype(np.float32),
            "prior": np.zeros(len(langs), np.float32),
        }

    def _most(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The highest answer of each filter to each window and, if asked for, the first place where it is given.

        A filter's bytes lie side by side in the embedded windows: for each r under the widest width w, the places r,
        r + w, r + 2w ... are one product without a copy, made in the same memory each time. But for r = 0, the last of
        these places is beyond the window.
        """
        w, size, n = max(WIDTHS), x.shape[1], len(self.p["bias"])
        most, left = np.full((len(x), n), -np.inf, np.float32), np.zeros((len(x) * where, n), np.uint8)
        room = np.empty((min(BLOCK, len(x)) * size // w, n), np.float32)
        for a in range(0, len(x), BLOCK):
            some = x[a : a + BLOCK]
            e = np.append(self.p["embed"].take(some, 0).ravel(), np.zeros(w * EMBED, np.float32))
            for r in range(w):
                h = np.matmul(e[r * EMBED : (r - w) * EMBED].reshape(-1, w * EMBED), self.p["filter"], out=room[: some.size // w])
                h = h.reshape(len(some), -1, n)[:, : size // w - (r > 0)]
                top, best, here = h.max(1), most[a : a + BLOCK], left[a : a + BLOCK]
                if where:
                    far = ((h == top[:, None]).view(np.uint8) * (WINDOW - r - w * np.arange(h.shape[1])).astype(np.uint8)[:, None]).max(1)
                    here *= best >= top
                    np.maximum(here, far * (top >= best), out=here)
                np.maximum(best, top, out=best)
        return most, WINDOW - left.astype(np.int64) if where else None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before the softmax, a row a window."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        # after its last byte a window is but spaces; one place there stands for all
        w = max(WIDTHS)
        used = np.where(x != 32, np.arange(1, WINDOW + 1, dtype=np.uint8), np.uint8(0)).max(1, initial=0).astype(np.int64)
        wide = np.minimum(-(-(used + w) // (2 * w)) * 2 * w, WINDOW)
        for size in np.unique(wide).tolist():
            at = np.flatnonzero(wide == size)
            for a in range(0, len(at), 4096):
                some = at[a : a + 4096]
                out[some] = np.maximum(self._most(x[some, :size])[0] + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """STEPS steps of Adam on batches drawn evenly over the languages; as many at every corpus size."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        there = [k for k in range(len(by)) if len(by[k])]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        soft = 0.03  # labels may be wrong
        for step in range(1, STEPS + 1):
            if step == STEPS // 2:  # leave out the windows whose label the network contradicts
                z = self.scores(x)
                z -= z.max(1, keepdims=True)
                z = np.exp(z)
                trusted = z[np.arange(len(y)), y] >= TRUSTED * z.sum(1)
                by = [np.flatnonzero((y == k) & trusted) for k in range(len(self.langs))]
                there = [k for k in range(len(by)) if len(by[k])]
                soft = 0.002
            pick = np.concatenate([rng.choice(by[k], max(1, BATCH // len(there))) for k in there])
            rate = 0.004 * (1 - step / (STEPS + 1)) + 1e-4
            self._step(x[pick], y[pick], rng, m, v2, step, rate, soft)

    def _step(self, xb: np.ndarray, yb: np.ndarray, rng: np.random.Generator, m: dict, v2: dict, step: int, rate: float, soft: float) -> None:
        """One step of Adam, the step-th, on a batch of windows and their languages."""
        w = max(WIDTHS)
        most, top = self._most(xb, where=True)
        a = np.maximum(most + self.p["bias"], 0)
        drop = (rng.random(a.shape) > 0.2) / np.float32(0.8)
        a = (a * drop).astype(np.float32)
        z = a @ self.p["out"] + self.p["prior"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d -= (1 - soft) * np.eye(len(self.langs), dtype=np.float32)[yb] + soft / len(self.langs)
        d /= len(yb)
        g = {"out": a.T @ d, "prior": d.sum(0)}
        da = (d @ self.p["out"].T) * (a > 0) * drop
        g["bias"] = da.sum(0)
        # only the windows at the maxima carry a gradient: for each place in them its sums by byte and filter
        n = da.shape[1]
        at = np.flatnonzero(da)
        f, da = at % n, da.ravel()[at]
        place, seen = at // n * xb.shape[1] + top.ravel()[at], xb.ravel() * np.int64(n)
        g["filter"], g["embed"] = np.empty_like(self.p["filter"]), np.zeros_like(self.p["embed"])
        for j in range(w):
            by = np.bincount(seen[place + j] + f, da, 256 * n).reshape(256, n).astype(np.float32)
            rows = slice(j * EMBED, (j + 1) * EMBED)
            g["filter"][rows] = self.p["embed"].T @ by * self.mask[rows]
            g["embed"] += by @ self.p["filter"][rows].T
        for k in self.p:
            m[k] += 0.1 * (g[k] - m[k])
            v2[k] += 0.01 * (g[k] ** 2 - v2[k])
            self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def lines(self, texts: list[bytes], memo: dict[bytes, np.ndarray]) -> np.ndarray:
        """Log-probabilities of the languages for each line, known lines from the memory."""
        known = {t: memo[t] for t in texts if t in memo}  # kept even if the memory is emptied below
        new = [t for t in dict.fromkeys(texts) if t not in known]
        if new:
            x, owner = windows(new)
            s = self.scores(x)
            solid = (x != 32).sum(1).astype(np.float32) + 1
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # each line has a window
            total = np.add.reduceat(s * solid[:, None], first, dtype=np.float64)
            weight = np.add.reduceat(solid, first, dtype=np.float64)
            # windows of a line speak for it together, though not quite independently of each other
            many = np.diff(np.append(first, len(owner))) ** 0.5
            z = total / weight[:, None] * many[:, None]
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            if len(memo) + len(new) > MEMO:
                memo.clear()
            fresh = dict(zip(new, z.astype(np.float32)))
            memo.update(fresh)
            known |= fresh
        return np.stack([known[t] for t in texts]) if texts else np.zeros((0, len(self.langs)), np.float32)


def train(df: DataFrame, key: str = "file_id", text: str = "content", lang: str = "lang") -> Network:
    """A network begun on the lines of at most TRAIN_TEXTS texts of each label and trained on in a pass over all texts.
    Bigrams and characters are counted over all texts. Labels whose texts are but a mixture of others (wrong labels)
    are no languages; however rare, a language of its own is one."""
    ship(df.sparkSession)
    many = labels(df, lang)
    # a share of each label's hashes that holds somewhat more than its sample goes ahead; no partition sends its own
    share = {x: min(1.0, 1.3 * TRAIN_TEXTS / n) for x, n in many.items()}
    upto = F.create_map(*[F.lit(v) for x, y in share.items() for v in (x, int(-(2**63) + y * (2**64 - 1025)))]) if share else F.create_map(F.lit(""), F.lit(0))
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(main_label(F.col(lang)).alias("_l"), text, F.xxhash64(key).alias("_h"), key)
    rows = sorted(labelled.where(F.col("_h") <= upto[F.col("_l")]).toArrow().to_pylist(), key=lambda r: (r["_l"], r["_h"], r[key]))
    taken: dict[str, int] = {}
    for r in rows:
        taken[r["_l"]] = r["_rank"] = taken.get(r["_l"], 0) + 1
    rows = [r for r in rows if r["_rank"] <= TRAIN_TEXTS]
    known = list(many)
    lines, label = lines_of([r[text] for r in rows]), label_of([r["_l"] for r in rows], known)
    all_texts = spread(df.where(F.col(text).isNotNull()).select(lang, text))
    seen = count_all(all_texts, known)
    real = np.flatnonzero(distinct(seen[0], seen[1][:, -1]))
    made = Network([known[i] for i in real] or ["en"])
    if len(real):
        made.native = Bigrams(*(x[real] for x in seen), made.langs, USED).state == 0
    texts, at = line_bytes(lines)
    x, owner = windows(texts)
    to = np.full(len(known) + 1, -1)
    to[real] = np.arange(len(real))
    y = to[label[lines.text[at]]][owner] if len(owner) else np.zeros(0, np.int64)
    if len(x) and (y >= 0).any():
        made.train(x[y >= 0], y[y >= 0])
        refine(all_texts, made)
    return made


def refine(texts: DataFrame, network: Network) -> None:
    """Train a begun network in one pass over all rows of texts (columns: label, text), in place. Each task goes on from
    it with steps over the windows that it hasn't learned yet; what the tasks change is averaged, by their windows."""
    held = texts.sparkSession.sparkContext.broadcast(network)
    names = sorted(network.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(held.value.langs)
        net.p = {k: v.copy() for k, v in held.value.p.items()}
        m, v2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
        rng, n, steps = np.random.default_rng(5), 0, 0
        wait_x, wait_y = np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
        for b in batches:
            for part in chunks(b, 1, STEP):
                lines = lines_of(part.column(1).to_pylist())
                folded, at = line_bytes(lines)
                label = label_of(part.column(0).to_pylist(), net.langs)[lines.text[at]].tolist()
                at_of: dict[tuple[bytes, int], int] = {}
                which = np.array([at_of.setdefault(k, len(at_of)) for k in zip(folded, label) if k[1] >= 0], np.int64)
                if not len(which):
                    continue
                x, owner = windows([t for t, _ in at_of])
                y = np.array([g for _, g in at_of])[owner]
                many = np.bincount(which, minlength=len(at_of))[owner]  # repeated lines are scored once
                n += int(many.sum())
                z = net.scores(x)
                z = np.exp(z - z.max(1, keepdims=True))
                p = z[np.arange(len(y)), y] / z.sum(1)
                more = np.repeat(np.flatnonzero((p >= TRUSTED) & (p < LEARNED)), many[(p >= TRUSTED) & (p < LEARNED)])
                wait_x, wait_y = np.concatenate([wait_x, x[more]]), np.concatenate([wait_y, y[more]])
                while len(wait_y) >= BATCH:
                    steps += 1
                    net._step(wait_x[:BATCH], wait_y[:BATCH], rng, m, v2, steps, REFINE_RATE, 0.002)
                    wait_x, wait_y = wait_x[BATCH:], wait_y[BATCH:]
        if len(wait_y):
            net._step(wait_x, wait_y, rng, m, v2, steps + 1, REFINE_RATE * len(wait_y) / BATCH, 0.002)
        change = np.concatenate([(net.p[k] - held.value.p[k]).ravel() for k in names]).astype(np.float64) * n
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(change)), pa.int32()), pa.array(change), pa.array(np.full(len(change), n), pa.int64())], names=["i", "change", "n"])

    got = texts.mapInArrow(run, "i int, change double, n bigint").groupBy("i").agg((F.sum("change") / F.sum("n")).alias("change")).toArrow()
    change = np.zeros(sum(network.p[k].size for k in names), np.float32)
    change[got.column("i").to_numpy()] = got.column("change").to_numpy()
    for k in names:
        network.p[k] += change[: network.p[k].size].reshape(network.p[k].shape)
        change = change[network.p[k].size :]


_MEMO: dict[int, dict[bytes, np.ndarray]] = {}


def judge(score: np.ndarray, text: np.ndarray, label: np.ndarray, n_texts: int, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its main language (-1: no prose) and the share of its lines' votes; for each line the
    language it deviates to, or -1."""
    votes = np.zeros((n_texts, score.shape[1]))
    np.add.at(votes, text, np.exp(score))
    has = votes.sum(1) > 0
    tie = votes.copy()
    own = np.flatnonzero(label >= 0)
    tie[own, label[own]] += 0.3  # between two languages with as many lines, the label decides
    main = np.where(has, tie.argmax(1), -1)
    share = votes[np.arange(n_texts), np.maximum(main, 0)] / np.maximum(votes.sum(1), 1e-9)
    best = score.argmax(1) if len(score) else np.zeros(0, np.int64)
    gap = score[np.arange(len(best)), best] - score[np.arange(len(best)), np.maximum(main[text], 0)]
    return main, share, np.where((best != main[text]) & (gap > margin), best, -1)


def sound(lines: Lines, which: np.ndarray, lang: np.ndarray, native: np.ndarray) -> np.ndarray:
    """Which of the given lines have only characters that a language uses."""
    table, _ = alphabet()
    return np.array([native[g, table[clipped(lines.codes[lines.start[i] : lines.stop[i]])]].all() for i, g in zip(which.tolist(), lang.tolist())], bool)


def detect(df: DataFrame, network: Network, key: str = "file_id", text: str = "content", lang: str = "lang") -> DataFrame:
    """Columns key, line_no, lang, confidence, labelled: for each text a row with line_no 0 and its main
    language (null if it has no prose lines), and a row for each prose line in another language.

    labelled tells whether the text's own label names the main language (any case, with or without a
    region). Null texts are left out, empty ones have the row 0 only; repeated rows give repeated rows.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(network)
    number = id(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        memo = _MEMO.setdefault(number, {})
        names = np.array([*net.langs, None], dtype=object)
        for b in batches:
            for part in chunks(b, 2, STEP):
                texts = part.column(2).to_pylist()
                label = label_of(part.column(1).to_pylist(), net.langs)
                lines = lines_of(texts)
                folded, at = line_bytes(lines)
                of, line_no = lines.text[at], lines.number[at]
                score = net.lines(folded, memo)
                main, share, off = judge(score, of, label, len(texts))
                odd = np.flatnonzero(off >= 0)
                odd = odd[sound(lines, at[odd], off[odd], net.native) | (score[odd, off[odd]] - score[odd, main[of[odd]]] > WIDE_MARGIN)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(0), part.column(0).take(pa.array(of[odd], pa.int64()))]),
                        pa.array(np.concatenate([np.zeros(len(texts), np.int64), line_no[odd]]), pa.int64()),
                        pa.array(list(names[main]) + list(names[off[odd]]), pa.string()),
                        pa.array(np.concatenate([share, np.exp(score[odd, off[odd]])]), pa.float64()),
                        pa.array(np.concatenate([(main >= 0) & (main == label), np.ones(len(odd), bool)]), pa.bool_()),
                    ],
                    names=[key, "line_no", "lang", "confidence", "labelled"],
                )

    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(F.col(text).isNotNull()).select(key, lang, text)).mapInArrow(run, f"{key} {kind}, line_no bigint, lang string, confidence double, labelled boolean")
