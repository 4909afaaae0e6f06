"""Find lines that were read with a wrong character encoding, and restore them.

An unknown code-page swap is a substitution cipher: each letter beyond ASCII stands written as one or more
other characters. Bigrams and alphabets of each language are counted over all texts. The cipher of each source
(language) is learned by expectation-maximization against these bigrams: every run of characters that is not
of the alphabet stands for itself or for some letter of the language, and as a cipher is one to one, not for a
letter that the same lines write plainly. A line is damaged if its deciphered reading is much more probable than
what is written; what the cipher is sure of is put back with translate().
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lines import _SPACE, TOP, Lines, chunks, clipped, lines_of
from quire.runtime import cut, release, ship, spread

# Cyrillic letters drawn like Latin ones; both count as one symbol, as either may stand for the other.
SAME_SHAPE = ("АВЕКМНОРСТХІЈЅасеорухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEKMHOPCTXIJSaceopyxijsdqwhlABEZHIKMNOPTYXovj")
# Punctuation beyond ASCII that ordinary texts have.
PUNCTUATION = "–—‘’‚“”„…«»¿¡°·×"


# Signs of units, which stand in any language.
UNITS = "ΩµμÅ"


@cache
def alphabet() -> tuple[np.ndarray, list[str]]:
    """Symbol number of each code point (0: no symbol, left out), and the symbols' characters.

    Characters without width are left out; kinds of space are one symbol, digits another; full-width forms
    and look-alike letters share the symbol of the ordinary one; what is left goes by category.
    """
    signs: list[str] = [""]
    number: dict[str, int] = {}

    def of(c: str) -> int:
        if c not in number:
            number[c] = len(signs)
            signs.append(c)
        return number[c]

    table = np.zeros(TOP, np.int32)
    of(" "), of("0"), of("<lost>")
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        of(c)
    same = dict(zip(*SAME_SHAPE, strict=True))
    for code in range(TOP - 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me", "Cs"):
            continue
        if kind in ("Zs", "Zl", "Zp") or c in "\t\r\n\v\f":
            table[code] = of(" ")
        elif "0" <= c <= "9" or 0xFF10 <= code <= 0xFF19:
            table[code] = of("0")
        elif 0xFF01 <= code <= 0xFF5E:
            table[code] = of(chr(code - 0xFEE0))
        elif c in same:
            table[code] = of(same[c])
        elif c == "�":
            table[code] = of("<lost>")
        elif kind in ("Ll", "Lu", "Lt") and unicodedata.decomposition(c).startswith("<compat>") and unicodedata.normalize("NFKD", c).isascii():
            table[code] = of(unicodedata.normalize("NFKD", c)[-1])  # a ligature counts as its last letter
        elif c in UNITS:
            table[code] = of(c)
        elif code < 0x80 and kind != "Cc" or 0xA1 <= code < 0x180 or 0x400 <= code < 0x492 or c in PUNCTUATION:
            table[code] = of(c)
        else:
            table[code] = of({"L": "<other letter>", "M": "<mark>", "N": "<other number>"}.get(kind[0], "<control>" if kind == "Cc" else "<other sign>"))
    return table, signs


def table_of(c: str) -> int:
    """The symbol of one character."""
    return int(alphabet()[0][min(ord(c), TOP - 1)])


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """Which code points may follow a question mark that ends a question; which symbols are odd by nature."""
    closing = np.zeros(TOP, bool)
    opening = np.zeros(TOP, bool)
    for code in range(TOP):
        c = chr(code)
        closing[code] = not c.isalnum() and c not in "?�\\"
        opening[code] = not c.islower() and c not in "?�"
    _, signs = alphabet()
    odd = np.array([s in ("<control>", "<other sign>", "<other number>", "<mark>", "<lost>") or (len(s) == 1 and ord(s) > 0xA1 and unicodedata.category(s)[0] in "SN") for s in signs])
    return closing, opening, odd


def stream(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all prose lines, each line closed by a space: symbol, the one before, its place in
    lines.codes and its line. A question mark that can't end a question is the symbol of a lost character."""
    table, signs = alphabet()
    closing, opening, _ = _classes()
    codes = clipped(lines.codes)
    size = len(codes)
    mark = np.zeros(size + 2, np.int32)
    mark[lines.start[lines.prose]] += 1  # no place occurs twice in either
    mark[lines.stop[lines.prose] + 1] -= 1
    sym = table[codes]
    ask = np.flatnonzero(codes == ord("?"))
    if len(ask):
        after, later = codes[np.minimum(ask + 1, size - 1)], codes[np.minimum(ask + 2, size - 1)]
        ends = closing[after] & ((after == 10) | opening[later] | ~_SPACE[np.minimum(after, 0xFFFF)])
        sym = sym.copy()
        sym[ask[~ends]] = signs.index("<lost>")
    place = np.flatnonzero((np.cumsum(mark)[:size] > 0) & (sym > 0))
    cur = sym[place]
    begun = np.zeros(size, np.int32)
    begun[lines.start] = 1
    line = np.cumsum(begun)[place] - 1
    before = np.empty_like(cur)
    before[1:] = cur[:-1]
    if len(cur):
        new = np.append(True, line[1:] != line[:-1])
        before[new] = signs.index(" ")
    return cur, before, place, line


def label_of(langs: list[str | None], known: list[str]) -> np.ndarray:
    """The number of each text's label among known (two letters, any case, with or without a region), or -1."""
    at = {x: i for i, x in enumerate(known)}
    return np.array([at.get((x or "").strip().lower().replace("_", "-").split("-")[0], -1) for x in langs], dtype=np.int64)


#: A line of more symbols than this counts as one of this many.
LONG_LINE = 1000


def add_bigrams(into: np.ndarray, lines: Lines, label: np.ndarray, read: tuple) -> None:
    """Add to the table (language, before, symbol) the prose lines that hold no symbol that nobody writes."""
    cur, before, _, line = read
    size = into.shape[1]
    bad = np.zeros(len(lines.start), bool)
    bad[line[_never()[cur]]] = True
    lang = label[lines.text[line]]
    ok = (lang >= 0) & ~bad[line]
    length = np.bincount(line, minlength=len(lines.start))
    weight = np.minimum(1, LONG_LINE / np.maximum(length, 1))[line]  # one endless line must not set the measure
    np.add.at(into.reshape(-1), (lang[ok] * size + before[ok]) * size + cur[ok], weight[ok])  # in place: the table is large


#: Share of a language's texts from which a symbol surely belongs to its alphabet; what is rarer has to be learned.
NATIVE = 0.25
#: Share of a language's texts from which a symbol is a letter that others may stand for while that is learned.
PERHAPS = 0.01
#: Share of a language's symbols that a letter which others stand for has at least.
TARGET = 1e-5


class Bigrams:
    """Smoothed log-probabilities of a symbol after another, and the symbols proper to each language.

    counts: (language, before, symbol); files, rows: texts and lines of each language that hold each symbol,
    the last column all texts and lines. Symbol 0 stands for an unknown neighbour. native: see NATIVE.
    """

    def __init__(self, counts: np.ndarray, files: np.ndarray, rows: np.ndarray, langs: list[str], native: float = NATIVE):
        _, signs = alphabet()
        self.langs = langs
        size = counts.shape[1]
        self.log = np.empty(counts.shape, np.float32)
        share = np.empty(counts.shape[:2], np.float64)
        self.mean = np.empty(len(counts), np.float64)
        for i, c in enumerate(counts.astype(np.float64)):
            one = c.sum(0)
            share[i] = one / max(one.sum(), 1)
            base = (one + 0.05) / (one.sum() + 0.05 * size)
            n = c.sum(1, keepdims=True)
            self.log[i] = np.log((np.maximum(c - 0.75, 0) + (0.75 * (c > 0).sum(1, keepdims=True) + 5) * base) / (n + 5))
            self.mean[i] = (c * self.log[i]).sum() / max(one.sum(), 1)
            self.log[i, 0], self.log[i, :, 0] = np.log(base), 0
        self.ascii = np.array([len(s) == 1 and ord(s) < 128 for s in signs])
        letter = np.array([len(s) == 1 and s.isalpha() or s == "<other letter>" for s in signs])
        pair = _other_case()
        self.in_lines = np.minimum(rows[:, :size] / np.maximum(rows[:, size:], 1), 0.999)
        in_files = files[:, :size] / np.maximum(files[:, size:], 1)
        unit = np.array([x in UNITS and x != "Å" and x != "" for x in signs])
        self.share = share
        # (about half of the Cyrillic letters share a symbol with a Latin one)
        #: Whether most letters of a language are beyond ASCII.
        self.wide = np.array([(x * (letter & ~self.ascii)).sum() > 0.6 * (x * (self.ascii & letter)).sum() for x in share])
        in_files = np.where(_classes()[2], 0, np.maximum(in_files, np.where(letter, in_files[:, pair], 0)))
        self.native = self.ascii | unit | (in_files >= native)
        self._finish(self.native | (in_files >= PERHAPS))

    def _finish(self, letters: np.ndarray) -> None:
        self.native[:, _never()] = False
        #: 0: proper to the language; 2: not surely so.
        self.state = np.where(self.native, 0, 2).astype(np.int8)
        self.state[:, 0] = 0
        self.targets = [np.flatnonzero(letters[i] & ~self.ascii & (self.share[i] >= TARGET) & ~_never()) for i in range(len(self.native))]

    def admit(self, found: list[tuple[int, int]]) -> None:
        """Add (language, symbol) to the alphabets, letters in both cases."""
        pair = _other_case()
        for i, k in found:
            self.native[i, [k, pair[k]]] = True
        self._finish(self.native)


@cache
def _never() -> np.ndarray:
    """Symbols of characters that nobody writes."""
    return np.array([s in ("<lost>", "<control>") for s in alphabet()[1]])


@cache
def _other_case() -> np.ndarray:
    _, signs = alphabet()
    other = {s: (s.lower() if s.lower() != s else s.upper()) for s in signs if len(s) == 1}
    return np.array([signs.index(other[s]) if other.get(s) in signs else k for k, s in enumerate(signs)])


def distinct(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which labels are languages of their own: those whose bigrams (label, before, symbol) aren't just a mixture of
    the commoner labels'. A wrong label, however frequent, says nothing that its texts' true languages don't.

    Each label, the commonest first, is compared with the likeliest mixture of those kept so far: its own
    bigrams, each judged without itself, must add OWN to the mean log-probability of a symbol. Labels of fewer
    than LEAST_TEXTS texts can't be told from slips.
    """
    kept: list[int] = []
    flat = counts.reshape(len(counts), counts.shape[1] * counts.shape[2])
    for k in sorted(range(len(counts)), key=lambda i: (-texts[i], i)):
        n = flat[k].sum()
        if texts[k] < LEAST_TEXTS or n < 2:
            continue
        if kept:
            at = np.flatnonzero(flat[k])
            c = flat[k][at]
            others = np.stack([flat[j][at] / flat[j].sum() for j in kept]) + 1e-9
            w = np.full(len(kept), 1 / len(kept))
            for _ in range(30):
                r = w[:, None] * others
                w = (r / r.sum(0) * c).sum(1) / n
            mixed = w @ others
            own = 0.8 * np.maximum(c - 1, 0) / max(n - 1, 1) + 0.2 * mixed
            if (c * np.log(own / mixed)).sum() / n < OWN:
                continue
        kept.append(k)
    made = np.zeros(len(counts), bool)
    made[kept] = True
    return made


#: Texts that a label needs to count as a language, and what its own bigrams have to add to a symbol's log-probability.
LEAST_TEXTS, OWN = 5, 0.05


#: Symbols of a run that is learned as one piece; longer runs are learned in pieces of one letter's bytes, or singly.
SHORT, LONGEST = 3, 8
#: How much more probable (natural logarithm) a line's deciphered reading has to be than what is written.
GAIN = 3.0
#: The same for a line without any strange symbol, of a language whose letters are mostly beyond ASCII.
WIDE_GAIN = 10.0
#: Probability that a reading needs to be put back.
SURE = 0.9
#: Occurrences that what a run stands for in all languages counts as in each.
POOLED = 2.0
#: By how much a line's mean log-probability a symbol may lie under its language's mean.
SLACK = 1.15
#: The same for languages whose letters are mostly beyond ASCII: there, a swap can turn letters into letters.
WIDE_SLACK = 0.35
#: Share of a run's occurrences below which a letter is none of its readings.
LEAST_SHARE = 1e-3
#: Pieces whose letters, and runs whose readings, a process remembers. Memory only.
KNOWN = 200_000
#: Rows of bigrams that a process holds as lists. Memory only.
ROWS = 2_000
#: Share of a cipher's lines that may hold plainly what it stands for, and the log-odds at which that rules it out.
PLAIN, RULED_OUT = 0.03, -3.0
#: By how much another language may fit a line better (mean log-probability) before it is taken for a foreign line.
FOREIGN = 0.25
#: What a text's label counts for against another language whose alphabet fits no better.
OWN_LABEL = 5.0
#: What a line that holds a letter plainly takes off a reading as that letter.
TWICE = 2.5


def runs(cur: np.ndarray, line: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of strange symbols within a line."""
    new = np.append(True, line[1:] != line[:-1])
    head = strange & (np.append(False, ~strange[:-1]) | new)
    tail = strange & np.append(~strange[1:] | new[1:], True)
    return np.flatnonzero(head), np.flatnonzero(tail)


def strange_runs(cur: np.ndarray, line: np.ndarray, lang: np.ndarray, bigrams: Bigrams) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs that hold a strange symbol. Where a language is written in ASCII letters for the
    most part, a run takes in all symbols beyond ASCII that touch."""
    strange = bigrams.state[lang, cur] > 0
    a, b = runs(cur, line, strange | (~bigrams.ascii[cur] & ~bigrams.wide[lang]))
    if not len(a):
        return a, b
    cum = np.concatenate([[0], np.cumsum(strange)])
    has = cum[b + 1] > cum[a]
    return a[has], b[has]


@lru_cache(100_000)
def pieces(run: str) -> tuple[str, ...]:
    """A long run in pieces: the characters that one letter's UTF-8 bytes were read as, where some code page says so
    (twice, if that was done twice), else single characters."""
    codes = [ord(c) for c in run]
    for page in _bytes_of():
        if not all(c in page for c in codes):
            continue
        try:
            text = bytes(page[c] for c in codes).decode("utf-8")
        except UnicodeDecodeError:
            continue
        out, at = [], 0
        again = pieces(text) if not text.isascii() and len(text) < len(run) else tuple(text)
        for part in again:
            n = len(part.encode("utf-8"))
            out.append(run[at : at + n])
            at += n
        return tuple(out)
    return tuple(run)


def add_contexts(into: dict, lines: Lines, label: np.ndarray, bigrams: Bigrams, read: tuple) -> None:
    """Add to (language, run as written, before, after) -> count the strange runs: before and after are its
    neighbours (0: unknown), or before -1: a symbol that its line holds plainly, or before -2: the lines."""
    _, signs = alphabet()
    cur, before, place, line = read
    if not len(cur) or not len(bigrams.log):
        return
    lang = label[lines.text[line]]
    strange = np.zeros(len(lines.start), bool)
    strange[line[(lang >= 0) & (bigrams.state[np.maximum(lang, 0), cur] > 0)]] = True
    keep = strange[line]
    cur, before, place, line, lang = cur[keep], before[keep], place[keep], line[keep], lang[keep]
    if not len(cur):
        return
    # a line in another language than its text teaches nothing about this one
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(first, len(cur)))
    means = np.stack([np.add.reduceat(x[before, cur], first) for x in bigrams.log], 1) / size[:, None]
    own = lang[first]
    keep = np.repeat((means.max(1) - means[np.arange(len(own)), own] <= FOREIGN) | bigrams.wide[own], size)
    cur, place, line, lang = cur[keep], place[keep], line[keep], lang[keep]
    if not len(cur):
        return
    space = signs.index(" ")
    a, b = strange_runs(cur, line, lang, bigrams)
    if not len(a):
        return
    inside = np.zeros(len(cur) + 1, np.int32)
    inside[a] += 1
    inside[b + 1] -= 1
    plain = (np.cumsum(inside)[:-1] == 0) & ~bigrams.ascii[cur]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    ends = np.append(first[1:], len(cur))
    seen, last = set(), -1
    after = np.where((b + 1 < len(cur)) & (np.append(line, -1)[b + 1] == line[b]), np.append(cur, 0)[b + 1], space)
    ahead = np.where((a > 0) & (line[a - 1] == line[a]), cur[a - 1], space)
    texts, _, _, gone = written(lines, place, cur, a, b)
    for text, lost, short, g, p, n, w in zip(texts, gone, (b - a < SHORT).tolist(), lang[a].tolist(), ahead.tolist(), after.tolist(), (np.searchsorted(first, a, side="right") - 1).tolist()):
        parts = (text,) if short and not bigrams.wide[g] or lost else pieces(text)
        if w != last:
            seen, last = set(), w
            held = set(cur[first[w] : ends[w]][plain[first[w] : ends[w]]].tolist())
        for k, part in enumerate(parts):
            key = (g, part, p if k == 0 else 0, n if k == len(parts) - 1 else 0)
            into[key] = into.get(key, 0) + 1
            if part not in seen:
                seen.add(part)
                into[g, part, -2, 0] = into.get((g, part, -2, 0), 0) + 1
                for x in held:
                    into[g, part, -1, x] = into.get((g, part, -1, x), 0) + 1


def written(lines: Lines, place: np.ndarray, cur: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Runs as written, with characters without width that stand between their symbols, where each begins and ends in
    lines.codes, and whether a symbol in it is lost; such a run is written as U+FFFD. A soft hyphen right after a run
    belongs to it (as a byte that was read so)."""
    lost = np.concatenate([[0], np.cumsum(cur == alphabet()[1].index("<lost>"))])
    gone = (lost[b + 1] > lost[a]).tolist()
    end = place[b] + 1
    end += np.append(lines.codes, 0)[end] == 0xAD
    begin, ends = place[a].tolist(), end.tolist()
    whole = lines.codes.tobytes().decode("utf-32-le", "replace")
    return ["\ufffd" * min(n, LONGEST) if g else whole[i:j] for i, j, n, g in zip(begin, ends, (b - a + 1).tolist(), gone)], begin, ends, gone


def fit_itself(run: str, log: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-probability of a run as written between neighbours; impossible for what no text is written with."""
    _, signs = alphabet()
    own = [k for k in map(table_of, run) if k]
    if not own or any(signs[k] in ("<lost>", "<control>") for k in own):
        return np.full(len(p), -99.0)
    return log[p, own[0]] + log[own[-1], n] + sum(float(log[x, y]) for x, y in zip(own, own[1:]))


def decipher(run: str, seen: dict[int, tuple], bigrams: Bigrams, steps: int = 8) -> dict[int, tuple[float, np.ndarray]]:
    """What a run stands for in each language: (share of itself, shares of the language's letters).

    seen: language -> neighbours before, after, their counts, lines, and how many of these hold each symbol plainly.
    Expectation-maximization: each occurrence is shared out among the letters and the run itself, by their
    bigrams with its neighbours and by what the run has stood for so far. A second turn takes what it stands
    for in all languages together as a hint for each of them.
    """
    made: dict[int, tuple[float, np.ndarray]] = {}
    pooled = np.zeros(bigrams.log.shape[1] + 1)
    for turn in range(2):
        for i, (p, n, c, rows, plain) in seen.items():
            letters = bigrams.targets[i]
            log = bigrams.log[i]
            fit = np.column_stack([log[p][:, letters] + log[letters][:, n].T, fit_itself(run, log, p, n)])
            # a cipher is one to one: a letter that these lines hold plainly isn't what the run stands for
            base, held = bigrams.in_lines[i][letters], plain[letters]
            odds = held * np.log(PLAIN / np.maximum(base, PLAIN)) + (rows - held) * np.log((1 - PLAIN) / np.minimum(1 - base, 1 - PLAIN))
            fit[:, :-1][:, odds < RULED_OUT] = -np.inf
            hint = np.append(np.full(len(letters), 1e-3), 0.05)
            if turn:
                every = np.append(pooled[letters], pooled[-1])
                hint += POOLED * every / max(every.sum(), 1e-9)
            q = hint / hint.sum()
            for _ in range(steps):
                r = fit + np.log(q)
                r = np.exp(r - r.max(1, keepdims=True))
                r /= r.sum(1, keepdims=True)
                q = (c[:, None] * r).sum(0) + hint
                q /= q.sum()
            made[i] = (float(q[-1]), q[:-1].astype(np.float32))
            if not turn:
                pooled[letters] += c.sum() * q[:-1]
                pooled[-1] += c.sum() * q[-1]
    return made


class Cipher:
    """What each strange run stands for, for each source (language): run -> shares of its letters and of itself."""

    def __init__(self, bigrams: Bigrams, table: dict[tuple[int, str], tuple[float, np.ndarray]], many: dict[tuple[int, str], float]):
        self.bigrams, self.table, self.many = bigrams, table, many
        self.longest = max((len(run) for _, run in table), default=0)
        self._known: dict[tuple[int, str], list[tuple[int, float]] | None] = {}
        self._read: dict[tuple, tuple[float, float, list[int], float]] = {}
        self._parts: dict[tuple[int, str], tuple[list[tuple[int, int, list[tuple[int, float]]]], list[int], float, float]] = {}
        self._symbols = 0
        self._rows: dict[tuple[int, int], list[float]] = {}
        self._runs: dict[int, set[str]] = {}
        for g, run in table:
            self._runs.setdefault(g, set()).add(run)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_read": {}, "_parts": {}, "_symbols": 0, "_rows": {}}

    def letters(self, lang: int, run: str) -> list[tuple[int, float]] | None:
        """The letters that a piece may stand for in a language, with their log-shares, and itself where it is one
        symbol of the alphabet; None if it isn't known, or if its parts are known and each is seen more often than
        the whole: then it is several letters."""
        key = (lang, run)
        if key not in self._known:
            q = self.table.get(key)
            for k in range(1, len(run)) if q is not None else ():
                parts = [x for x in (run[:k], run[k:]) if not (self.proper(lang, x) and x.isalpha())]
                if parts and all((lang, x) in self.table and self.many[lang, x] > self.many[key] for x in parts):
                    q = None
                    break
            if q is not None:
                at = np.flatnonzero(q[1] >= LEAST_SHARE)
                made = list(zip(self.bigrams.targets[lang][at].tolist(), np.log(q[1][at]).tolist()))
            else:
                made = [(k, 0.0)] if len(run) == 1 and self.bigrams.state[lang, k := table_of(run)] == 0 else None
            if len(self._known) > KNOWN:
                self._known.clear()
            self._known[key] = made
        return self._known[key]

    def proper(self, lang: int, run: str) -> bool:
        return all(self.bigrams.state[lang, table_of(c)] == 0 for c in run)

    def itself(self, lang: int, run: str) -> float:
        """Log-share of a run that stands for itself; certain where nothing was learned."""
        parts = [run] if (lang, run) in self.table else [c for c in run if (lang, c) in self.table]
        return sum(float(np.log(max(self.table[lang, x][0], 1e-4))) for x in parts)

    def read(self, lang: int, run: str, before: int, after: int, plain: frozenset = frozenset(), sure: bool = True) -> tuple[float, float, list[int], float]:
        """Log-probability of the best reading of a run between its neighbours, that of the run as written, the
        symbols of the reading and how sure they are (if asked for). A run is read in the pieces that the cipher
        knows, from left to right (Viterbi); plain: symbols that the line holds elsewhere. Readings are remembered."""
        key = (lang, run, before, after, plain, sure)
        if key not in self._read:
            if len(self._read) > KNOWN:
                self._read.clear()
            self._read[key] = self._best(*key)
        return self._read[key]

    def parts(self, lang: int, run: str) -> tuple[list[tuple[int, int, list[tuple[int, float]]]], list[int], float, float]:
        """What holds for a run between any neighbours: from where to where there is a known piece, and its letters;
        its symbols as written, their log-probability among themselves (impossible: see fit_itself) and itself()."""
        key = (lang, run)
        if key not in self._parts:
            if self._symbols > KNOWN:  # by their length, as one may be long
                self._parts.clear()
                self._symbols = 0
            self._symbols += len(run)
            reach, log, held = max(self.longest, 1), self.bigrams.log[lang], self._runs.get(lang, set())
            spans = [(i, j, run[i:j]) for j in range(1, len(run) + 1) for i in range(max(0, j - reach), j)]
            cuts = [(i, j, to) for i, j, x in spans if (j - i == 1 or x in held) and (to := self.letters(lang, x)) is not None]
            own = [k for k in map(table_of, run) if k]
            if any(_never()[own]):
                own = []
            self._parts[key] = cuts, own, sum(float(log[x, y]) for x, y in zip(own, own[1:])), self.itself(lang, run)
        return self._parts[key]

    def _row(self, lang: int, before: int) -> list[float]:
        """The log-probabilities of all symbols after one."""
        key = (lang, before)
        if key not in self._rows:
            if len(self._rows) > ROWS:
                self._rows.clear()
            self._rows[key] = self.bigrams.log[lang, before].tolist()
        return self._rows[key]

    def _best(self, lang: int, run: str, before: int, after: int, plain: frozenset, sure: bool) -> tuple[float, float, list[int], float]:
        log = self.bigrams.log[lang]
        cuts, own, inner, itself = self.parts(lang, run)
        stays = (float(log[before, own[0]] + log[own[-1], after] + inner) if own else -99.0) + itself
        step = log.item
        # for each place: last symbol read -> best and total log-probability, and the place and symbol before it
        at: list[dict[int, tuple[float, float, int, int]]] = [{before: (0.0, 0.0, -1, 0)}] + [{} for _ in run]
        ways: list[list[tuple[int, float, float, list[float]]] | None] = [None] * len(at)
        for i, j, to in cuts:
            if not at[i]:
                continue
            here = at[j]
            if (froms := ways[i]) is None:  # nothing more comes to a place once something goes on from it
                froms = ways[i] = [(s0, b0, t0, self._row(lang, s0)) for s0, (b0, t0, *_) in at[i].items()]
            for s, gain in to:
                if not s:  # a character without width: nothing changes
                    for s0, b0, t0, _ in froms:
                        if s0 not in here or b0 > here[s0][0]:
                            here[s0] = (b0, t0, i, -1)
                    continue
                if s in plain and gain < 0:
                    gain -= TWICE
                best, k = -math.inf, 0
                for s0, b0, _, row in froms:
                    x = b0 + row[s]
                    if x > best:
                        best, k = x, s0
                best += gain
                t = _log_sum([t0 + row[s] for _, _, t0, row in froms]) + gain if sure else 0.0
                if s in here:
                    b1, t1, i1, k1 = here[s]
                    t = _log_sum([t, t1]) if sure else 0.0
                    here[s] = (b1, t, i1, k1) if b1 >= best else (best, t, i, k)
                else:
                    here[s] = (best, t, i, k)
        if not at[-1]:
            return -np.inf, stays, [], 0.0
        end, s = max((b + step(s, after), s) for s, (b, *_) in at[-1].items())
        whole = _log_sum([t + step(x, after) for x, (_, t, *_) in at[-1].items()]) if sure else end
        out, j = [], len(run)
        while j > 0:
            _, _, i, k = at[j][s]
            if k >= 0:
                out.append(s)
                s = k
            j = i
        return end, stays, out[::-1], min(float(np.exp(end - whole)), 1.0)


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(y - top) for y in x)) if top > -math.inf else top


@cache
def pages() -> np.ndarray:
    """The characters (page, byte) of each single-byte code page that holds ASCII; bytes without one stand for themselves."""
    seen: dict[bytes, np.ndarray] = {}
    for name in sorted(set(aliases.values())):
        try:
            made = [bytes([x]).decode(name, "replace") for x in range(256)]
        except (LookupError, UnicodeError):
            continue
        if all(len(c) == 1 and ord(c) < 0x10000 for c in made) and all(made[x] == chr(x) for x in range(32, 127)):
            codes = np.array([x if c == "\ufffd" else ord(c) for x, c in enumerate(made)], np.int32)
            seen.setdefault(codes.tobytes(), codes)
    return np.stack(list(seen.values()))


@cache
def _bytes_of() -> list[dict[int, int]]:
    """For each page the byte of each character beyond ASCII."""
    return [{int(c): x for x, c in enumerate(p) if x > 127} for p in pages()]


_BEYOND = re.compile(r"[^\x00-\x7f]+")


@lru_cache(10_000)
def _keys(beyond: tuple[int, ...]) -> set[tuple[int, ...]]:
    """The bytes (-1: none) that stand for these characters, page by page."""
    return {tuple(b.get(c, -1) for c in beyond) for b in _bytes_of()}


def swaps(text: str, native: np.ndarray, single: bool) -> list[tuple[str, bool]]:
    """What a line can have read before it was read in another code page, and whether nothing was lost: UTF-8 first;
    if none fits, texts of the single-byte pages whose characters beyond ASCII are all proper (native: language,
    symbol) to one language. There, up to a fifth of the characters beyond ASCII may be none of the page's."""
    beyond = sorted({ord(c) for c in text if ord(c) > 127})
    if not beyond or beyond[-1] >= TOP:
        return []
    table, symbols = alphabet()[0], np.array(beyond)
    made, keys = [], _keys(tuple(beyond))
    begun = [ord(c) for c in _BEYOND.search(text).group()]
    for key in keys:
        if -1 in key:
            continue
        at = dict(zip(beyond, key))
        try:
            bytes(at[c] for c in begun).decode("utf-8")  # stretches beyond ASCII are valid each for itself
            made.append(bytes(at.get(ord(c), ord(c)) for c in text).decode("utf-8"))
        except UnicodeDecodeError:
            continue
    if made:  # and what was read so twice
        return [(y, True) for y in sorted({y for x in made for y in ([x] if x.isascii() else [x, *_twice(x)])})]
    if not single:
        return []
    texts: set[tuple[str, bool]] = set()
    for key in keys:
        there = np.array(key) >= 0
        if there.mean() < 0.8:
            continue
        new = pages()[:, np.maximum(key, 0)]
        fits = (native[:, table[clipped(new)]] | ~there).all(2).any(0) & ((new != symbols) & there).any(1)
        texts |= {(text.translate({b: int(y) if t else 0xFFFD for b, y, t in zip(beyond, x, there)}), bool(there.all())) for x in new[fits]}
    return sorted(texts)


def _twice(text: str) -> list[str]:
    """What a text that UTF-8 was already read back from can have been before."""
    made = set()
    for page in _bytes_of():
        try:
            made.add(bytes(page[ord(c)] if ord(c) > 127 else ord(c) for c in text).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    return sorted(made)


def reread(texts: list[str], bigrams: Bigrams, written: list[float], single: list[bool]) -> list[tuple[str | None, float]]:
    """For each line its text in the code page it was written in, where one reading is surely the most probable by
    the bigrams of one language, as probable as that language's lines, and without strange symbols; and by how
    much (natural logarithm) that is more probable than the line as written. single: whether single-byte pages
    are tried, too; that a line is valid UTF-8 in some page is hardly ever chance."""
    native = bigrams.state == 0
    tried = [swaps(x, native, y) for x, y in zip(texts, single)]
    flat = [y for t in tried for y, _ in t]
    if not flat:
        return [(None, 0.0)] * len(texts)
    lines = lines_of(flat)
    cur, before, _, line = stream(lines)
    at, n = lines.text[line], len(flat)
    size = np.maximum(np.bincount(at, minlength=n), 1)
    total = np.stack([np.bincount(at, x[before, cur], n) for x in bigrams.log])
    lost = alphabet()[1].index("<lost>")
    clean = np.stack([np.bincount(at, (x[cur] > 0) & (cur != lost), n) == 0 for x in bigrams.state])
    fair = clean & (total / size >= bigrams.mean[:, None] - SLACK) & (np.bincount(at, minlength=n) > 0)
    score = np.where(fair, total, -np.inf).max(0)
    out: list[tuple[str | None, float]] = []
    k = 0
    for t, plain in zip(tried, written):
        s, k = score[k : k + len(t)], k + len(t)
        best = int(s.argmax()) if len(s) else -1
        sure = best >= 0 and np.isfinite(s[best]) and 1 / np.exp(s - s[best]).sum() >= SURE
        out.append((t[best][0] if t[best][1] else None, float(s[best]) - plain) if sure else (None, 0.0))
    return out


def damaged(lines: Lines, label: np.ndarray, cipher: Cipher, restore: bool = False) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Numbers of the damaged lines, the language each was judged by, and (restore) what they read, where
    every strange run has one sure reading, or the whole line has one in another code page (reread), and nothing
    was lost; else null.

    A line with strange runs is read in its text's language and in the one that fits best as written; the more
    probable reading counts. It is damaged if reading its runs by the cipher gains GAIN. A line without strange
    runs, but far less probable than its language's lines, is damaged if some code page explains it (reread).
    """
    _, signs = alphabet()
    bigrams = cipher.bigrams
    cur, before, place, line = stream(lines)
    if not len(cur) or not len(bigrams.log):
        return line[:0], line[:0], []
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    which = line[first]
    size = np.diff(np.append(first, len(cur)))
    own = label[lines.text[which]]
    at = np.maximum(np.repeat(own, size), 0)
    mean = np.add.reduceat(bigrams.log[at, before, cur], first) / size
    suspect = np.add.reduceat((bigrams.state[at, cur] > 0).astype(np.int32), first) > 0
    suspect |= (own < 0) | (mean < bigrams.mean[np.maximum(own, 0)] - SLACK / 2)
    at = np.flatnonzero(np.repeat(suspect, size))
    if not len(at):
        return which[:0], own[:0], []
    cur, before, place, line = cur[at], before[at], place[at], line[at]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    which, size = line[first], np.diff(np.append(first, len(cur)))
    own = label[lines.text[which]]
    sums = np.stack([np.add.reduceat(x[before, cur], first) for x in bigrams.log], 1)
    tied = sums / size[:, None]
    has = np.flatnonzero(own >= 0)
    tied[has, own[has]] += 0.35  # a text's label counts for something
    odd = np.stack([np.add.reduceat((x[cur] > 0).astype(np.int32), first) for x in bigrams.state], 1)
    best = (tied - 10 * odd / size[:, None]).argmax(1)  # and so does a language to which the symbols are proper
    low = sums[np.arange(len(best)), best] / size < bigrams.mean[best] - np.where(bigrams.wide[best], WIDE_SLACK, SLACK)
    space = signs.index(" ")
    hit = np.zeros(len(which), bool)
    texts: list[str | None] = [None] * len(which)
    todo = (odd[np.arange(len(best)), best] > 0) | low
    tried: dict[int, list[tuple]] = {k: [] for k in np.flatnonzero(todo).tolist()}
    for ways in (best, np.where(own != best, own, -1)):
        keep = np.repeat(todo & (ways >= 0), size)
        _read_lines(tried, cur[keep], before[keep], place[keep], line[keep], np.repeat(ways, size)[keep], np.repeat(np.arange(len(which)), size)[keep], lines, cipher, sums, own, odd, best, restore, space)
    whole: list[int] = []
    for k, tries in tried.items():
        _, gain, g, found = max(tries, key=lambda x: x[:3])
        hit[k] = gain >= GAIN
        best[k] = g
        if restore or not hit[k]:
            whole.append(k)
        if restore and hit[k] and not low[k] and all(t is not None for *_, t in found):
            # one table for the line: each run becomes a private character that translate() replaces
            w = which[k]
            out, at_, table = [], lines.start[w], {}
            for n_, (i, j, t) in enumerate(found):
                out.append(lines.codes[at_:i].tobytes().decode("utf-32-le"))
                out.append(chr(0xF0000 + n_))
                table[0xF0000 + n_] = t
                at_ = j + 1
            out.append(lines.codes[at_ : lines.stop[w]].tobytes().decode("utf-32-le"))
            texts[k] = "".join(out).translate(table)
    # all symbols of a line at once: lines damaged throughout; and where one code page explains the whole line, it
    # corrects what the cipher reads piece by piece
    for k, (t, gain) in zip(whole, reread([lines.string(int(which[x])) for x in whole], bigrams, [float(sums[x].max()) for x in whole], [bool(low[x] or hit[x]) for x in whole])):
        hit[k] |= gain >= (GAIN if odd[k, best[k]] or not bigrams.wide[best[k]] else WIDE_GAIN)
        texts[k] = texts[k] if t is None else t
    hits = np.flatnonzero(hit)
    return which[hits], best[hits], [texts[x] for x in hits.tolist()] if restore else [None] * len(hits)


def _read_lines(tried, cur, before, place, line, lang, number, lines, cipher, sums, own, odd, best, restore, space) -> None:  # noqa: ANN001
    """Read the strange runs of lines, each in the language given for it; add to each line's tries the log-probability
    of the reading, its gain over what is written, the language, and the runs with what they are read as."""
    bigrams = cipher.bigrams
    if not len(cur):
        return
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    ends = np.append(first[1:], len(cur))
    a, b = strange_runs(cur, line, lang, bigrams)
    inside = np.zeros(len(cur) + 1, np.int32)
    inside[a] += 1
    inside[b + 1] -= 1
    plain = (np.cumsum(inside)[:-1] == 0) & ~bigrams.ascii[cur]
    # what a run, with the symbol after it, adds to its line as written (each line is closed by a space)
    ahead = np.concatenate([[0], np.cumsum(bigrams.log[lang, before, cur].astype(np.float64))])
    of = np.searchsorted(first, a, side="right") - 1
    begin = np.searchsorted(of, np.arange(len(first) + 1))
    cuts = zip(first.tolist(), ends.tolist(), begin[:-1].tolist(), begin[1:].tolist(), number[first].tolist(), lang[first].tolist())
    texts, begins, stops, gone = written(lines, place, cur, a, b)
    gives = (ahead[np.minimum(b + 2, ends[of])] - ahead[a]).tolist()
    after = np.where(b + 1 < ends[of], np.append(cur, 0)[b + 1], space).tolist()
    runs_of = list(zip(texts, begins, stops, gone, gives, before[a].tolist(), after))
    for start, stop, r0, r1, k, g in cuts:
        total, gain, found = float(sums[k, g]), 0.0, []
        held = frozenset(cur[start:stop][plain[start:stop]].tolist()) if r1 > r0 else frozenset()
        for text, i, j, lost, given, p, n in runs_of[r0:r1]:
            reading, stays, letters, sure = cipher.read(g, text, p, n, held, restore)
            total -= given
            if reading > stays:
                gain += min(reading - stays, 20.0)
                if restore:
                    found.append((i, j - 1, "".join(alphabet()[1][x] for x in letters) if sure >= SURE and not lost else None))
            total += max(reading, stays)
        tried[k].append((total + OWN_LABEL * (g == own[k] and odd[k, best[k]] > 0), gain, g, found))


def main_label(lang: Column) -> Column:
    """A language label in lower case and without region."""
    return F.lower(F.split(F.trim(lang), "[-_]")[0])


def labels(df: DataFrame, lang: str = "lang") -> dict[str, int]:
    """The two-letter labels of at least LEAST_TEXTS rows, and how many: some hundred at most, by their form."""
    per = df.groupBy(main_label(F.col(lang)).alias("x")).agg(F.count("*").alias("n")).where(f"x rlike '^[a-z]{{2}}$' and n >= {LEAST_TEXTS}")
    return {r["x"]: r["n"] for r in sorted(per.collect())}


def count_texts(into: tuple[np.ndarray, np.ndarray, np.ndarray], lines: Lines, label: np.ndarray) -> None:
    """Add to the bigrams, and to the texts and lines of each label that hold each symbol."""
    counts, files, rows = into
    read = stream(lines)
    add_bigrams(counts, lines, label, read)
    cur, _, _, line = read
    for table, unit, lang in ((files, lines.text[line], label), (rows, line, label[lines.text])):
        add_holders(table, unit, cur, lang)


def add_holders(into: np.ndarray, unit: np.ndarray, cur: np.ndarray, lang: np.ndarray, step: int = 1024) -> None:
    """Add to the table (language, symbol; last: any symbol) the units, in ascending order, that hold each symbol. So
    many units at a time mark what they hold in a table of their own; nothing is sorted."""
    for a in range(0, len(lang), step):
        i, j = np.searchsorted(unit, (a, a + step))
        at, of = unit[i:j] - a, lang[a : a + step]
        held = np.zeros((len(of), into.shape[1]), np.float32)
        held[at, cur[i:j]] = held[at, -1] = 1
        into += (np.arange(len(into))[:, None] == of).astype(np.float32) @ held


def empty_counts(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(alphabet()[1])
    return np.zeros((n, size, size)), np.zeros((n, size + 1)), np.zeros((n, size + 1))


def count_all(texts: DataFrame, known: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of count_texts over all rows of texts (columns: label, text), made in the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = empty_counts(len(known))
        for b in batches:
            for part in chunks(b, 1, STEP):
                count_texts(made, lines_of(part.column(1).to_pylist()), label_of(part.column(0).to_pylist(), known))
        rows = [np.nonzero(made[0])] + [np.nonzero(x) for x in made[1:]]
        i = np.concatenate([r[0] for r in rows])
        p = np.concatenate([rows[0][1], np.full(len(rows[1][0]), -1), np.full(len(rows[2][0]), -2)])
        n = np.concatenate([r[-1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(np.concatenate([x[r] for x, r in zip(made, rows)]), pa.float64())], names=["lang", "before", "after", "n"])

    got = texts.mapInArrow(count, "lang int, before int, after int, n double").groupBy("lang", "before", "after").agg(F.sum("n").alias("n")).toPandas()
    counts, files, lines_ = empty_counts(len(known))
    plain = got[got["before"] >= 0]
    counts[plain["lang"], plain["before"], plain["after"]] = plain["n"]
    for table, mark in ((files, -1), (lines_, -2)):
        x = got[got["before"] == mark]
        table[x["lang"], x["after"]] = x["n"]
    return counts, files, lines_


def learn(df: DataFrame, text: str = "content", lang: str = "lang") -> Cipher:
    """Bigrams and ciphers from all texts, in two passes: bigrams and alphabets, then the contexts of strange runs.

    What comes to the driver is bounded by alphabets, not by the corpus: bigrams, and the letters of each piece
    of a run (at most SHORT symbols, or one letter's bytes). The expectation-maximization runs in the executors,
    by run; no run is too rare to be learned.
    """
    spark = df.sparkSession
    ship(spark)
    known = list(labels(df, lang))
    size = len(alphabet()[1])
    texts = spread(df.where(F.col(text).isNotNull()).select(lang, text))

    counts, files, lines_ = count_all(texts, known)
    real = np.flatnonzero(distinct(counts, files[:, size]))
    known = [known[i] for i in real]
    bigrams = Bigrams(counts[real], files[real], lines_[real], known)
    held = spark.sparkContext.broadcast(bigrams)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, str, int, int], int] = {}
        for b in batches:
            for part in chunks(b, 1, STEP):
                lines = lines_of(part.column(1).to_pylist())
                add_contexts(made, lines, label_of(part.column(0).to_pylist(), known), held.value, stream(lines))
                if len(made) > 500_000:
                    yield _context_rows(made)
                    made.clear()
        yield _context_rows(made)

    schema = "lang int, run string, before int, after int, n bigint"
    seen = cut(texts.mapInArrow(around, schema).groupBy("run", "lang", "before", "after").agg(F.sum("n").alias("n")))
    for turn in range(2):

        def solve(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in _by_run(batches):
                yield _solved(b, held.value)

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = seen.repartition(n, "run").sortWithinPartitions("run").mapInArrow(solve, "run string, lang int, many bigint, itself float, letters binary")
        if turn == 0:
            # symbols that stand for themselves are of the alphabet, rare as they may be
            # (and stand alone more often than in a run, as parts of a cipher don't)
            rare = table.where("length(run) = 1 and itself > 0.5 and many > 2").select("run", "lang", "many").collect()
            bigrams.admit([(r["lang"], k) for r in rare if (k := table_of(r["run"])) and 2 * r["many"] > counts[real[r["lang"]], :, k].sum()])
            held.destroy()
            held = spark.sparkContext.broadcast(bigrams)
    rows = table.where("itself < 0.9").toArrow().to_pylist()
    held.destroy()
    release(seen)
    return Cipher(bigrams, {(r["lang"], r["run"]): (r["itself"], np.frombuffer(r["letters"], np.float32)) for r in rows}, {(r["lang"], r["run"]): float(r["many"]) for r in rows})


def _context_rows(made: dict[tuple[int, str, int, int], int]) -> pa.RecordBatch:
    cols = list(zip(*made)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(list(made.values()), pa.int64())], names=["lang", "run", "before", "after", "n"])


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of run, cut so that no run is in two tables."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        run = held.column("run")
        if held.num_rows < 50_000 or run[0] == run[-1]:
            continue
        ends = held.num_rows - 1
        last = run[-1].as_py()
        while ends and run[ends - 1].as_py() == last:
            ends -= 1
        yield held.slice(0, ends)
        held = held.slice(ends)
    if held is not None and held.num_rows:
        yield held


def _solved(t: pa.Table, bigrams: Bigrams) -> pa.RecordBatch:
    """decipher() for each run of a table of contexts."""
    out: list[tuple] = []
    size = bigrams.log.shape[1]
    lang, p, n, c = (t.column(k).to_numpy() for k in ("lang", "before", "after", "n"))
    run = t.column("run").combine_chunks().dictionary_encode()
    names, code = run.dictionary.to_pylist(), run.indices.to_numpy()
    order = np.lexsort((lang, code))
    first = np.flatnonzero(np.append(True, (code[order][1:] != code[order][:-1]) | (lang[order][1:] != lang[order][:-1])))
    seen: dict[int, dict[int, tuple]] = {}
    many: dict[tuple[int, int], int] = {}
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        at = order[i:j]
        r, g = int(code[at[0]]), int(lang[at[0]])
        if not len(bigrams.targets[g]):
            continue
        x, held = at[p[at] >= 0], at[p[at] == -1]
        plain = np.zeros(size)
        plain[n[held]] = c[held]
        seen.setdefault(r, {})[g] = (p[x], n[x], c[x], float(c[at[p[at] == -2]].sum()), plain)
        many[r, g] = int(c[x].sum())
    for r, by in seen.items():
        for g, (itself, q) in decipher(names[r], by, bigrams).items():
            out.append((names[r], g, many[r, g], itself, q.tobytes()))
    cols = list(zip(*out)) or [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.float32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["run", "lang", "many", "itself", "letters"])


#: Texts that are looked at together, which bounds a worker's memory.
STEP = 500


def find(df: DataFrame, cipher: Cipher, key: str = "file_id", text: str = "content", lang: str = "lang", restore: bool = False) -> DataFrame:
    """Columns key, line_no, language (judged by) and, with restore, restored: one row per damaged prose line.

    Null and empty texts have no lines. A restored text is given where each strange run, or the whole line in
    another code page, has one sure reading and no character was lost, else null. Repeated rows give repeated rows.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(cipher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            for part in chunks(b, 2, STEP):
                lines = lines_of(part.column(2).to_pylist())
                which, best, texts = damaged(lines, label_of(part.column(1).to_pylist(), c.bigrams.langs), c, restore)
                keys = part.column(0).take(pa.array(lines.text[which], pa.int64()))
                out = [keys, pa.array(lines.number[which], pa.int64()), pa.array([c.bigrams.langs[i] for i in best], pa.string())]
                names = [key, "line_no", "language"]
                if restore:
                    out.append(pa.array(texts, pa.string()))
                    names.append("restored")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, lang, text)).mapInArrow(run, f"{key} {kind}, line_no bigint, language string" + (", restored string" if restore else ""))
