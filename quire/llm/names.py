"""Link the spellings of one person or organisation.

Words are brought together by a prefix-filtered similarity join on their q-grams; names whose words are near,
or shortened, are candidates, and a soft token similarity in which a rare word counts more verifies each of
them. All steps but the last work on distinct forms (words, shortened words, numbers), not on names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut, release, ship, small, spread

# Titles before and after names, folded.
TITLES = frozenset("dr prof ing mgr mag bc phd csc drsc doc rndr phdr mudr judr paeddr thdr dipl msc mba bsc mphil habil jr sr sir mr mrs ms".split())
# Letters that have no decomposition, and how they are folded.
PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"})
_QUOTED = re.compile("[„“”\"«»‚‘’‹›]([^„“”\"«»‚‘’‹›]+)[„“”\"«»‚‘’‹›]")
_PIECE = re.compile(r"[\w.'’-]+")
Q = 3


def fold(text: str) -> str:
    """Without case, accents, format characters and widths."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold().translate(PLAIN) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def parse(name: str) -> tuple[list[str], list[str], list[str], list[tuple[str, str]]]:
    """Words, shortened words (initials, abbreviations, acronyms), numbers, and (nickname, word before)."""
    name = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) != "Cf")
    words: list[str] = []
    short: list[str] = []
    numbers: list[str] = []
    nicks: list[tuple[str, str]] = []
    shouted = name.upper() == name
    for m in _QUOTED.finditer(name):
        before = _PIECE.findall(name[: m.start()])
        if before:
            nicks.append((fold(m[1]).strip(), fold(before[-1]).strip(".'’-")))
    for piece in _PIECE.findall(_QUOTED.sub(" ", name)):
        flat = fold(piece).strip("'’-")
        bare = flat.replace(".", "")
        if not bare or bare in TITLES:
            continue
        if bare.isdigit():
            numbers.append(bare)
        elif "." in flat or len(bare) == 1:
            parts = [p for p in flat.split(".") if p]
            if parts[0] not in TITLES:
                short += parts
        elif len(bare) <= 4 and piece.isupper() and not shouted:
            short.append(bare)
        else:
            words.append(bare)
    long = [w for w in words if len(w) > 3]
    return long if len(long) >= 2 else words, short, numbers, nicks


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    for b in batches:
        names = b.column(0).to_pylist()
        made = [parse(n) for n in names]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([x[k] for x in made], texts) for k in range(3)), pa.array([[f"{a}\t{c}" for a, c in x[3]] for x in made], texts)], names=["name", "words", "short", "numbers", "nicks"]
        )


def grams(word):  # noqa: ANN001, ANN201
    """The q-grams of a word column with its borders marked, each as gram and at (its place, from 0): as many as letters."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(padded) - Q, F.lit(0))), lambda i: F.struct(F.substring(padded, i + 1, Q).alias("gram"), i.alias("at")))


def similar_words(words: DataFrame) -> DataFrame:
    """Pairs a, b of words (column word) that are one typing slip apart: a letter too much, missing, other
    or swapped with another. Words of under four letters have no pairs (for these, see usage_nicknames).

    A letter other, missing or too much touches at most Q of a word's q-grams; the others stay at their places, or move
    by one behind a letter too much. So if each word's q-grams are put in order of rarity, two such words share two of
    the first Q + 2 of each, at matching places (four letters against four: one): only words with two such q-grams, their
    places and the length in common are joined. Swapped letters leave the sorted letters as they are.
    """
    d = words.where(F.length("word") >= 4).select("word", F.explode(grams(F.col("word"))).alias("g")).select("word", "g.gram", "g.at")
    often = d.groupBy("gram").agg(F.count("*").alias("often"))
    # one row a word: its grams in order of rarity, those of one kind by their places
    ranked = d.join(often, "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, Q + 2).alias("first"))
    ranked = cut(ranked.select("word", F.length("word").alias("size"), "first"))
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))

    def keys(size, moves: list[tuple[int, int]]):  # noqa: ANN001, ANN202
        """Two grams each, the places of the later one and of the earlier one moved by so much, and the length."""
        x = F.filter(F.flatten(F.transform("first", lambda g: F.transform("first", lambda h: F.struct(g.alias("g"), h.alias("h"))))), lambda p: p["g"]["at"] < p["h"]["at"])
        of = lambda p, i, k: F.xxhash64(size, p["g"]["gram"], p["g"]["at"] + i, p["h"]["gram"], p["h"]["at"] + k)
        return F.flatten(F.transform(x, lambda p: F.array(*[of(p, i, k) for i, k in moves])))

    one = F.when(F.col("size") == 4, F.transform("first", lambda g: F.xxhash64(F.lit("one"), g["gram"], g["at"]))).otherwise(F.array().cast("array<bigint>"))
    same = F.concat(keys(F.col("size"), [(0, 0)]), one, F.array(F.xxhash64(F.lit("letters"), F.array_join(letters("word"), ""))))
    keyed = cut(ranked.select("word", "size", F.explode(F.array_distinct(same)).alias("key")))
    longer = ranked.select(F.col("word").alias("a"), F.explode(F.array_distinct(keys(F.col("size") + 1, [(0, 0), (0, 1), (1, 1)]))).alias("key"))
    b = keyed.withColumnRenamed("word", "b")
    level = keyed.select(F.col("word").alias("a"), "key", F.col("size").alias("a_size")).join(b, "key").where("a < b and a_size = size").select("a", "b")
    uneven = longer.join(b, "key").where(F.col("size") == F.length("a") + 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    gap = F.levenshtein("a", "b", 2)
    swapped = (gap == 2) & (F.length("a") == F.length("b")) & (letters("a") == letters("b"))
    # few that share a key are slips, so pairs are verified before they are made distinct
    pairs = cut(level.unionByName(uneven).where((gap == 1) | swapped).distinct())
    release(ranked, keyed)
    return pairs


def word_roots(words: DataFrame) -> DataFrame:
    """word -> root: from each word to the most frequent of the words one slip away, if that is clearly more
    frequent or the word is long, and on from there to the end. words: word, often."""
    pairs = similar_words(words.select("word"))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    n = words.select(F.col("word").alias("near"), F.col("often").alias("near_often"))
    d = both.join(n, "near").join(words, "word")
    better = (F.col("near_often") > F.col("often")) | ((F.col("near_often") == F.col("often")) & (F.col("near") < F.col("word")))
    sure = (F.length("word") >= 7) | (F.col("near_often") >= 4 * F.col("often"))
    up = d.where(better & sure).groupBy("word").agg(F.max_by("near", F.struct("near_often", "near")).alias("root"))
    # each step doubles how far a word has come; a root is more frequent (or smaller) than its word, so it ends
    steps = cut(up)
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(steps.join(small(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(steps)
        steps = further
        if not steps.where("moved").take(1):
            break
    return words.join(small(steps), "word", "left").select("word", F.coalesce("root", "word").alias("root"))


def usage_nicknames(two: DataFrame) -> DataFrame:
    """nick -> full, found by use: two: words (two of them, in their order as written). A word is a nickname of a
    more frequent one if half of the words it goes with, and at least two (four where the first letters differ), go
    with that one, too.

    Of the two words of a name the one that stands first more often is the variable part (given name, kind of
    school), the other its context (family name, town). Candidates come from a prefix filter: to share so many
    contexts with another word, a word must share one of its rarest few. No context is left out, however common.
    """
    d = two.select(F.col("words")[0].alias("x"), F.col("words")[1].alias("y"), "n").where("x <> y")
    first = d.select(F.explode(F.array(F.struct(F.col("x").alias("w"), F.lit(1).alias("f"), "n"), F.struct(F.col("y").alias("w"), F.lit(0).alias("f"), "n"))).alias("s")).groupBy("s.w").agg((F.sum(F.col("s.f") * F.col("s.n")) / F.sum("s.n")).alias("lead"))
    first = small(cut(first))
    d = d.join(first.toDF("x", "lx"), "x").join(first.toDF("y", "ly"), "y")
    ahead = (F.col("lx") > F.col("ly")) | ((F.col("lx") == F.col("ly")) & (F.col("x") < F.col("y")))
    d = cut(d.select(F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("k")).distinct())
    with_k = d.groupBy("k").agg(F.count("*").alias("n_k"))
    n_a = small(cut(d.groupBy("a").agg(F.count("*").alias("n_a"))))
    # a's contexts from the rarest on, as one row
    of_a = d.join(with_k, "k").join(n_a, "a").where("n_a >= 2").groupBy("a", "n_a").agg(F.array_sort(F.collect_list(F.struct("n_k", "k"))).alias("ks"))
    half = F.ceil(F.col("n_a") / 2).cast("int")
    # (least overlap, whether the first letters are equal)
    ways = F.array(F.struct(F.greatest(F.lit(2), half).alias("least"), F.lit(True).alias("same")), F.struct(F.greatest(F.lit(4), half).alias("least"), F.lit(False).alias("same")))
    probe = of_a.select("a", "n_a", "ks", F.explode(ways).alias("way")).where("way.least <= n_a").select("a", "n_a", F.col("way.same").alias("same"), F.explode(F.slice("ks", 1, F.col("n_a") - F.col("way.least") + 1)).alias("x")).select("a", "n_a", "same", F.col("x.k").alias("k"))
    other = d.withColumnRenamed("a", "b").join(n_a.toDF("b", "n_b"), "b")
    same = F.substring("a", 1, 1) == F.substring("b", 1, 1)
    likely = probe.join(other, "k").where((F.col("a") != F.col("b")) & (F.col("n_b") > 1.5 * F.col("n_a")) & (same == F.col("same"))).select("a", "b", "n_a").distinct()
    both = likely.join(d, "a").join(d.withColumnRenamed("a", "b"), ["b", "k"]).groupBy("a", "b", "n_a").agg(F.count("*").alias("n_ab"))
    sure = (F.col("n_ab") >= 0.5 * F.col("n_a")) & (F.col("n_ab") >= F.when(same, 2).otherwise(4))
    return both.where(sure).groupBy("a").agg(F.max_by("b", F.struct("n_ab", "b")).alias("full")).select(F.col("a").alias("nick"), "full")


def _short_for(short: str, word: str) -> bool:
    return len(short) < len(word) and word.startswith(short)


def _acronym(short: str, words: list[str]) -> bool:
    """Whether the letters of short stand in order in words, each but inner ones at a word's start."""
    if not words or not 2 <= len(short) <= 4:
        return False
    heads = "".join(w[0] for w in words)
    little = "".join(w[0] for w in words if len(w) > 2)
    if short in (heads, little):
        return True
    if len(words) != 1 or short[0] != words[0][0]:
        return False
    at = iter(words[0])
    return all(c in at for c in short)


def soft_similarity(p: tuple, f: tuple, weight: dict[str, float]) -> float:
    """How much of both names' weight finds a partner: 1 for equal words, 0.95 for shortened ones.

    p and f: (words, shortened words, numbers). Unequal numbers give 0. An initial that is left over
    counts little, any other word left over its full weight.
    """
    if sorted(p[2]) != sorted(f[2]):
        return 0.0
    w = lambda x: weight.get(x, 8.0)
    same = set(p[0]) & set(f[0])
    got = 2 * sum(w(x) for x in same)
    mine, theirs = [x for x in p[0] if x not in same], [x for x in f[0] if x not in same]
    left_short, other_short = list(p[1]), list(f[1])
    for x in list(left_short):
        if x in other_short:
            left_short.remove(x)
            other_short.remove(x)

    def match(shorts: list[str], words: list[str]) -> float:
        gained = 0.0
        for x in sorted(shorts, key=len, reverse=True):
            hit = next((y for y in words if _short_for(x, y)), None)
            if hit is not None and not (len(x) >= 2 and _acronym(x, words) and len(words) > 1 and x == "".join(y[0] for y in words)):
                words.remove(hit)
                shorts.remove(x)
                gained += 1.9 * w(hit)
            elif _acronym(x, words):
                gained += 1.9 * sum(w(y) for y in words)
                words.clear()
                shorts.remove(x)
        return gained

    got += match(left_short, theirs) + match(other_short, mine)
    total = got + sum(w(x) for x in mine + theirs) + sum(0.5 if len(x) == 1 else 4.0 for x in left_short + other_short)
    return got / total if total else 0.0


def _verified(least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, f = ([b.column(f"{s}_{c}").to_pylist() for c in ("words", "weight", "short", "numbers")] for s in "pf")
            score = [soft_similarity((pw, ps, pn), (fw, fs, fn), dict(zip(pw, px)) | dict(zip(fw, fx))) for pw, px, ps, pn, fw, fx, fs, fn in zip(*p, *f)]
            keep = pa.array([x >= least for x in score])
            yield pa.RecordBatch.from_arrays([b.column("p").filter(keep), b.column("f").filter(keep), pa.array(score, pa.float64()).filter(keep)], names=["p", "f", "score"])

    return run


#: What a word that is a slip or a nickname of its root counts for, against 1 for the root itself.
NEAR = 0.95


def entities(names: DataFrame, least: float = 0.9) -> DataFrame:
    """name -> entity: the spellings (column name) that mean the same have the same entity number.

    Null and repeated names count once or not at all; names without letters or digits are left alone
    (each an entity of its own). A shortened spelling that fits several entities equally well stays alone.
    """
    ship(names.sparkSession)
    each = cut(names.select("name").where("name is not null").distinct())  # written, as spread would make it twice
    parsed = spread(each).mapInArrow(_parsed, "name string, words array<string>, short array<string>, numbers array<string>, nicks array<string>")
    blank = (F.size("words") == 0) & (F.size("short") == 0) & (F.size("numbers") == 0)
    text = lambda words: F.concat_ws("|", F.array_join(words, " "), F.array_join(F.array_sort("short"), " "), F.array_join(F.array_sort("numbers"), " "))
    parsed = cut(parsed.withColumn("form", F.xxhash64(F.when(blank, F.concat(F.lit("="), "name")).otherwise(text(F.col("words"))))))
    release(each)
    forms = cut(parsed.groupBy("form").agg(*[F.min_by(c, "name").alias(c) for c in ("words", "short", "numbers")], F.count("*").alias("n")))
    many = parsed.count()
    words = cut(forms.select("n", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("n").alias("often")))
    roots = cut(word_roots(words))
    quoted = parsed.select(F.explode("nicks").alias("x")).select(F.split("x", "\t")[0].alias("nick"), F.split("x", "\t")[1].alias("word"))
    quoted = quoted.join(small(roots), "word").groupBy("nick", "root").agg(F.count("*").alias("n")).groupBy("nick").agg(F.max_by("root", F.struct("n", "root")).alias("full")).where("nick <> full")
    roots2 = cut(_renamed(roots, quoted))
    two = forms.where("size(words) = 2 and size(short) = 0 and size(numbers) = 0").select("form", "n", F.posexplode("words").alias("pos", "word")).join(small(roots2), "word")
    two = two.groupBy("form", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "root"))), lambda x: x["root"]).alias("words"))
    roots3 = cut(_renamed(roots2, usage_nicknames(two)))
    # each form by its roots; the roots' weights verify that the form as written is near enough to them
    weight = cut(forms.select("n", F.explode(F.array_distinct("words")).alias("word")).join(small(roots3), "word").groupBy("root").agg(F.sum("n").alias("often")).withColumn("weight", F.log(1 + many / F.col("often"))))
    rooted = forms.select("form", F.posexplode("words").alias("pos", "word")).join(small(roots3), "word").join(small(weight), "root")
    near = F.when(F.col("word") == F.col("root"), 1.0).otherwise(NEAR)
    rooted = rooted.groupBy("form").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "root"))), lambda x: x["root"])).alias("roots"), (F.sum(F.col("weight") * near) / F.sum("weight")).alias("score"))
    signed = forms.join(rooted, "form", "left").withColumn("words", F.when(F.col("score") >= least, F.col("roots")).otherwise(F.array_distinct("words"))).drop("roots", "score")
    signed = signed.withColumn("sig", F.when(blank, F.col("form")).otherwise(F.xxhash64(text(F.array_sort("words")))))
    # a space left out or moved: forms whose words run together to the same letters share the commonest signature
    signed = cut(signed.withColumn("run", F.when(~blank, F.xxhash64(text(F.array(F.array_join("words", "")))))))
    kinds = signed.where("run is not null").groupBy("run", "sig").agg(F.sum("n").alias("n")).groupBy("run").agg(F.max_by("sig", F.struct("n", "sig")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    to = signed.join(kinds, "run").groupBy("sig").agg(F.max("main").alias("main"))
    signed = cut(signed.join(to, "sig", "left").select("form", "words", "short", "numbers", "n", F.coalesce("main", "sig").alias("sig")))
    sigs = signed.groupBy("sig").agg(*[F.min_by(c, "form").alias(c) for c in ("words", "short", "numbers")], F.sum("n").alias("n"))
    # words that no root led to (below least) weigh as rare ones
    apart = sigs.select("sig", F.posexplode_outer("words").alias("pos", "root")).join(small(weight), "root", "left").withColumn("weight", F.coalesce("weight", F.log(F.lit(1.0 + many))))
    listed = apart.groupBy("sig").agg(F.array_sort(F.collect_list(F.when(F.col("root").isNotNull(), F.struct("pos", "root", "weight")))).alias("w"))
    sigs = cut(sigs.join(listed, "sig").select("sig", "short", "numbers", F.col("w.root").alias("words"), F.col("w.weight").alias("weight")))
    scored = cut(_candidates(sigs).mapInArrow(_verified(least), "p bigint, f bigint, score double"))
    # a shortened signature belongs to its best partner, if all partners without shortenings agree
    plain = sigs.where("size(short) = 0").select(F.col("sig").alias("f"), F.lit(1).alias("plain"))
    s = scored.join(plain, "f", "left").groupBy("p").agg(F.count_if(F.col("plain") == 1).alias("n_plain"), F.max_by("f", F.struct(F.coalesce("plain", F.lit(0)), "score", "f")).alias("f"), F.count("*").alias("n"))
    up = cut(s.where("n_plain = 1 or (n_plain = 0 and n = 1)").select(F.col("p").alias("sig"), F.col("f").alias("entity")))
    # a partner has no shortened words, or more words than its like: so this ends, too
    while True:
        on = up.select(F.col("sig").alias("entity"), F.col("entity").alias("next"))
        further = cut(up.join(small(on), "entity", "left").select("sig", F.coalesce("next", "entity").alias("entity"), F.col("next").isNotNull().alias("moved")))
        release(up)
        up = further
        if not up.where("moved").take(1):
            break
    made = parsed.select("name", "form").join(signed.select("form", "sig"), "form").join(small(up), "sig", "left").select("name", F.coalesce("entity", "sig").alias("entity"))
    release(words, roots, roots2, scored)
    return made


def _candidates(sigs: DataFrame) -> DataFrame:
    """Shortened signatures (p) with the signatures (f) that have more written out and may be the same.

    For a similarity of 0.9 the numbers must be equal, the rarest word of p must be one of f's, and so must the next
    written word, or, where there is none, f must have another word that begins with the first letter of a shortened
    one. So f is found by its word and the other's letter, and a frequent name is split by the other part. A
    signature of shortened words alone has no word to be found by: it is found by its first letters among names
    that have these initials.
    """
    initial = lambda c: F.substring(c, 1, 1)
    numbers = F.array_join(F.array_sort("numbers"), " ")
    by_rarity = F.transform(F.array_sort(F.arrays_zip(F.transform("weight", lambda x: -x).alias("r"), F.col("words").alias("w"))), lambda x: x["w"])
    side = lambda d, s: d.select("key", *[F.col(c).alias(f"{s}{'' if c == 'sig' else '_' + c}") for c in ("sig", "words", "weight", "short", "numbers")])
    heads = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.substring(x, 1, 1))), "")
    left = sigs.where(F.size("short") > 0).withColumn("_w", by_rarity)
    one = F.array_distinct(F.transform("short", lambda x: F.concat(F.lit("i:"), initial(x))))
    ways = F.when(F.size("_w") >= 2, F.array(F.concat(F.lit("w:"), F.col("_w")[1]))).when(F.size("_w") == 1, one)
    keys = F.when(F.size("_w") == 0, F.array(F.concat_ws("|", numbers, heads("short")))).otherwise(F.transform(ways, lambda x: F.concat_ws("|", numbers, F.col("_w")[0], x)))
    left = left.withColumn("key", F.explode(keys))
    right = sigs.where(F.size("words") + F.size("numbers") >= 2)
    pairs = F.flatten(F.transform("words", lambda x: F.flatten(F.transform(F.filter("words", lambda y: (y != x) | (F.size("words") == 1)), lambda y: F.array(F.concat_ws("|", numbers, x, F.concat(F.lit("w:"), y)), F.concat_ws("|", numbers, x, F.concat(F.lit("i:"), initial(y))))))))
    right = right.withColumn("key", F.explode(F.array_distinct(F.concat(pairs, F.array(F.concat_ws("|", numbers, heads("words")))))))
    d = side(left, "p").join(side(right, "f"), "key").where("p <> f and (size(f_short) = 0 or size(f_words) > size(p_words))")
    return d.drop("key").dropDuplicates(["p", "f"])


def _renamed(roots: DataFrame, nick: DataFrame) -> DataFrame:
    """roots with nicknames (as written, or as rooted) replaced by their full words."""
    nick = small(cut(nick))
    by_word = nick.select(F.col("nick").alias("word"), F.col("full").alias("f1"))
    by_root = nick.select(F.col("nick").alias("root"), F.col("full").alias("f2"))
    return roots.join(by_word, "word", "left").join(by_root, "root", "left").select("word", F.coalesce("f1", "f2", "root").alias("root"))


def pairs_of(members: DataFrame, name: str = "name", group: str = "entity") -> DataFrame:
    """name_a, name_b: every pair of different names of a group, the smaller by code points first."""
    m = members.select(F.col(name).alias("x"), F.col(group).alias("g"))
    big = m.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    m = m.join(big, "g", "left_semi")
    return m.withColumnRenamed("x", "name_a").join(m.withColumnRenamed("x", "name_b"), "g").where("name_a < name_b").select("name_a", "name_b")
