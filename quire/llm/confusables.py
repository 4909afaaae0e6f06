"""One form for texts that look the same: skeletons, classes of look-alikes and their pairs."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.runtime import ship, spread

# Letters of other scripts that are drawn like Latin ones, and the Latin letters.
LOOK_ALIKE_LETTERS = {
    "Cyrillic": ("АВЕЗКМНОРСТУХІЈЅҮԌԚԜӀасеорухіјѕһԁԛԝүѵӏ", "ABE3KMHOPCTYXIJSYGQWIaceopyxijshdqwyvl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺͿονϳϲ", "ABEZHIKMNOPTYXFCMJovjc"),
    "Coptic": ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᏙᎳᏃ", "ABCDEHJKLMPSVWZ"),
    "Armenian": ("ՕՏՍհոսօզյց", "OSUhnuoqjg"),
    "Latin": ("ɑɡɩʏꓲ", "agıyI"),
}
# Marks that are put together from smaller ones, or drawn like them.
LOOK_ALIKE_MARKS = {
    "‚": ",", "„": ",,", "⹂": ",,", "“": "‘‘", "”": "’’", "‟": "‛‛",
    "«": "‹‹", "»": "››", "≪": "‹‹", "≫": "››", "《": "‹‹", "》": "››", "⟪": "‹‹", "⟫": "››", "〈": "‹", "〉": "›", "⟨": "‹", "⟩": "›",
    "ʼ": "’", "ʻ": "‘", "ˈ": "'", "‐": "-", "‑": "-", "…": "...", "‥": "..", "․": ".", "։": ":", "∶": ":", "ː": ":", "∕": "/", "⁄": "/", "∗": "*",
}
# Format characters that are visible, against the rule for their category.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"


@cache
def prototypes() -> dict[int, str]:
    """The prototype of each character that has one other than itself, for str.translate.

    By rule: characters without width give nothing, every kind of space a space, line separators a line
    end, full-width and half-width forms and ligatures their ordinary letters. From the tables above:
    letters of other scripts and compound marks. Accents, digits, case, superscripts and signs stay.
    """
    made: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs", "Lo", "Cc"):
            if 0xFF00 <= code <= 0xFFEF and unicodedata.decomposition(c):
                made[code] = unicodedata.normalize("NFKD", c)
            continue
        how = unicodedata.decomposition(c)
        if kind == "Cf":
            if c not in VISIBLE_FORMAT:
                made[code] = ""
        elif kind == "Zs":
            made[code] = " "
        elif kind in ("Zl", "Zp"):
            made[code] = "\n"
        elif 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x180B, 0x180C, 0x180D):
            made[code] = ""
        elif how.startswith(("<wide>", "<narrow>")):
            made[code] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in how.split()[1:]))
        elif how.startswith("<compat>") and kind in ("Ll", "Lu", "Lt", "Nl"):
            plain = unicodedata.normalize("NFKD", c)
            if kind == "Nl" or (len(plain) > 1 and plain[0].isalpha() and " " not in plain):
                made[code] = plain
    for few in LOOK_ALIKE_LETTERS.values():
        made |= {ord(a): b for a, b in zip(*few, strict=True)}
    made |= {ord(a): b for a, b in LOOK_ALIKE_MARKS.items()} | {0x09: " ", 0x0B: " ", 0x0C: " ", 0x0D: ""}
    for code, text in list(made.items()):  # a prototype's own characters have to be prototypes
        made[code] = text.translate({k: v for k, v in made.items() if k != code and chr(k) in text})
    return made


def skeleton_of(text: str | None) -> str | None:
    """Decompose, replace each character by its prototype, decompose again. Null gives null."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def consistent_of(text: str | None) -> str | None:
    """The skeleton, composed again: one readable form for all texts that look the same."""
    return None if text is None else unicodedata.normalize("NFC", skeleton_of(text))


@F.pandas_udf(StringType())
def _skeleton(s):  # noqa: ANN001, ANN202
    return s.map(skeleton_of, na_action="ignore")


def skeleton(text: Column) -> Column:
    """The skeleton of a text column; null gives null, an empty text an empty one. Call ship first."""
    return _skeleton(text)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    digest = lambda t: blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()
    for b in batches:
        marks, exact = [], []
        for t in b.column(b.num_columns - 1).to_pylist():
            if t is None:
                marks.append(None)
                exact.append(None)
                continue
            s = skeleton_of(t)
            exact.append(d := digest(t))
            marks.append(d if s == t else digest(s))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.binary()), pa.array(exact, pa.binary())], names=[*b.schema.names[:-1], "look", "exact"])


def looks(df: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """Columns keys, look and exact: 128-bit digests of the skeleton and of the characters themselves.

    Only digests leave this step, so later shuffles don't carry texts. Null texts give nulls.
    """
    ship(df.sparkSession)
    narrow = spread(df.select(*keys, F.col(text).alias("_text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_hashes, f"{kept}, look binary, exact binary")


def look_alike_pairs(marked: DataFrame, key: str) -> DataFrame:
    """Columns id_a, id_b: all pairs of keys (id_a < id_b) with equal look and other characters.

    Exact copies are never paired with each other: pairs are formed between the distinct writings of a
    look, then given their members. Rows with a null look or key have no pair; repeated keys count once.
    """
    d = marked.where(F.col("look").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), "look", "exact").distinct()
    odd = d.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("look")
    d = d.join(odd, "look", "left_semi")
    kinds = d.select("look", "exact").distinct()
    pairs = kinds.select("look", F.col("exact").alias("ea")).join(kinds.select("look", F.col("exact").alias("eb")), "look").where("ea < eb")
    left = pairs.join(d.select(F.col("look"), F.col("exact").alias("ea"), F.col("id").alias("ia")), ["look", "ea"])
    both = left.join(d.select(F.col("look"), F.col("exact").alias("eb"), F.col("id").alias("ib")), ["look", "eb"])
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).where("id_a < id_b").distinct()


def look_alike_classes(marked: DataFrame, key: str) -> DataFrame:
    """One row per key: class_id (the smallest key of that look), how many keys and writings it has."""
    d = marked.where(F.col("look").isNotNull() & F.col(key).isNotNull()).select(F.col(key), "look", "exact").distinct()
    per = d.groupBy("look", "exact").agg(F.min(key).alias("lo"), F.count("*").alias("n"))
    by = per.groupBy("look").agg(F.min("lo").alias("class_id"), F.sum("n").alias("n_members"), F.count("*").alias("n_writings"))
    return d.join(by, "look").select(key, "class_id", "n_members", "n_writings")


def quote_pairs(overrides: DataFrame, locales: DataFrame) -> DataFrame:
    """Columns id_a (locale_no), id_b (override_id): quotes of the same locale that look the same but
    differ in characters. Rows with null quotes, or a null mark on one side only, are no case."""
    ship(overrides.sparkSession)
    a = locales.select("id", F.col("locale_no").alias("id_a"), F.col("quotes.open_mark").alias("oa"), F.col("quotes.close_mark").alias("ca"))
    b = overrides.where("quotes is not null").select("id", F.col("override_id").alias("id_b"), F.col("quotes.open_mark").alias("ob"), F.col("quotes.close_mark").alias("cb"))
    d = b.join(a, "id").where(~(F.col("oa").eqNullSafe(F.col("ob")) & F.col("ca").eqNullSafe(F.col("cb"))))
    same = skeleton(F.col("oa")).eqNullSafe(skeleton(F.col("ob"))) & skeleton(F.col("ca")).eqNullSafe(skeleton(F.col("cb")))
    return d.where(same).select("id_a", "id_b").distinct()
