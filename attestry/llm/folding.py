"""One form for text that looks the same (problem 3).

``canonical`` is compatibility normalisation (NFKC), full case folding, every kind of white space as a
blank, default-ignorable characters removed, and look-alike letters as Latin ones. It is the form to
compare and to search by. ``visual`` goes only as far as the eye: width, ligatures, composed accents,
invisible characters and look-alikes are brought together; letter case, raised digits, accents and
marks and inner blanks stay, outer blanks are not seen. ``canonical`` is a function of ``visual``, so equal ``visual`` forms have one ``canonical``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.lineage import cut

#: Letters of other scripts that print as the Latin letter beside them (fixed values).
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХԚԜҮаеѕіјорсухԛԝһӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ" "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓦꓪꓫꓬꓜ",
    "ABESIJKMHOPCTYXQWYaesijopcyxqwhl" "ABEZHIKMNOPTYXovcj" "ABCDEFGHIJKLMNOPRSTVWXYZ",
    strict=True,
))
#: Signs that print as another sign.
LOOKALIKES |= {"∆": "Δ", "µ": "μ", "Ω": "Ω", "‑": "-", "‐": "-", "˗": "-", "﹣": "-", "ı": "ı"}
#: Compatibility forms that look like what they stand for; <super>, <sub>, <fraction>, <circle> do not.
LOOKS_ALIKE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<font>")
#: Of the <compat> forms, only ligatures and letter-like signs print as their parts.
_COMPAT_RANGES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2100, 0x2138), (0x2160, 0x217F), (0xFB00, 0xFB17))
#: Default-ignorable code points (Unicode property) and the byte-order mark.
_IGNORABLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
_IGNORABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE_RANGES) + "]")
_BLANK = re.compile(r"[^\S\n]")


@functools.lru_cache(maxsize=65536)
def _seen_as(ch: str) -> str:
    """What one character looks like."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    how = unicodedata.decomposition(ch)
    if how and how[0] != "<":
        return ch  # canonical: NFC has settled it
    if how.startswith(LOOKS_ALIKE_TAGS) or how.startswith("<compat>") and any(a <= ord(ch) <= b for a, b in _COMPAT_RANGES):
        return "".join(_seen_as(x) for x in unicodedata.normalize("NFKC", ch))
    return ch


def visual(text: str) -> str:
    """The form that the eye sees; two texts with one form cannot be told apart."""
    if text.isascii():
        return _BLANK.sub(" ", text).strip()
    text = unicodedata.normalize("NFC", _IGNORABLE.sub("", text))
    odd = {c: s for c in set(text) if not c.isascii() and (s := _seen_as(c)) != c}
    if odd:
        text = unicodedata.normalize("NFC", text.translate(str.maketrans(odd)))
    return _BLANK.sub(" ", text).strip()


def canonical(text: str) -> str:
    """The one form of all text: NFKC, full case folding, plain blanks, nothing invisible, Latin look-alikes."""
    text = visual(text)
    for _ in range(4):  # a step can bring out signs for the next; four are enough for every code point
        if text.isascii():
            return text.casefold()
        done = visual(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))
        if done == text:
            break
        text = done
    return text


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _per_distinct(fn):
    """Apply ``fn`` once per distinct value of a batch; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        table = {v: fn(v) for v in values.dropna().unique()}
        return values.map(lambda v: table.get(v), na_action="ignore")

    return run


@F.pandas_udf(T.StringType())
def canonical_text(values: pd.Series) -> pd.Series:
    """Column form of :func:`canonical`; null stays null."""
    return _per_distinct(canonical)(values).astype(object)


def _digests(names: Sequence[str]):
    """Key, and 16-byte digests of the canonical form, the visual form and the value as stored, of each
    value in which there is something to see; once per distinct value of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            table = []
            for v in coded.dictionary.to_pylist():
                seen = visual(v)
                table.append((_digest(canonical(v)), _digest(seen), _digest(v)) if seen else (None, None, None))
            columns = [pa.array([t[i] for t in table], pa.binary()).take(coded.indices) for i in range(3)]
            out = pa.RecordBatch.from_arrays([batch.column(0), *columns], names=list(names))
            yield out.filter(out.column(1).is_valid())

    return run


def spellings(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows (k, form, seen, stored) of the values in which there is something to see, as 16-byte digests, and
    the spellings (form, seen, stored, records) of the forms that have more than one."""
    base = df.select(F.col(key).alias("k"), F.col(value).alias("_v")).where(F.col("k").isNotNull() & F.col("_v").isNotNull())
    schema = T.StructType([base.schema["k"], *[T.StructField(c, T.BinaryType()) for c in ("form", "seen", "stored")]])
    rows = cut(base.mapInArrow(_digests(schema.names), schema).distinct())  # each value is folded once
    told = rows.groupBy("form", "seen", "stored").agg(F.count("*").alias("records"))
    several = told.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    return rows, told.join(several, "form", "left_semi")


def same_looking_pairs(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(field_name, key_a, key_b): keys whose values look the same but differ in their characters.

    Forms with more than one spelling are the candidates; the exact check is that two spellings of a form
    have one visual form. Null, empty and blank values are in no pair; repeated rows count once; exact
    copies are no pair, nor is a key with itself. Texts stay where they are: only 16-byte digests are
    shuffled. Spellings are paired before their records, so exact copies never meet each other, and every
    row that a join makes is a row of the result.
    """
    rows, told = spellings(df, key, value)
    told = cut(told)
    a, b = told.alias("a"), told.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.seen") == F.col("b.seen")) & (F.col("a.stored") < F.col("b.stored"))).select(F.col("a.stored").alias("s"), F.col("b.stored").alias("t"))
    one = pairs.join(rows.select(F.col("k").alias("x"), F.col("stored").alias("s")), "s").select("t", "x")
    both = one.join(rows.select(F.col("k").alias("y"), F.col("stored").alias("t")), "t").where("x <> y")
    return both.select(F.lit(name).alias("field_name"), F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def form_classes(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(field_name, form, spellings, looks, records): one row per form that is held in more than one
    spelling, with how many of them a reader can tell apart and how many records hold them."""
    _, told = spellings(df, key, value)
    return told.groupBy("form").agg(F.count("*").alias("spellings"), F.count_distinct("seen").alias("looks"), F.sum("records").alias("records")).select(F.lit(name).alias("field_name"), F.hex("form").alias("form"), "spellings", "looks", "records")
