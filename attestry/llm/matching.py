"""Matching of hand-kept references to documents without a shared identifier (problem 6).

Documents that hold one work are one unit (same DOI and kind, same content, or same title with a common
author or year). A reference and a unit are a candidate pair if they share an author's surname and two
of the longest title words, or a title but for two words, or the beginning of one. A pair's log-odds come
from title, authors and year, each of which may be missing. Loopy belief propagation then weighs all
pairs together. Its factors are one-to-one: an entry names at most one work, and a work is named by one
entry, or by more at the price RELISTED for each further one (a list may hold a work twice). Messages are
the exact sums over the factors' states; they go through joins on small numeric tables until they stand
still, and the marginal is the match's confidence.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.keys import doi_key, kind_key
from attestry.functions.missing import is_missing
from attestry.lineage import cut, release
from attestry.llm import markup
from attestry.llm.folding import canonical
from attestry.operators.components import components_by_keys
from attestry.tables import spread

#: Words of a reference that do not belong to the title, and words that make it another work.
_NOISE = frozenset("the on a an in press preprint forthcoming erschienen".split())
_OTHER_WORK = frozenset("reply comment erratum corrigendum correction retraction response".split())
_NO_AUTHOR = frozenset({"", "anon", "anonymous", "anonym", "unknown", "various", "n a", "na", "none", "null"})
#: Words that make no key, and words from which a title leaves out one word at most.
_SMALL = frozenset("the and for from with der die das und des del las los les sur sobre por une una".split())
#: Titles of more telling words meet by CLASSES of their words instead of by all words but two.
LONG_TITLE, CLASSES = 24, 5
#: Longest words of a title that go with a name, and with a name that may have a slip.
NAME_WORDS, SLIP_WORDS = 6, 3
#: Least share of an entry's words that stand in the unit's title to the letter.
ALIKE = 0.4
#: Log-odds under which a pair is no candidate: nothing that the factors add makes a match of it.
WEAK = -1.0
#: Odds that a work of the list is listed once more (lists of this kind hold a work 1.4 times on average).
RELISTED = 0.3
#: Least marginal of a match (more likely than not, so an entry matches one work at most), and change at which messages stand still.
CONFIDENCE, STILL = 0.5, 0.01
#: Rounds after which messages that still move are an error.
ROUNDS = 200

_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})


def fold_name(text: str) -> str:
    """Letters without case, accents and look-alikes."""
    plain = unicodedata.normalize("NFKD", canonical(text))
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(_LETTERS)


def title_words(title: str | None) -> list[str]:
    """Words of a title without markup and formulas; an abbreviated word keeps its stop."""
    if not title:
        return []
    bare = re.sub(r"\\SI\{[^{}]*\}\{[^{}]*\}", " ", title)  # quantities set by a command are residue
    plain = fold_name(re.sub("⟦[^⟧]*⟧", " ", markup.clean(bare)[0]))
    plain = re.sub(r"\[preprint\]|\(in press\)|\bdegrees c\b", " ", plain)
    cut_off = re.search(r"(?:\.\.\.|…)\s*$", plain) is not None
    words = [w for w in re.findall(r"[^\W_]+\.(?=\s+\S)|[^\W_]+", plain)]
    while words and words[0] in ("the", "on", "a", "an"):
        words.pop(0)
    return [*words, "…"] if cut_off else words


def entry_surnames(authors: str | None) -> list[str]:
    """Surnames of an author string, in whatever order and style it is written."""
    plain = fold_name(re.sub(r"(?i)\bet\s+al\b\.?|\bu\.\s*a\.|&", lambda m: ";" if m[0] == "&" else "", authors or ""))
    if re.sub(r"[\W_]+", " ", plain).strip() in _NO_AUTHOR:
        return []
    if ";" in plain:
        parts = plain.split(";")
    elif re.search(r"\s(?:and|y|und|et)\s", plain):
        parts = re.split(r"\s(?:and|y|und|et)\s", plain)
    elif re.fullmatch(r"\s*[^,]+,\s*(?:\w\.?[\s-]?){1,3}\s*", plain):
        parts = [plain]
    else:
        parts = plain.split(",")
    return sorted({s for p in parts if (s := surname(p))})


def surname(name: str) -> str:
    """The surname of one name: before a comma, beside initials, or else the last word."""
    head, comma, _ = fold_name(name).partition(",")
    words = re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", head)
    if not words:
        return ""
    if comma:
        return max(words, key=len)
    long = [w for w in words if len(w) > 1]
    return (long[0] if len(words[-1]) == 1 else long[-1]) if long else ""


def unit_surnames(authors: Sequence[str] | None) -> list[str]:
    return sorted({s for a in (authors if authors is not None else ()) if a and fold_name(a).strip(" .") not in _NO_AUTHOR and (s := surname(a))})


@functools.lru_cache(maxsize=200_000)
def near(a: str, b: str, most: int) -> bool:
    """Whether a few edits (insertion, removal, change, swap of neighbours) turn ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    last2, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        last2, last = last, row
    return last[-1] <= most


def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if a.endswith("."):
        return b.startswith(a[:-1])
    if a.isdigit() or b.isdigit():
        return False
    return len(a) > 3 and len(b) > 3 and near(a, b, 1 if min(len(a), len(b)) < 8 else 2)


def title_agreement(entry: Sequence[str], unit: Sequence[str]) -> float:
    """Share of the words of both titles that the other has; an entry that was cut off is compared with
    the start of the title only."""
    cut_off = "…" in entry
    entry = [w for w in entry if w != "…"]
    unit = [w.rstrip(".") for w in unit if w != "…"]
    if not entry or not unit:
        return 0.0
    free: list[str | None] = list(unit)
    hit, last = 0.0, -1
    weight = lambda w: 2.5 if any(c.isdigit() for c in w) else 0.5 if len(w) < 4 else 1.0
    total = sum(weight(w) for w in entry)
    for w in entry:
        at = next((i for i, u in enumerate(free) if u is not None and _same_word(w, u)), None)
        if at is not None:
            hit, last, free[at] = hit + weight(w), max(last, at), None
    tail = sum(weight(u) for u in free[last + 1 :] if u is not None)
    inside = sum(weight(u) for u in free[: last + 1] if u is not None)
    # without a mark an entry of three or more words may also have been cut at its end
    lost = inside + (0.0 if cut_off or len(entry) >= 3 and hit >= 0.99 * total else tail)
    return 2 * hit / (total + hit + 0.7 * lost)


def author_agreement(entry: Sequence[str], unit: Sequence[str]) -> float | None:
    """Share of the entry's surnames among the unit's, with slips of the pen; None if either has none."""
    if not entry or not unit:
        return None
    return sum(1 for a in entry if any(near(a, b, 2 if min(len(a), len(b)) > 8 else 1) for b in unit)) / len(entry)


def log_odds(title: float, authors: float | None, years: Sequence[float], other_work: bool) -> float:
    """Log-odds that an entry and a unit are one work. ``years``: distances of the years, if known."""
    x = -3.0 + max(-8.0, min(5.0, 5.0 - (1 - title) * 25))
    x += 0.0 if authors is None else 4.0 if authors >= 0.99 else 2.5 if authors >= 0.5 else -1.0 if authors > 0.3 else -6.5
    x += 0.0 if not years else (2.0, 1.0, -2.0)[int(min(years))] if min(years) <= 2 else -6.0
    return x - 8.0 * other_work


_ENTRY = T.StructType([T.StructField("ref_id", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType())])


def read_entries(refs: DataFrame) -> DataFrame:
    """(ref_id, words, names, year) per entry; a ref_id held twice keeps both rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"ref_id": p["r"], "words": p["t"].map(lambda t: [w for w in title_words(t)]), "names": p["a"].map(entry_surnames), "year": p["y"].astype("Int32")})

    plain = refs.where(F.col("ref_id").isNotNull()).select(F.col("ref_id").cast("long").alias("r"), F.col("ref_title").alias("t"), F.col("ref_authors").alias("a"), F.col("ref_year").cast("int").alias("y"))
    return plain.distinct().mapInPandas(run, _ENTRY)


_DOC = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType()), T.StructField("title_key", T.StringType())])


def read_documents(staging: DataFrame) -> DataFrame:
    """(doc_id, kind, doi, hash, words, names, year) per distinct description of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            words = p["t"].map(title_words)
            key = words.map(lambda w: " ".join(sorted(_telling(w))) if len(_telling(w)) > 1 else None)
            yield p.assign(words=words, names=p["a"].map(unit_surnames), year=p["year"].astype("Int32"), title_key=key)[_DOC.names]

    plain = staging.where(F.col("doc_id").isNotNull()).select(
        "doc_id", kind_key(F.col("doc_type")).alias("kind"), doi_key(F.col("doi")).alias("doi"), F.when(~is_missing(F.col("content_hash")), F.col("content_hash")).alias("hash"),
        F.col("title").alias("t"), F.col("authors").alias("a"), F.col("year").cast("int").alias("year"),
    ).distinct()
    return plain.mapInPandas(run, _DOC)


def work_units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit): documents that hold one work; ``unit`` is the least doc_id."""
    title = F.col("title_key")
    keys = F.array(
        F.concat(F.lit("d|"), "kind", F.lit("|"), "doi"), F.concat(F.lit("h|"), "kind", F.lit("|"), "hash"),
        F.concat(F.lit("y|"), "kind", F.lit("|"), title, F.lit("|"), F.col("year").cast("string")),
    )
    by_name = F.transform("names", lambda n: F.concat(F.lit("n|"), F.col("kind"), F.lit("|"), title, F.lit("|"), n))
    return components_by_keys(docs.select("doc_id", F.explode(F.concat(keys, by_name)).alias("key")), "doc_id", "key", "unit")


def _telling(words: Sequence[str]) -> list[str]:
    """Words that name a title: no mark of a cut, no abbreviations, no words of one or two letters."""
    return [w for w in dict.fromkeys(words) if w != "…" and not w.endswith(".") and (len(w) > 2 or w.isdigit()) and w not in _SMALL]


_MASK = (1 << 64) - 1
#: Odd multipliers, one per kind of key.
_KINDS = {"n": 0x9E3779B97F4A7C15, "s": 0xC2B2AE3D27D4EB4F, "t": 0x165667B19E3779F9, "p": 0x27D4EB2F165667C5, "c": 0x85EBCA77C2B2AE63}


@functools.lru_cache(maxsize=500_000)
def _number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def _key(kind: str, total: int) -> int:
    """The key of a set of words from the sum of their numbers, so that a word less is a subtraction."""
    x = (total & _MASK) * _KINDS[kind] & _MASK
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def name_keys(words: Sequence[str], names: Sequence[str]) -> set[int]:
    """A surname with two of the title's longest words; a surname with a slip (it or the other lacks a
    letter, or both do) with two of the very longest."""
    long = [_number(w) for w in sorted((w for w in _telling(words) if len(w) > 3), key=lambda w: (-len(w), w))]
    # a name alone, or with one word, can be shared by a third of all rows; with two words it tells
    pairs = [a + b for a, b in itertools.combinations(long[:NAME_WORDS], 2)] or long
    slips = [a + b for a, b in itertools.combinations(long[:SLIP_WORDS], 2)] or long
    keys = {_key("n", 3 * _number(n) + p) for n in names for p in pairs}
    return keys | {_key("s", 3 * _number(m) + p) for n in names for m in (n, *(n[:i] + n[i + 1 :] for i in range(len(n)))) for p in slips}


def title_keys(words: Sequence[str], entry: bool) -> set[int]:
    """The title's words without none, one or two of them (slips, words added or lost); and for titles that
    were cut off, the words of an entry against every beginning of a unit's title. Of more than LONG_TITLE
    words, "without two" would be hundreds of keys; such titles are cut into CLASSES by a hash of each word
    instead, and two words, changed or not, leave one class at least as it was.
    """
    number = [_number(w) for w in _telling(words)]
    keys: set[int] = set()
    if number:
        total, n = sum(number), len(number)
        keys.add(_key("t", total))
        if n > 2:
            keys |= {_key("t", total - x) for x in number}
        if 4 <= n <= LONG_TITLE:
            keys |= {_key("t", total - x - y) for x, y in itertools.combinations(number, 2)}
        if n > LONG_TITLE - 2:  # the other title may have two words more
            parts: list[list[int]] = [[] for _ in range(CLASSES)]
            for x in number:
                parts[x % CLASSES].append(x)
            keys |= {_key("c", sum(p) + i) for i, p in enumerate(parts) if len(p) > 1}
        if not entry:
            keys |= {_key("p", x) for x in list(itertools.accumulate(number))[1 : n - 1]}
        elif n > 1:
            keys.add(_key("p", total))
    return keys


def block_keys(words: Sequence[str], names: Sequence[str], entry: bool) -> list[int]:
    """Keys under which an entry and a unit meet."""
    return sorted(name_keys(words, names) | title_keys(words, entry))


#: Bits of a name's sketch for its pairs of neighbours, after 26 for its letters; the last one tells a long name.
_PAIR_BITS = 36
#: Most bits that one edit changes, and names of a unit that are held side by side.
EDIT_BITS, LANES = 6, 7
#: The sketch of what can be alike with any name.
_ANY = -1


@functools.lru_cache(maxsize=200_000)
def name_sketch(name: str) -> int:
    """Letters and pairs of neighbours (ends included) of a name as bits. An edit takes two letters and four pairs in or
    out at most, or no letter and six pairs (a swap), so names that are near() differ in EDIT_BITS an edit at most."""
    bits = 1 << 26 + _PAIR_BITS if len(name) > 8 else 0
    for c in name:
        bits |= 1 << ord(c) % 26
    for a, b in itertools.pairwise(f"^{name}$"):
        bits |= 1 << 26 + (ord(a) * 31 + ord(b)) % _PAIR_BITS
    return bits


def candidates(entries: DataFrame, units: DataFrame) -> DataFrame:
    """(eid, uid) pairs that share a key: entries and descriptions of units, not whole units, so a work
    that a third of all documents hold meets an entry only under the descriptions that are near it. Pairs
    whose years are known and more than two apart, or whose authors are known and none of them alike, which
    their log-odds rule out, end here: titles of one pattern meet as often as the square of the tables, so
    such a meeting is told from its two keys and never written. Keys of names and of titles take turns, so that only
    one kind of them is held on disk at a time."""
    eid_year, uid_year = F.col("eid_year"), F.col("uid_year")
    years = eid_year.isNull() | uid_year.isNull() | (F.abs(eid_year - uid_year) <= 2)
    lanes = [F.col(f"s{i}") for i in range(LANES)]
    most = EDIT_BITS + EDIT_BITS * F.shiftright("s", 26 + _PAIR_BITS)
    alike = functools.reduce(lambda a, b: a | b, [F.bit_count(F.col("s").bitwiseXOR(x)) <= most for x in lanes], (F.col("s") == _ANY) | (lanes[0] == _ANY))

    def keyed(df: DataFrame, k: str, keys: Callable[[Sequence[str], Sequence[str]], set[int]], *more: Column) -> DataFrame:
        run = F.pandas_udf(lambda w, n: pd.Series([list(keys(a, b)) for a, b in zip(w, n)]), T.ArrayType(T.LongType()))
        return df.select(k, F.col("year").alias(f"{k}_year"), *more, F.explode(run("words", "names")).alias("key"))

    def meet(left: DataFrame, right: DataFrame, here: Column) -> DataFrame:
        # exploded keys are far more than the planner takes them for, so neither side may be broadcast
        found = cut(left.hint("merge").join(right, "key").where(here).select("eid", "uid").distinct())
        release(found.sparkSession)
        return found

    run = F.pandas_udf(lambda n: pd.Series([[name_sketch(x) for x in a] for a in n]), T.ArrayType(T.LongType()))
    sketched = lambda df, most: df.withColumn("sketches", F.when(F.size("names").between(1, most), run("names")).otherwise(F.array(F.lit(_ANY).cast("long"))))
    side_by_side = [F.coalesce(F.get("sketches", F.lit(i)), F.lit(0).cast("long")).alias(f"s{i}") for i in range(LANES)]
    by_name = meet(keyed(entries, "eid", name_keys), keyed(units, "uid", name_keys), years)
    one = keyed(sketched(entries, 1 << 30), "eid", lambda w, n: title_keys(w, True), F.col("sketches")).select("eid", "eid_year", "key", F.explode("sketches").alias("s"))
    by_title = meet(one, keyed(sketched(units, LANES), "uid", lambda w, n: title_keys(w, False), *side_by_side), years & alike)
    return by_name.union(by_title).distinct()


def score_pairs(pairs: DataFrame, entries: DataFrame, units: DataFrame) -> DataFrame:
    """(eid, unit, odds) of each candidate pair: the best over the unit's descriptions."""
    wide = pairs.join(entries, "eid").join(units.select("uid", "unit", F.col("words").alias("u_words"), F.col("names").alias("u_names"), F.col("year").alias("u_year")), "uid")
    # no title reaches a match with fewer of its words spelled alike
    wide = wide.where(F.size(F.array_intersect("words", "u_words")) >= ALIKE * F.size("words"))
    # nor does any pair of known authors of whom none is alike (the distance admits all slips that near() does)
    slip = lambda a, b: F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) > 8, 4).otherwise(2)
    wide = wide.where((F.size("names") == 0) | (F.size("u_names") == 0) | F.arrays_overlap("names", "u_names") | F.exists("names", lambda a: F.exists("u_names", lambda b: slip(a, b))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for w, n, y, uw, un, uy in zip(p["words"], p["names"], p["year"], p["u_words"], p["u_names"], p["u_year"]):
                w, uw = list(w), list(uw)
                gaps = [] if pd.isna(y) or pd.isna(uy) else [abs(y - uy)]
                other = bool(_OTHER_WORK & set(w[:2])) != bool(_OTHER_WORK & set(uw[:2]))
                # authors and year bound the odds, so most titles need no comparison
                names = author_agreement(list(n), list(un))
                if log_odds(1.0, names, gaps, other) < -2:
                    out.append(-9.0)
                    continue
                out.append(log_odds(title_agreement(w, uw), names, gaps, other))
            yield pd.DataFrame({"eid": p["eid"], "unit": p["unit"], "odds": out})

    schema = T.StructType([pairs.schema["eid"], units.schema["unit"], T.StructField("odds", T.DoubleType())])
    return wide.mapInPandas(run, schema).groupBy("eid", "unit").agg(F.max("odds").alias("odds"))


def propagate(edges: DataFrame, rounds: int = ROUNDS, still: float = STILL, relisted: float = RELISTED) -> DataFrame:
    """(eid, unit, odds, marginal) from (eid, unit, odds), by loopy belief propagation (sum-product).

    ``alpha`` is what the entry's factor tells a pair: with r the odds of the entry's other pairs, the
    states "none" and "one of the others" weigh 1 + sum(r), and only "none" lets the pair be true, so
    alpha = -log(1 + sum(r)). ``beta`` is what the unit's factor tells it: k true pairs of a unit weigh
    ``relisted ** (k - 1)``; with P the product of 1 + relisted * r over its other pairs, the states with the
    pair weigh P and those without it 1 + (P - 1) / relisted. Both are sums over a unit's or entry's rows, less
    the pair's own. Messages are halved towards the old ones while they swing. Raises if they never rest.
    """
    state = cut(edges.select("eid", "unit", "odds", F.lit(0.0).alias("beta"), F.lit(0.0).alias("alpha")))
    release(state.sparkSession)
    keep, before = 0.0, None
    for _ in range(rounds):
        heard = F.exp(F.least(F.col("odds") + F.col("beta"), F.lit(30.0)))
        per_entry = state.groupBy("eid").agg(F.sum(heard).alias("s"), F.count("*").alias("k"))
        one = state.join(per_entry, "eid").withColumn("new_alpha", F.when(F.col("k") == 1, 0.0).otherwise(-F.log1p(F.greatest(F.lit(0.0), F.col("s") - heard))))
        told = F.log1p(relisted * F.exp(F.least(F.col("odds") + F.col("new_alpha"), F.lit(30.0))))
        per_unit = one.groupBy("unit").agg(F.sum(told).alias("logs"), F.count("*").alias("m"))
        others = F.greatest(F.lit(0.0), F.col("logs") - told)
        # log P - log(1 + (P - 1) / relisted), written so that a large P does not overflow
        against = -F.log((1 - 1 / relisted) * F.exp(-others) + 1 / relisted)
        both = one.select("eid", "unit", "odds", "beta", "alpha", "new_alpha").join(per_unit, "unit")
        new_beta = keep * F.col("beta") + (1 - keep) * F.when(F.col("m") == 1, 0.0).otherwise(against)
        after = cut(both.select("eid", "unit", "odds", new_beta.alias("beta"), F.col("new_alpha").alias("alpha"), F.greatest(F.abs(new_beta - F.col("beta")), F.abs(F.col("new_alpha") - F.col("alpha"))).alias("moved")))
        most = after.agg(F.max("moved")).first()[0] or 0.0
        state = after.drop("moved")
        release(state.sparkSession)
        if most < still:
            break
        keep, before = (0.5 if keep or before is not None and most > 0.7 * before else 0.0), most
    else:
        raise RuntimeError(f"messages still move by {most} after {rounds} rounds")
    total = F.col("odds") + F.col("alpha") + F.col("beta")
    return state.select("eid", "unit", "odds", (1 / (1 + F.exp(-total))).alias("marginal"))


def match_references(refs: DataFrame, staging: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(ref_id, doc_id, confidence): every entry with every document of the work that it names.

    Missing authors or years count neither for nor against; an entry without a title matches nothing; a
    ref_id with two entries can match two works; repeated rows count once; null ids are ignored; empty
    tables give an empty result. All entries meet all works through the keys, without a cap.
    """
    docs = cut(read_documents(spread(staging)))
    member = cut(work_units(docs))
    release(docs.sparkSession)
    per_doc = docs.join(member, "doc_id")
    # a document without authors or year has those that most documents of its work have
    usual = lambda c, there: per_doc.where(there).groupBy("unit", c).agg(F.count("*").alias("n")).groupBy("unit").agg(F.max(F.struct("n", c)).alias("u")).select("unit", F.col(f"u.{c}").alias(f"usual_{c}"))
    known = per_doc.where(F.size("words") > 0).join(usual("names", F.size("names") > 0), "unit", "left").join(usual("year", F.col("year").isNotNull()), "unit", "left")
    filled = known.select("unit", "words", F.when(F.size("names") > 0, F.col("names")).otherwise(F.coalesce("usual_names", "names")).alias("names"), F.coalesce("year", "usual_year").alias("year"))
    units = cut(filled.withColumn("uid", F.xxhash64("unit", "words", "names", "year")).dropDuplicates(["uid"]))
    entries = cut(read_entries(spread(refs)).where(F.size("words") > 0).withColumn("eid", F.xxhash64("ref_id", "words", "names", "year")))
    release(docs.sparkSession)
    described = entries.select("eid", "words", "names", "year").dropDuplicates(["eid"])
    edges = score_pairs(candidates(described, units), described, units).where(F.col("odds") > WEAK)
    found = propagate(edges).where(F.col("marginal") >= confidence)
    named = entries.select("ref_id", "eid").join(found, "eid")
    return named.join(member, "unit").groupBy("ref_id", "doc_id").agg(F.max("marginal").alias("confidence"))

