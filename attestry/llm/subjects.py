"""Subject areas of documents (problem 10).

Each sentence is judged by labelling functions: a lexicon of telling words, a word model, the section (the
other sentences of the paragraph), the address (container) and the source. Lexicon and word model are
learned from hand labels of documents, in any language: which sentences of a document its labels are
about is estimated together with the words (expectation maximisation, with a class for sentences that are
about none). No function is trusted as it is: a latent-area model learns their accuracies from how they
agree over all sentences of the corpus, without labels, and gives each sentence posterior area
probabilities. A document is about an area when a whole paragraph or more is: two sentences of it in one
paragraph, or a paragraph that has no other area; a single sentence within another area's paragraph is a
mention. (Where line ends were lost, a telling sentence and two plain ones after it are a paragraph.)
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.lineage import cut
from attestry.tables import spread

_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\W_]|«)|\n+")
_BLANK_LINE = re.compile(r"\n\s*\n")
_ENDS = frozenset(".!?:…»\"")
_FUNCTIONS = ("lexicon", "words", "section", "address", "source")

#: Most hand-labelled documents that the words are learned from, chosen by hash of doc_id, and most
#: characters of them.
MAX_LABELLED, MAX_CHARS = 5000, 30_000_000
#: Least probability with which the word model votes, and least posterior of a sentence's area.
WORD_SURE, SURE = 0.9, 0.6
#: Least sentences of a word of the lexicon, and least share of them in one area.
LEAST_SENTENCES, LEAST_SHARE = 3, 0.8
#: Most characters of a line without a stop that is a heading.
HEADING_CHARS = 80
#: Rounds of expectation maximisation, and share of a labelled document's sentences that is about none.
EM_ROUNDS, ABOUT_NONE = 8, 0.2

_MARKS = re.compile("[\u0300-\u036f]")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    return text.casefold() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def words_of(sentence: str) -> str:
    """Words of a plain sentence, parted by blanks."""
    return " ".join(_WORD.findall(sentence))


def paragraphs_of(text: str) -> list[list[str]]:
    """Paragraphs as lists of plain sentences (as :func:`words_of` gives them); a heading is no sentence.

    Lines broken inside a sentence are joined: a line that does not end a sentence goes on in the next. A
    short line without a stop that stands alone in a text of several paragraphs is a heading.
    """
    out: list[list[str]] = []
    blocks = [b for b in _BLANK_LINE.split(plain(text)) if b.strip()]
    for block in blocks:
        if len(blocks) > 1 and len(block) < HEADING_CHARS and "\n" not in block.strip() and block.rstrip()[-1] not in _ENDS:
            continue
        lines: list[list[str]] = []
        for line in block.split("\n"):
            if lines and lines[-1][-1].rstrip()[-1:] not in _ENDS:
                lines[-1].append(line)
            else:
                lines.append([line])
        for parts in lines:
            sentences = [w for s in _SENTENCE.split(" ".join(parts)) if s and (w := words_of(s))]
            if sentences:
                out.append(sentences)
    return out


def _telling(sentence: str) -> set[str]:
    """Words of a sentence that can tell: of three letters or more, without digits."""
    return {w for w in sentence.split() if len(w) > 2 and w.isalpha()}


@dataclass
class Words:
    """Lexicon and word model: per word its log-odds for each area and for none, and the area it tells."""

    areas: int
    index: dict[str, int] = field(default_factory=dict)
    odds: np.ndarray | None = None
    prior: np.ndarray | None = None
    lexicon: dict[str, int] = field(default_factory=dict)
    _memo: dict = field(default_factory=dict)
    _known: frozenset = frozenset()

    @classmethod
    def fit(cls, documents: Iterable[tuple[str, Sequence[int]]], areas: int, descriptions: Sequence[str] = ()) -> Words:
        """From (text, areas). A sentence is about one of its document's areas or about none (class
        ``areas``); which one is estimated. The words of a subject's description are in the lexicon as
        well, where the labelled sentences do not say otherwise."""
        index: dict[str, int] = {}
        words: list[int] = []
        starts: list[int] = []
        allowed: list[Sequence[int]] = []
        for text, labels in documents:
            for sentences in paragraphs_of(text) if labels else ():
                for s in sentences:
                    if told := _telling(s):
                        starts.append(len(words))
                        words += [index.setdefault(w, len(index)) for w in told]
                        allowed.append(labels)
        told_by = _description_words(descriptions)
        if not starts:
            return cls(areas, {}, None, None, told_by)
        at = np.array(words)
        sentence = np.repeat(np.arange(len(starts)), np.diff([*starts, len(words)]))
        mask = np.full((len(starts), areas + 1), -np.inf)
        mask[:, areas] = 0.0
        for i, labels in enumerate(allowed):
            mask[i, list(labels)] = 0.0
        share = np.where(np.isfinite(mask), (1 - ABOUT_NONE) / np.maximum(1, np.isfinite(mask).sum(1, keepdims=True) - 1), 0.0)
        share[:, areas] = ABOUT_NONE
        n = np.bincount(at, minlength=len(index)).astype(float)
        for step in range(EM_ROUNDS + 1):
            held = np.stack([np.bincount(at, weights=share[sentence, k], minlength=len(index)) for k in range(areas + 1)], axis=1)
            total = share.sum(0)
            base = (n / len(starts))[:, None]
            odds = np.log((held + 2 * base) / (total + 2) / base)
            prior = np.log((total + 1) / (total.sum() + areas + 1))
            if step == EM_ROUNDS:
                break
            score = np.add.reduceat(odds[at], starts) + prior + mask
            share = np.exp(score - score.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
        best = held.argmax(1)
        sure = (n >= LEAST_SENTENCES) & (held.max(1) >= LEAST_SHARE * n) & (best < areas)
        lexicon = {w: int(best[i]) for w, i in index.items() if sure[i]}
        lexicon |= {w: k for w, k in told_by.items() if w not in lexicon and (w not in index or n[index[w]] < LEAST_SENTENCES)}
        return cls(areas, index, odds, prior, lexicon)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_memo": {}, "_known": frozenset()}

    def vote(self, sentence: str) -> tuple[int, int]:
        """The lexicon's area (-1 without any or with a tie) and the word model's (-1 if it is not sure)."""
        self._known = self._known or frozenset(self.index).union(self.lexicon)
        told = self._known.intersection(sentence.split())
        if told in self._memo:
            return self._memo[told]
        if len(self._memo) > 50_000:
            self._memo.clear()
        top = Counter(self.lexicon[w] for w in told if w in self.lexicon).most_common(2)
        by_lexicon = -1 if not top or len(top) > 1 and top[0][1] == top[1][1] else top[0][0]
        by_words = -1
        if self.odds is not None and (rows := [self.index[w] for w in told if w in self.index]):
            score = self.odds[rows].sum(0) + self.prior
            k = int(score.argmax())
            if k < self.areas and 1 >= WORD_SURE * float(np.exp(score - score[k]).sum()):
                by_words = k
        self._memo[told] = by_lexicon, by_words
        return by_lexicon, by_words


def _description_words(descriptions: Sequence[str]) -> dict[str, int]:
    """Words of four letters or more that only one subject's description has."""
    owner: dict[str, set[int]] = defaultdict(set)
    for i, d in enumerate(descriptions):
        for w in _telling(words_of(plain(d or ""))):
            if len(w) > 3:
                owner[w].add(i)
    return {w: min(v) for w, v in owner.items() if len(v) == 1}


@dataclass
class Judges:
    """The labelling functions."""

    words: Words
    address: dict[str, int]
    source: dict[str, int]

    def votes(self, paragraphs: list[list[str]], container: str | None, source: str | None) -> list[list[tuple[int, ...]]]:
        """For each sentence of each paragraph: the vote of each function, -1 for none."""
        address = self.address.get((container or "").strip().casefold(), -1)
        origin = self.source.get((source or "").strip().casefold(), -1)
        out = []
        for sentences in paragraphs:
            own = [self.words.vote(s) for s in sentences]
            around: dict[int, int] = {}
            for a, b in own:
                if a >= 0:
                    around[a] = around.get(a, 0) + 1
                if b >= 0 and b != a:
                    around[b] = around.get(b, 0) + 1
            rows = []
            for a, b in own:
                if a < 0 and b < 0:
                    rows.append((-1,) * 5)
                    continue
                first = second = 0
                section = -1
                for k, n in around.items():
                    n -= k in (a, b)
                    if n > first:
                        first, second, section = n, first, k
                    elif n > second:
                        second = n
                rows.append((a, b, section if first > 1 and first > second else -1, address, origin))
            out.append(rows)
        return out


@dataclass
class Accuracies:
    """How often each function is right when it votes, and how frequent the areas are."""

    right: list[float]
    prior: list[float]
    _known: dict = field(default_factory=dict)

    @classmethod
    def learn(cls, patterns: Mapping[tuple[int, ...], float], areas: int, rounds: int = 25) -> Accuracies:
        """Expectation maximisation over vote patterns and their counts; no labels. Prior votes keep a
        small corpus from explaining all votes by one area."""
        right = [0.8, 0.8, 0.6, 0.4, 0.4][: len(_FUNCTIONS)]
        prior = [1 / areas] * areas
        for _ in range(rounds):
            model = cls(right, prior)
            hit, cast, mass = [18.0, 17.0, 12.0, 4.0, 4.0], [20.0, 20.0, 20.0, 10.0, 10.0], [5.0] * areas
            for votes, n in patterns.items():
                p = model.posterior(votes)
                for i in range(areas):
                    mass[i] += n * p[i]
                for j, v in enumerate(votes):
                    if v >= 0:
                        cast[j] += n
                        hit[j] += n * p[v]
            right = [min(0.97, max(1.2 / areas, h / c)) for h, c in zip(hit, cast)]
            prior = [m / sum(mass) for m in mass]
        return cls(right, prior)

    def best(self, votes: tuple[int, ...]) -> tuple[int, float]:
        """The likeliest area and its probability."""
        if votes not in self._known:
            p = self.posterior(votes)
            i = max(range(len(p)), key=p.__getitem__)
            self._known[votes] = i, p[i]
        return self._known[votes]

    def posterior(self, votes: Sequence[int]) -> list[float]:
        areas = len(self.prior)
        logs = [math.log(p) for p in self.prior]
        for j, v in enumerate(votes):
            if v >= 0:
                yes, no = math.log(self.right[j]), math.log((1 - self.right[j]) / max(1, areas - 1))
                logs = [x + (yes if i == v else no) for i, x in enumerate(logs)]
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]


def areas_of(votes: list[list[tuple[int, ...]]], model: Accuracies) -> dict[int, float]:
    """Areas that a paragraph or more is about, each with its best paragraph's mean posterior."""
    out: dict[int, float] = {}
    for rows in votes:
        told: list[tuple[int, float]] = []  # -1: a sentence that says nothing about the area
        for row in rows:
            i, p = model.best(row) if max(row[:2]) >= 0 else (-1, 0.0)
            told.append((i, p) if p >= SURE else (-1, 0.0))
        n = Counter(i for i, _ in told if i >= 0)
        last = max((k for k, (i, _) in enumerate(told) if i >= 0), default=-1)
        for i, count in n.items():
            at = next(k for k, (j, _) in enumerate(told) if j == i)
            # paragraphs that were run together: one telling sentence with the plain ones that follow it
            own = at < last and all(j == -1 for j, _ in told[at + 1 : at + 3])
            if count >= 2 or len(n) == 1 or own:
                out[i] = max(out.get(i, 0.0), sum(p for j, p in told if j == i) / count)
    return out


def fit_judges(docs: DataFrame, labels: DataFrame, subjects: Sequence[str], descriptions: Sequence[str] = ()) -> Judges:
    """Labelling functions from hand-labelled documents, at most ``MAX_LABELLED`` of them and ``MAX_CHARS``
    characters (bounds by parameter)."""
    index = {s: i for i, s in enumerate(subjects)}
    hand = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(list(subjects))).groupBy("doc_id").agg(F.collect_set("subject").alias("areas"))
    chosen = hand.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "container", "source").join(F.broadcast(chosen), "doc_id")
    room = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of MAX_LABELLED documents
    kept = rows.select("doc_id", F.length("text").alias("n")).withColumn("sum", F.sum("n").over(room)).where(F.col("sum") <= MAX_CHARS).select("doc_id").distinct()
    rows = sorted(rows.join(F.broadcast(kept), "doc_id").collect(), key=lambda r: (r.doc_id, r.text))
    words = Words.fit([(r.text, sorted(index[a] for a in r.areas)) for r in rows], len(subjects), descriptions)

    def leaning(name: str) -> dict[str, int]:
        seen: dict[str, Counter[int]] = defaultdict(Counter)
        for r in rows:
            if r[name] and r[name].strip():
                seen[r[name].strip().casefold()].update(index[a] for a in r.areas)
        return {k: c.most_common(1)[0][0] for k, c in seen.items() if sum(c.values()) >= 5 and c.most_common(1)[0][1] >= 0.6 * sum(c.values())}

    return Judges(words, leaning("container"), leaning("source"))


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, probability): one row per area that a paragraph or more of the document is about.

    Null, empty and blank texts, and texts without any area, give no row; a doc_id in several rows gives
    the areas of all of them once; null subjects are ignored; without labels only the words of the
    descriptions vote. Every text is judged whole and once; the votes
    are kept, counted by pattern (a bounded number of patterns goes to the driver), and assigned.
    """
    about = F.max("description") if "description" in subjects.columns else F.lit("")
    listed = subjects.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.min("subject_no").alias("n"), about.alias("about")).orderBy("n", "subject").collect()
    names = [r.subject for r in listed]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("subject", T.StringType()), T.StructField("probability", T.DoubleType())])
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    judges = docs.sparkSession.sparkContext.broadcast(fit_judges(docs, labels, names, [r.about for r in listed]))
    base = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "container", "source")
    base = spread(base)
    voted = T.StructType([docs.schema["doc_id"], T.StructField("votes", T.StringType())])
    votes = cut(base.mapInArrow(_vote(judges, voted.names), voted))  # each text is judged once
    patterns = votes.select(F.explode(F.split("votes", "[;|]")).alias("v")).where("v <> '-'").groupBy("v").agg(F.count("*").alias("n")).collect()
    model = Accuracies.learn({tuple(map(int, r.v.split(","))): r.n for r in patterns}, len(names))
    found = votes.mapInArrow(_assign(model, names, schema.names), schema)
    return found.groupBy("doc_id", "subject").agg(F.max("probability").alias("probability"))


def _vote(judges, names: list[str]):
    """(doc_id, votes): paragraphs parted by ``|``, sentences by ``;``, functions by commas; ``-`` for a
    sentence without a vote. Texts without any vote are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for d, t, c, s in zip(*(col.to_pylist() for col in batch.columns)):
                rows = judges.value.votes(paragraphs_of(t), c, s)
                if any(max(r[:2]) >= 0 for p in rows for r in p):
                    ids.append(d)
                    out.append("|".join(";".join(",".join(map(str, r)) if max(r[:2]) >= 0 else "-" for r in p) for p in rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(out, pa.string())], names=names)

    return run


def _assign(model: Accuracies, subjects: list[str], names: list[str]):
    none = (-1,) * len(_FUNCTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, v in zip(*(col.to_pylist() for col in batch.columns)):
                votes = [[none if r == "-" else tuple(map(int, r.split(","))) for r in p.split(";")] for p in v.split("|")]
                rows += [(d, subjects[i], p) for i, p in areas_of(votes, model).items()]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=names)

    return run
