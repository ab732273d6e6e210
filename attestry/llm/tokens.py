"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

Text is cut into pieces by the vocabulary's published pattern. Short pieces are encoded directly. A
long piece without a cut (a run of letters, blanks or signs of more than ``LONG_BYTES`` bytes) is
encoded by *tree concatenation*: its halves are encoded on their own, in parallel, down to
``LEAF_BYTES``; each pair of results is then joined by encoding a window around the join again, and
the window grows until both its edges agree with what lies outside. Two neighbouring tokens agree
when encoding their joint bytes gives the same two tokens; a row of tokens in which all neighbours
agree is the encoding of its bytes, so the result is exact.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Published pre-tokenising pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a piece is encoded by tree concatenation.
LONG_BYTES = 8192
#: Bytes of a leaf of the tree.
LEAF_BYTES = 1024
#: Ids of an empty text and of a null text.
EMPTY_IDS: tuple[int, ...] = ()


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k.tiktoken`` of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class ByteBpe:
    """Exact encoder over the ranks of a vocabulary file."""

    def __init__(self, raw: bytes, long_bytes: int = LONG_BYTES, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.whole = self.core._core_bpe.encode_single_piece  # the merges alone, on bytes
        self.cut = regex.compile(PATTERN)
        self.long_run = regex.compile(r"\p{L}{%d,}|\p{N}{%d,}|\s{%d,}|[^\s\p{L}\p{N}]{%d,}" % ((max(2, long_bytes // 4),) * 4))
        self.long_bytes, self.leaf_bytes = long_bytes, leaf_bytes
        self._agree: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; ``EMPTY_IDS`` for none."""
        if not text:
            return list(EMPTY_IDS)
        if len(text) * 4 <= self.long_bytes or not self.long_run.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        short: list[str] = []
        for m in self.cut.finditer(text):
            piece = m.group()
            if len(piece) * 4 > self.long_bytes and len(data := piece.encode()) > self.long_bytes:
                for x in short:
                    out += self.whole(x.encode())
                short = []
                out += self.tree(data)
            else:
                short.append(piece)
        for x in short:
            out += self.whole(x.encode())
        return out

    def tree(self, data: bytes, workers: int = 4) -> list[int]:
        """Ids of one piece, by tree concatenation."""
        n = 1
        while len(data) / n > self.leaf_bytes:
            n *= 2
        edges = [len(data) * i // n for i in range(n + 1)]
        leaves = [data[a:b] for a, b in zip(edges, edges[1:]) if b > a]
        with ThreadPoolExecutor(workers) as pool:
            level = list(pool.map(self.whole, leaves))
            while len(level) > 1:
                pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                level = list(pool.map(lambda p: self.join(*p) if len(p) == 2 else p[0], pairs))
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        if self.agree(left[-1], right[0]):
            return left + right
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            mid = self.whole(b"".join(self.bytes_of[t] for t in left[len(left) - a :] + right[:b]))
            ok_left = a == len(left) or self.agree(left[-a - 1], mid[0])
            ok_right = b == len(right) or self.agree(mid[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + mid + right[b:]
            a, b = a if ok_left else a * 2, b if ok_right else b * 2

    def agree(self, x: int, y: int) -> bool:
        """Whether two tokens stay as they are when their bytes are encoded together."""
        known = self._agree.get((x, y))
        if known is None:
            known = self.whole(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
            if len(self._agree) < 200_000:
                self._agree[x, y] = known
        return known


@functools.lru_cache(maxsize=2)
def _encoder(raw: bytes) -> ByteBpe:
    return ByteBpe(raw)


def _encode_batches(broadcast, keep: Sequence[str], text: str, out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(broadcast.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = [encoder.encode(t) if t else list(EMPTY_IDS) for t in texts]
            arrays = [batch.column(c) for c in keep] + [pa.array(ids, type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, out])

    return run


def encode_corpus(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and the token ids of ``text``, without special tokens.

    A null text and an empty text have the ids ``[]``; a blank text is encoded as it is. Texts of any
    length are encoded whole. Repeated rows stay repeated. Columns other than ``keep`` and ``text`` are
    not read; an ``out`` that is also in ``keep`` is refused. No shuffle. The vocabulary (0.8 MB,
    whatever the corpus) is broadcast, so executors need no file.
    """
    if out in keep:
        raise ValueError(f"{out} is already a kept column")
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType()))])
    wanted = list(dict.fromkeys([*keep, text]))
    return docs.select(*wanted).mapInArrow(_encode_batches(raw, list(keep), text, out), schema)


def decode(ids: Sequence[int], raw: bytes) -> str:
    """The text of ids (for round trips)."""
    encoder = _encoder(raw)
    return b"".join(encoder.bytes_of[i] for i in ids).decode("utf-8")
