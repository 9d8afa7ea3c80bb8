"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

A piece (what the split pattern yields) is encoded without applying merges one by one. An Aho-Corasick automaton over
all tokens gives the longest token at every position in one pass. The encoder takes the longest token that may follow
the one before; where none may, it takes the token before back, closes that position for good, and goes on with the
token's longest shorter prefix. A position is closed at most once, so the time is linear. Two tokens may stand next
to each other if no merge that comes earlier would have joined bytes across their border; ``Bpe.compatible`` finds
that by undoing merges on both sides of the border, and keeps the answers in the pair-compatibility table. The
result is what the merges give, exactly.

Ids are decoded by one gather: every token's bytes lie in one array, an offset table says where.

The file is read by the driver and sent to the workers (1.5 MB, whatever the input). Defined results: null texts
count as empty and have no tokens; a special token's string inside a text becomes that token, as in the library;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import read, text_of

#: The split of byte-level BPE with ``use_regex``, a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the tokenizers library's Unicode table (16.0) does not have as letters or numbers, while
#: the table of the regex module does.
LATER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same split for texts that hold such code points: those count as neither letters nor numbers.
EXACT_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])+|\s+(?!\S)|\s+"
#: Pieces kept with their ids in a worker, in each of two generations, and kept pair answers.
KEPT_PIECES, KEPT_PAIRS = 200_000, 1_000_000
#: Characters that are encoded and decoded at once.
BLOCK_CHARS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 stands for itself, the rest is moved up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables and encoder for one tokenizer file. Inside, tokens are numbered by the rank of their merge."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        names = [n for n in vocab if len(n) == 1 and n in letters]
        inner = {n: i for i, n in enumerate(names)}
        self.base = {letters[n]: i for n, i in inner.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(names))]
        for a, b in merges:
            if a + b not in inner:
                inner[a + b] = len(inner)
                names.append(a + b)
                self.parts.append((inner[a], inner[b]))
            self.joined[inner[a], inner[b]] = inner[a + b]
        self.ids = np.array([vocab[n] for n in names], dtype=np.uint32)
        raw = [bytes(letters[c] for c in n) for n in names]
        self.sizes = [len(r) for r in raw]
        found = {r.decode("latin-1"): i for i, r in enumerate(raw)}
        self.automaton = ahocorasick.Automaton()
        for word, i in found.items():
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.shorter = [next((found[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in found), -1) for w in (r.decode("latin-1") for r in raw)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.find, self.find_exact = regex.compile(SPLIT).findall, regex.compile(EXACT_SPLIT, regex.V1).findall
        self.far, self.later = regex.compile("[\u0558-\U0010ffff]").search, regex.compile(f"[{LATER}]").search
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        # Tables for decoding, by the ids of the file.
        out = {int(self.ids[i]): r for i, r in enumerate(raw)} | {i: c.encode() for c, i in special.items()}
        most = max(out) + 1
        self.bytes_at, self.bytes = self._table([out.get(i, b"") for i in range(most)])
        self.digits_at, self.digits = self._table([b"%d," % i for i in range(most)])

    @staticmethod
    def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64), np.frombuffer(b"".join(words), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE can leave ``left`` and ``right`` side by side.

        Undo the later of the two tokens' merges, keeping its part at the border, until both are single bytes. At each
        step the tokens at the border are a state that the merges went through; a merge of the two that comes before
        the one just undone would have been done instead.
        """
        key, before = (left, right), 1 << 60
        known = self.pairs.get(key)
        if known is not None:
            return known
        parts, joined, ok = self.parts, self.joined, True
        while True:
            if joined.get((left, right), before) < before:
                ok = False
                break
            l_end, r_end = parts[left][1] == left, parts[right][0] == right
            if l_end and r_end:
                break
            if r_end or (not l_end and left > right):
                before, left = left, parts[left][1]
            else:
                before, right = right + 1, parts[right][0]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def merge(self, piece: str) -> bytes:
        """Ids of a piece, as little-endian 32-bit numbers."""
        chars = piece.encode().decode("latin-1")
        n, sizes = len(chars), self.sizes
        longest = [-1] * n
        for end, token in self.automaton.iter(chars):
            start = end - sizes[token] + 1
            if longest[start] < 0 or sizes[longest[start]] < sizes[token]:
                longest[start] = token
        taken, at, token, closed = [], 0, longest[0], bytearray(n + 1)
        while at < n:
            last = taken[-1] if taken else -1
            while token >= 0:
                to = at + sizes[token]
                if not closed[to] and (last < 0 or self.compatible(last, token)):
                    taken.append(token)
                    at, token = to, longest[to] if to < n else -1
                    break
                token = self.shorter[token]
            else:
                closed[at] = 1
                taken.pop()
                at, token = at - sizes[last], last
        return self.ids[taken].tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece)
        if len(piece) <= 64:
            if len(self.new) >= KEPT_PIECES:
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        get, out = self.new.get, []
        for part in self.at_special(text) if self.at_special else [text]:
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
            else:
                get = self.new.get
                find = self.find_exact if self.far(part) and self.later(part) else self.find
                out += [get(p) or self.piece(p) for p in find(part)]
        return np.frombuffer(b"".join(out), np.uint32)

    @staticmethod
    def gather(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's bytes of all ids, one after the other, and where each id's bytes end."""
        first = starts[ids]
        size = starts[ids + np.uint32(1)] - first
        ends = np.cumsum(size)
        if not len(ids):
            return np.empty(0, np.uint8), ends
        return table[np.arange(ends[-1]) + np.repeat(first - ends + size, size)], ends

    def decode(self, ids: np.ndarray) -> str:
        return self.gather(ids, self.bytes_at, self.bytes)[0].tobytes().decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: tokens, digest of its ids in decimal, digest of its decoded text."""
        each = [self.encode(t) for t in texts]
        cuts = np.cumsum([0, *map(len, each)])
        ids = np.concatenate(each) if each else np.empty(0, np.uint32)
        out = []
        spans = []
        for table, at in ((self.digits, self.digits_at), (self.bytes, self.bytes_at)):
            flat, ends = self.gather(ids, at, table)
            spans.append((memoryview(flat), np.concatenate(([0], ends))[cuts].tolist()))
        (digits, d), (raw, r) = spans
        for i, x in enumerate(each):
            text = bytes(raw[r[i] : r[i + 1]]).decode("utf-8", "replace")
            out.append((len(x), hashlib.sha256(digits[d[i] : max(d[i], d[i + 1] - 1)]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


_built: dict[str, Bpe] = {}


def _bpe(content: bytes) -> Bpe:
    """The tables, built once a worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(content)
    return _built[key]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _sent(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    content = _sent(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(content.value)
        for b in batches:
            ids = [bpe.encode(t).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    content = _sent(encoded.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(content.value)
        for b in batches:
            texts = [bpe.decode(np.array(ids or [], dtype=np.uint32)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every text encoded and decoded again in one pass: doc_id, n_tokens and the digests of ids and decoded text."""
    content = _sent(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(content.value)
        for b in batches:
            rows = [r for block in _blocks(b.column(1).to_pylist()) for r in bpe.digests(block)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the encoder and the decoder."""
    return round_trip(read(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of every document."""
    return round_trip(docs)
