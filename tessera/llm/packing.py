"""Lexical retrieval packing: documents that share rare tokens go into one window of tokens.

A document's whole windows are sequences of their own; what is left of it, less than a window, is packed. Leftovers
are dealt to shards of bounded size by a min-hash of their token pairs, so copies and neighbours meet. Each shard
has a BM25 inverted index over token ids, with document frequencies of the whole corpus. A seed document asks it for
unused neighbours, which fill the window in order of score; the last one is cut and becomes the next seed. So every
sequence is full; the last tokens of a shard are cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import held, materialize, small_batches, table, utf8

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END = 2
#: Tokens of leftovers in a shard (a document counts 32 more), and cells of the min-hash that shards are made of.
SHARD_TOKENS, CELLS = 4_000_000, 4096
#: Terms of a seed that ask the index at a time, its best first, and neighbours it returns at a time.
ASK, RETURNED = 24, 64
K1, B = 1.2, 0.75
#: Bytes of words whose ids a worker remembers, at 100 more for each word.
REMEMBERED = 48 << 20


# The split of the vocabulary's own file, and characters whose lower case is the same letter by letter everywhere
# and which no normal form changes. Words of others go through the tokenizer as they are.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SIMPLE = re.compile("[\x21-\x7e\xa1-\xa7\xa9-\u012f\u0131-\u0148\u014a-\u017e]+")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_table(vocabulary: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The same merges in tiktoken's engine, and the id of each of its ranks as two bytes.

    A word's end is the byte 255, which no text has; it joins the last byte before any other merge. The engine merges
    by rank of the result, which is the same as by pair where each token, taken alone, merges to itself (the tests hold
    every token to that).
    """
    model = json.loads(vocabulary)["model"]
    alphabet, ids, end = byte_alphabet(), model["vocab"], model["end_of_word_suffix"]
    data = lambda t: bytes(alphabet[c] for c in t.removesuffix(end)) + (b"\xff" if t.endswith(end) and t != end else b"")
    ranks, found = {}, []
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    for token in [c + end for c in alphabet] + list(alphabet) + [a + b for a, b in pairs]:
        if ranks.setdefault(data(token), len(found)) == len(found):
            found.append(ids[token])
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), [i.to_bytes(2, "little") for i in found]


class Reader(dict):
    """Token ids of texts. Tokens never span ASCII white space, so this is a table of words and their ids as bytes.

    A new word is cut and merged here; a word that isn't simple, or may hold a special token, is left to the tokenizer.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.special = any(not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        encoding, self.ids_of = merge_table(vocabulary)
        self.merge = encoding._core_bpe.encode_single_piece
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            found = b"".join([self.ids_of[r] for r in self.merge(word.lower() + b"\xff")])
        else:
            text = word.decode()
            if self.special or "<|" in text or not _SIMPLE.fullmatch(text):
                found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            else:
                text = text.lower()
                pieces = (text,) if text.isalpha() else _PIECE.findall(text)
                found = b"".join([self.ids_of[r] for p in pieces for r in self.merge(p.encode() + b"\xff")])
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        self.held += len(word) + 100
        self[word] = found
        return found

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of one text and the end id."""
        if b"<|" not in text:  # a special token is not itself in another case
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) + END.to_bytes(2, "little"), "<u2")


def reader(vocabulary: str) -> Reader:
    """One reader for each worker and vocabulary, with what it remembers."""
    key = f"{len(vocabulary)}:{zlib.crc32(vocabulary.encode())}"
    known = held("packing")
    if key not in known:
        known[key] = Reader(vocabulary)
    return known[key]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cell(ids: np.ndarray) -> int:
    """Cell of a leftover: a mixed hash of the least hash among its pairs of neighbouring tokens."""
    if len(ids) < 2:
        return 0
    pair = (ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:]) * np.uint64(0x9E3779B97F4A7C15)
    pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    least = int((pair ^ (pair >> np.uint64(29))).min())
    return (least * 0x94D049BB133111EB + 0x9E3779B97F4A7C15 >> 20) % CELLS


def _tokens(vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(vocabulary.value)
        for b in batches:
            n, crcs, left, more, cells = [], [], [], [], []
            for t in b["text"]:
                ids = read.ids(t.as_py() or b"")
                whole = len(ids) // WINDOW * WINDOW
                n.append(len(ids))
                crcs.append([ids_crc32(ids[i : i + WINDOW]) for i in range(0, whole, WINDOW)])
                left.append(ids[whole:].tobytes())
                more.append(np.unique(ids[:whole]).tobytes())
                cells.append(cell(ids[whole:]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(left, pa.binary()), pa.array(more, pa.binary()), pa.array(cells, pa.int32())],
                ["doc_id", "doc_tokens", "whole", "left", "more", "cell"],
            )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1 << 16, np.int64)
    for b in batches:
        for left, more in zip(b["left"], b["more"]):
            terms = np.frombuffer(left.as_py() + more.as_py(), np.uint16)
            count[np.unique(terms)] += 1
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used])], ["term", "n"])


class Index:
    """A BM25 inverted index over the leftovers of a shard."""

    def __init__(self, leftovers: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, docs, weights = [], [], []
        self.ask: list[np.ndarray] = []
        for i, ids in enumerate(leftovers):
            term, tf = np.unique(ids, return_counts=True)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            self.ask.append(term[np.argsort(-weight, kind="stable")])
            terms.append(term)
            docs.append(np.full(len(term), i, np.int32))
            weights.append(weight.astype(np.float32))
        none = np.zeros(0)
        term = np.concatenate([none.astype(np.uint16), *terms])
        order = np.argsort(term, kind="stable")
        self.docs = np.concatenate([none.astype(np.int32), *docs])[order]
        self.weights = np.concatenate([none.astype(np.float32), *weights])[order]
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.n = len(leftovers)

    def _scores(self, terms: np.ndarray) -> np.ndarray:
        lists = [slice(self.first[t], self.first[t + 1]) for t in terms.tolist()]
        if not lists:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[s] for s in lists]), np.concatenate([self.weights[s] for s in lists]), self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's ``ASK`` best terms, best first, at most ``RETURNED``."""
        return self._best(self._scores(self.ask[seed][:ASK]), unused)

    def _best(self, score: np.ndarray, unused: np.ndarray) -> np.ndarray:
        found = np.flatnonzero((score > 0) & unused)
        if len(found) > RETURNED:
            found = np.sort(found[np.argpartition(-score[found], RETURNED)[:RETURNED]])
        return found[np.argsort(-score[found], kind="stable")]

    def all_neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed: ``RETURNED`` at a time, by its best terms, then the others.

        ``unused`` is read as the iterator goes on, so who takes a document marks it there.
        """
        for at in range(0, len(self.ask[seed]), ASK):
            score = self._scores(self.ask[seed][at : at + ASK])
            while len(found := self._best(score, unused)):
                yield from (int(i) for i in found)
                score[found] = 0


def pack_shard(sizes: np.ndarray, index: Index | None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (leftover, start in it, length): full windows, then powers of two."""
    unused, start, after = sizes > 0, np.zeros(len(sizes), np.int64), 0
    sequences, seed = [], -1
    while True:
        if seed < 0:
            while after < len(sizes) and not unused[after]:
                after += 1
            if after == len(sizes):
                break
            seed = after
        window, room, cut, waiting, scan = [], WINDOW, -1, None, after
        take = seed
        while take >= 0:
            length = int(min(room, sizes[take] - start[take]))
            window.append((take, int(start[take]), length))
            start[take] += length
            room -= length
            unused[take] = False
            if start[take] < sizes[take]:
                cut = take
            if not room:
                break
            if waiting is None:
                waiting = index.all_neighbours(seed, unused) if index else iter(())
            take = next(waiting, -1)
            if take < 0:  # no more neighbours: the next unused document
                while scan < len(sizes) and not unused[scan]:
                    scan += 1
                take = scan if scan < len(sizes) else -1
        sequences.append(window)
        seed = cut
    if sequences and (rest := sum(p[2] for p in sequences[-1])) < WINDOW:
        pieces, bit = sequences.pop(), 1 << rest.bit_length()
        while pieces:
            bit >>= 1
            if not rest & bit:
                continue
            part, room = [], bit
            while room:
                doc, at, length = pieces.pop(0)
                used = min(length, room)
                part.append((doc, at, used))
                room -= used
                if used < length:
                    pieces.insert(0, (doc, at + used, length - used))
            sequences.append(part)
    return sequences


_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack(frequencies) -> Callable:
    def run(shard: pa.Table) -> pa.Table:
        idf, mean = frequencies.value
        shard = shard.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("left", "ascending")])
        left = [np.frombuffer(x.as_py(), np.uint16) for x in shard["left"]]
        doc_id, tokens = shard["doc_id"].to_pylist(), shard["doc_tokens"].to_pylist()
        number = (shard["shard"][0].as_py() << 32) if len(shard) else 0
        rows = []
        for i, crcs in enumerate(shard["whole"].to_pylist()):
            for k, crc in enumerate(crcs):
                rows.append((doc_id[i], k * WINDOW, WINDOW, crc, tokens[i], number, 0))
                number += 1
        for sequence in pack_shard(np.array([len(x) for x in left], np.int64), Index(left, idf, mean)):
            offset = 0
            for i, at, length in sequence:
                rows.append((doc_id[i], tokens[i] - len(left[i]) + at, length, ids_crc32(left[i][at : at + length]), tokens[i], number, offset))
                offset += length
            number += 1
        columns = list(zip(*rows)) if rows else [()] * len(_PIECES)
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, _PIECES)], names=[n for n, _ in _PIECES])

    return run


def shards(cells: list[tuple[int, int]], most: int = SHARD_TOKENS) -> list[tuple[int, int, int]]:
    """(cell, first shard, shards) for cells (cell, size): small neighbouring cells share one, a large one has several."""
    out, shard, filled = [], 0, 0
    for number, size in sorted(cells):
        parts = -(-size // most)
        if parts > 1 or filled + size > most:
            shard, filled = shard + bool(filled), 0
        if parts > 1:
            out.append((number, shard, parts))
            shard += parts
        else:
            out.append((number, shard, 1))
            filled += size
    return out


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all rows of ``docs(doc_id, text)``.

    Every id of a document and its end id lies in exactly one piece; sequences have 4096 ids or a power of two. A null or
    empty text is the end id alone. Repeated rows are documents of their own. Other columns aren't read. An empty table
    gives an empty result. ``vocabulary`` is the path of a tokenizer's file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    read = own.mapInArrow(_tokens(shared), "doc_id long, doc_tokens long, whole array<long>, left binary, more binary, cell int")
    read = materialize(read.withColumn("row", F.monotonically_increasing_id()), "tokens")  # parts equal rows that share a cell

    total = read.agg(F.count("*").alias("n"), F.sum(F.octet_length("left") / 2).alias("tokens")).first()
    counted = read.select("left", "more").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most 65,536
    n = np.zeros(1 << 16)
    for r in counted:
        n[r["term"]] = r["n"]
    idf = np.log1p((total["n"] - n + 0.5) / (n + 0.5))
    frequencies = spark.sparkContext.broadcast((idf, max(1.0, (total["tokens"] or 0) / max(1, total["n"]))))

    size = (F.octet_length("left") / 2 + 32).cast("long")
    cells = [(r["cell"], r["size"]) for r in read.groupBy("cell").agg(F.sum(size).alias("size")).collect()]  # at most CELLS
    plan = shards(cells)
    places = F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int"))
    dealt = read.drop("more").join(places, "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("doc_id", "doc_tokens", "row"), F.col("parts"))).cast("long"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    grouped = dealt.select("shard", "doc_id", "doc_tokens", "whole", "left").groupBy("shard")
    return grouped.applyInArrow(_pack(frequencies), kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
