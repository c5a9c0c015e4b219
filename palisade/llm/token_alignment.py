"""Alignment of two tokenizers over the bytes of a text.

Tokens of either tokenizer are the rows of an incidence matrix whose columns are the bytes
they cover, held in compressed sparse rows. The row products of one matrix with the other's
transpose link tokens that overlap; those of two matrices of tokens and groups link tokens
that share a group. A group ends where tokens of both end together.

Both tokenizers break a text at a space between two characters that are not white, so a text
is cut there, each distinct part is aligned once for an Arrow batch, and a text's alignment
is its parts' side by side."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .base import arrow_map

MARK = "▁"
#: a worker forgets its parts between two batches once there are more than these
REMEMBERED = 1 << 17
#: entries that one slice of a row product expands at most, but for a single longer row
SLICE = 1 << 20
BREAK = re.compile(r"(?<=\S) (?=\S)")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Csr:
    """A matrix of zeros and ones: row i has its ones in columns[start[i] : start[i + 1]]."""

    start: np.ndarray
    columns: np.ndarray
    width: int

    @staticmethod
    def of_sizes(sizes: np.ndarray) -> Csr:
        """Row i covers the next sizes[i] columns."""
        start = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return Csr(start, np.arange(start[-1]), int(start[-1]))

    @staticmethod
    def of_groups(group: np.ndarray, groups: int) -> Csr:
        """Row i has a one in column group[i]."""
        return Csr(np.arange(len(group) + 1), group.astype(np.int64), groups)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(start, self.rows()[order], len(self.start) - 1)

    def product(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of this matrix times another, in slices of rows: each row is
        the sum of the other's rows that its ones name, added up by column."""
        sizes = np.diff(other.start)[self.columns]
        through = np.concatenate([[0], np.cumsum(sizes)])[self.start]
        low, n = 0, len(self.start) - 1
        while low < n:
            high = max(low + 1, int(np.searchsorted(through, through[low] + SLICE, side="right")) - 1)
            named, count = self.columns[self.start[low] : self.start[high]], sizes[self.start[low] : self.start[high]]
            row = np.repeat(np.repeat(np.arange(low, high), np.diff(self.start[low : high + 1])), count)
            first = np.repeat(other.start[named] - (np.cumsum(count) - count), count)
            key, value = np.unique(row * np.int64(other.width) + other.columns[first + np.arange(len(row))], return_counts=True)
            yield key // max(other.width, 1), key % max(other.width, 1), value
            low = high


@dataclass
class Alignment:
    """Tokens of two tokenizers over the same bytes: group of each token, and the links of
    tokens that end together."""

    group_a: np.ndarray
    group_b: np.ndarray
    groups: int
    link_a: np.ndarray
    link_b: np.ndarray

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of tokens that share a group, in slices: all pairs within each."""
        a, b = Csr.of_groups(self.group_a, self.groups), Csr.of_groups(self.group_b, self.groups)
        for i, j, _ in a.product(b.transposed()):
            yield i, j


def overlap_links(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bytes) of all pairs of tokens with bytes in common."""
    a, b = Csr.of_sizes(sizes_a), Csr.of_sizes(sizes_b)
    found = list(a.product(b.transposed()))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
    """Groups and links of two rows of tokens, given by their bytes, over the same text."""
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    a, b, _ = overlap_links(sizes_a, sizes_b)
    together = end_a[a] == end_b[b]
    a, b = a[together], b[together]
    cuts = end_a[a]
    return Alignment(np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), len(cuts), a, b)


def _byte_values() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Two tokenizers, and what has been found out about parts of texts."""

    def __init__(self, byte_json: str, piece_proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_proto)
        value = _byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        n = self.b.get_piece_size()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        self.bytes_b = [piece(i) for i in range(n)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        # how an id is written inside its group, and as the last of its side of it
        number = lambda v, end: np.array([f"{i}{end}" for i in range(len(v))], object)
        self.text_a, self.last_a = number(self.bytes_a, ","), number(self.bytes_a, "|")
        self.text_b, self.last_b = number(self.bytes_b, ","), number(self.bytes_b, ";")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.groups: list[str] = []

    def bound(self) -> int:
        """No more pairs of ids than these can be linked: of two tokens that end together
        one is the end of the other."""
        return int(self.size_a.sum() + self.size_b.sum())

    def learn(self, parts: list[str]) -> None:
        """Align parts that are not known yet, all in one row of bytes."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        joined = lambda v, ids: b"".join([v[i] for i in ids])
        wanted = [f" {p}".encode() for p in parts]
        ok = [w == joined(self.bytes_a, x) == joined(self.bytes_b, y) for w, x, y in zip(wanted, ids_a, ids_b, strict=True)]
        # a part that does not come back byte by byte has no tokens
        ids_a, ids_b = ([x if k else [] for x, k in zip(ids, ok, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        part_a = np.repeat(np.arange(len(parts)), n_a)
        found = align(self.size_a[a], self.size_b[b])
        n_links = np.bincount(part_a[found.link_a], minlength=len(parts))
        ends = lambda g: np.concatenate([g[1:] != g[:-1], np.ones(min(len(g), 1), bool)])
        strings = np.concatenate([np.where(ends(found.group_a), self.last_a[a], self.text_a[a]), np.where(ends(found.group_b), self.last_b[b], self.text_b[b])])
        order = np.argsort(np.concatenate([found.group_a, found.group_b]), kind="stable")
        through = np.concatenate([[0], np.cumsum(n_a + n_b)])
        row = strings[order].tolist()
        self.groups += ["".join(row[low:high])[:-1] for low, high in zip(through[:-1].tolist(), through[1:].tolist(), strict=True)]
        in_group = lambda g: np.bincount(g, minlength=found.groups)
        first = np.concatenate([[0], np.cumsum(n_links)])
        shared = np.concatenate([[0], np.cumsum(in_group(found.group_a) * in_group(found.group_b))])
        known = len(self.number)
        self.number |= {p: known + i for i, p in enumerate(parts)}
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_links, shared[first[1:]] - shared[first[:-1]], np.array(ok)], axis=1)])
        self.start = np.concatenate([self.start, self.start[-1] + first[1:]])
        self.links = np.concatenate([self.links, a[found.link_a] * len(self.bytes_b) + b[found.link_b]])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text: n_a, n_b, n_groups and shared pairs; its groups as text; and the
        keys of its links behind each other, with their number for each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        # the mark stands for a space among the pieces, so a text that holds one never comes back
        cut = [BREAK.split(t) if t and MARK not in t else [] for t in texts]
        if fresh := list({p for parts in cut for p in parts if p not in self.number}):
            self.learn(fresh)
        number = self.number
        rows = [[number[p] for p in parts] for parts in cut]
        rows = [r if self.counts[r, 4].all() else [] for r in rows]
        flat = np.array([i for r in rows for i in r], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        totals = np.stack([np.bincount(text, weights=self.counts[flat, k], minlength=len(texts)).astype(np.int64) for k in range(4)], axis=1)
        sizes = self.counts[flat, 2]
        place = np.repeat(self.start[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return totals, [";".join([self.groups[i] for i in r]) for r in rows], self.links[place], totals[:, 2]


@lru_cache(maxsize=2)
def aligner(byte_json: str, piece_proto: bytes) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(byte_json, piece_proto)


def aligned_texts(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_shared (pairs of tokens in one group), groups_sha256 and
    links, the keys of the id pairs linked: id of the first tokenizer times the size of the
    second's vocabulary, plus the id of the second."""
    context = docs.sparkSession.sparkContext
    with open(byte_path or byte_model(), encoding="utf-8") as f, open(piece_path or piece_model(), "rb") as g:
        held = context.broadcast((f.read(), g.read()))

    def run(batch: pa.RecordBatch):
        totals, groups, links, n_links = aligner(*held.value).texts(batch.column(1).to_pylist())
        sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        start = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(start), pa.array(links))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(totals[:, k]) for k in range(4)], pa.array(sha, pa.string()), lists], ["doc_id", "n_a", "n_b", "n_groups", "n_shared", "groups_sha256", "links"])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_shared bigint, groups_sha256 string, links array<bigint>")


def link_counts(aligned: DataFrame, pieces: int) -> DataFrame:
    """key, n, best: how many links hold each pair of ids, and whether none with the same id
    of the second tokenizer has more. Pairs are added up where they are read."""
    counts = aligned.select(F.explode("links").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    best = counts.groupBy((F.col("key") % pieces).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.join(best, F.col("key") % pieces == F.col("b"))
    return joined.select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared of
    every document: tokens of the two tokenizers over a space and the text, groups that end
    where both end, links of tokens that end together, links whose pair of ids is linked in
    the corpus as often as any with its second id, the sum of these counts over the links,
    the digest of the groups, and pairs of tokens that share a group.

    The table of counts is broadcast: pairs of ids that end together are fewer than the
    bytes of both vocabularies (`Aligner.bound`, under a million here), whatever the corpus,
    and the job stops should there be more. Texts that are null, empty or do not come back
    byte by byte have zeros and an empty digest. Texts of any length are read whole; the
    product goes in slices. Ties for the highest count all count as best. Repeated rows
    give a row each and count each, an empty table gives none; other columns are ignored."""
    spark = docs.sparkSession
    with open(byte_path or byte_model(), encoding="utf-8") as f, open(piece_path or piece_model(), "rb") as g:
        known = Aligner(f.read(), g.read())
    aligned = write_through(aligned_texts(docs, byte_path, piece_path), "aligned-texts")
    counts = link_counts(aligned, len(known.bytes_b)).limit(known.bound() + 1).toArrow()
    if counts.num_rows > known.bound():
        raise ValueError("more linked pairs than the vocabularies allow")
    counts = counts.sort_by("key")
    held = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy() for c in ("key", "n", "best")))

    def run(batch: pa.RecordBatch):
        keys, n, best = held.value
        links = batch.column(batch.num_columns - 1)
        flat, sizes = links.flatten().to_numpy(), links.value_lengths().to_numpy()
        at = np.searchsorted(keys, flat)
        text = np.repeat(np.arange(len(sizes)), sizes)
        added = lambda v: pa.array(np.bincount(text, weights=v[at], minlength=len(sizes)).astype(np.int64)) if len(flat) else pa.array(np.zeros(len(sizes), np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes.astype(np.int64)), added(best), added(n), *batch.columns[4:6]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"])

    kind = dict(docs.dtypes)["doc_id"]
    read = aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_shared", "links")
    return arrow_map(read, run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_shared bigint")
