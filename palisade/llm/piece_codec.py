"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters stand in a row; an agenda holds every adjacent pair that together is a
piece of the vocabulary, best score first and leftmost among equals, and the pair at its top
is merged until none is left. Characters without a piece become byte pieces.

Two characters that stand side by side in no piece are never merged. Characters that do are
put in one class, a space in front of any of them aside; so a text is cut where the class
changes and in front of spaces, and each segment is encoded on its own and remembered. The
classes are read off the vocabulary. The sentencepiece library encodes and decodes the
segments that an Arrow batch brings for the first time as well."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map

SPACE_MARK = "▁"
#: a worker forgets its segments between two batches once there are more than these
REMEMBERED = 1 << 19
#: up to so many symbols the agenda is a list that is searched, beyond it a heap
SHORT = 40
#: the rank of a pair that is no piece
NO_PIECE = float("inf")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segment_pattern(pieces: Iterable[str]) -> re.Pattern:
    """What finds the segments of a marked text. If a piece holds a space behind another
    character, a text is one segment."""
    pieces = list(pieces)
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for piece in pieces:
        for x, y in zip(piece, piece[1:]):
            if x != SPACE_MARK and y == SPACE_MARK:
                return re.compile(".+", re.S)
            if x != SPACE_MARK:
                parent[root(y)] = root(x)
    classes: dict[str, list[str]] = {}
    for c in parent:
        classes.setdefault(root(c), []).append(c)
    runs = sorted(("".join(map(re.escape, sorted(c))) for c in classes.values() if len(c) > 1), key=len, reverse=True)
    return re.compile("|".join([*(f"{SPACE_MARK}*[{c}]+" for c in runs), f"{SPACE_MARK}*[^{SPACE_MARK}]", f"{SPACE_MARK}+"]), re.S)


class PieceCodec(dict):
    """Segment -> (number of ids, decimal ids joined by commas, decoded segment); a segment
    that is not there yet is encoded when it is asked for."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece.Type
        rules, trained = proto.normalizer_spec, proto.trainer_spec
        plain = not (rules.precompiled_charsmap or rules.normalization_rule_tsv or rules.remove_extra_whitespaces or trained.treat_whitespace_as_suffix)
        if trained.model_type != trained.BPE or not trained.byte_fallback or not rules.add_dummy_prefix or not plain:
            raise ValueError("only merge-type vocabularies with byte pieces, a space in front and no normalisation")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        super().__init__()
        self.library = SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.bytes = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.shown = [p.piece.replace(SPACE_MARK, " ") for p in proto.pieces]
        self.segment = segment_pattern(self.ids)
        self.fresh: list[tuple[str, list[int]]] = []
        #: segments on which the library has another opinion
        self.odd: set[str] = set()

    def segments(self, text: str) -> list[str]:
        """The text with a space in front, spaces marked, cut where nothing merges across."""
        return self.segment.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols left once no adjacent pair is a piece."""
        if len(symbols) > SHORT:
            return self.merged_by_heap(symbols)
        rank = self.rank
        agenda = [rank.get(x + y, NO_PIECE) for x, y in zip(symbols, symbols[1:])]
        while agenda and (top := min(agenda)) < NO_PIECE:
            i = agenda.index(top)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], NO_PIECE)
        return symbols

    def merged_by_heap(self, symbols: list[str]) -> list[str]:
        """The same in n log n. A merge lives on in its left symbol; agenda entries of
        symbols that have grown or gone since are skipped."""
        rank, last = self.rank, len(symbols)
        agenda = [(rank[both], i, i + 1, len(both)) for i in range(last - 1) if (both := symbols[i] + symbols[i + 1]) in rank]
        heapify(agenda)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        while agenda:
            _, left, right, size = heappop(agenda)
            x, y = symbols[left], symbols[right]
            if not x or not y or len(x) + len(y) != size:
                continue
            symbols[left] = joined = x + y
            symbols[right] = ""
            after[left] = following = after[right]
            if following < last:
                before[following] = left
                if (both := joined + symbols[following]) in rank:
                    heappush(agenda, (rank[both], left, following, len(both)))
            if (previous := before[left]) >= 0 and (both := symbols[previous] + joined) in rank:
                heappush(agenda, (rank[both], previous, left, len(both)))
        return [s for s in symbols if s]

    def encoded(self, segment: str) -> list[int]:
        """Ids of a segment."""
        out = []
        for s in self.merged(list(segment)):
            found = self.ids.get(s)
            out += [self.byte_ids[b] for b in s.encode()] if found is None else [found]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of a segment's ids: marks are spaces, and byte pieces are UTF-8."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        return b"".join(bytes([self.bytes[i]]) if i in self.bytes else self.shown[i].encode() for i in ids).decode(errors="replace")

    def __missing__(self, segment: str) -> tuple[int, str, str]:
        ids = self.encoded(segment)
        self.fresh.append((segment, ids))
        self[segment] = entry = (len(ids), ",".join(map(str, ids)), self.decoded(ids))
        return entry

    def check(self) -> None:
        """Encode and decode the segments met since the last check with the library, which
        puts a space in front itself. A segment without one is checked behind a line end,
        which no piece holds with another character; a lone space holds nothing to merge."""
        some = [(s, ids) for s, ids in self.fresh if s != SPACE_MARK]
        self.fresh = []
        if not some:
            return
        front = self.encoded(f"{SPACE_MARK}\n")
        theirs = self.library.encode([s[1:] if s[0] == SPACE_MARK else f"\n{s}" for s, _ in some], num_threads=1)
        texts = self.library.decode(theirs, num_threads=1)
        for (s, ids), other, text in zip(some, theirs, texts, strict=True):
            spaced = s[0] == SPACE_MARK
            if (ids if spaced else front + ids) != other or (self[s][2][1:] if spaced else f"\n{self[s][2]}") != text:
                self.odd.add(s)

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    """One codec for all tasks of a worker."""
    return PieceCodec(model)


def _coded(c: PieceCodec, texts: list[str | None]) -> list[tuple[int, str, str, bool]]:
    cut = [c.segments(t or "") for t in texts]
    made = [[c[s] for s in segments] for segments in cut]
    c.check()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for segments, found in zip(cut, made, strict=True):
        agrees = not c.odd or c.odd.isdisjoint(segments)
        out.append((sum(f[0] for f in found), sha(",".join([f[1] for f in found])), sha("".join([f[2] for f in found])[1:]), agrees))
    c.forget()
    return out


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees of every document: the number of
    ids, the digest of the ids joined by commas, that of the text decoded from them, and
    whether the library gives the same for all its segments.

    `model` is the path of a vocabulary; its bytes are sent to the workers. Null and empty
    texts have no ids and decode to the empty text. A text of any length is one row, encoded
    segment by segment; a segment without spaces takes time in proportion to n log n.
    Equal scores go to the leftmost pair. Repeated rows give a row each, an empty table
    none; other columns are ignored."""
    with open(model or model_path(), "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch):
        n, ids, texts, agrees = zip(*_coded(codec(held.value), batch.column(1).to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts), pa.array(agrees)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean")


def encoded_ids(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids of every document, as `encode_documents` counts them."""
    with open(model or model_path(), "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch):
        c = codec(held.value)
        lists = [[int(i) for s in c.segments(t or "") for i in c[s][1].split(",")] for t in batch.column(1).to_pylist()]
        c.check()
        c.forget()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_documents(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text of each row's ids (null: no ids)."""
    with open(model or model_path(), "rb") as f:
        held = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch):
        c = codec(held.value)
        texts = [c.decoded(ids or [])[1:] for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(coded.select("doc_id", "ids"), run, f"doc_id {dict(coded.dtypes)['doc_id']}, text string")
