"""Quoted passages linked to the messages they come from, and conversations in reply order
without the quotes.

Lines that begin with > marks are quotes; the number of marks is their level. A passage is a
run of lines of one level. Passages, their paragraphs, lines and sentences are normalised
and hashed, and joined to the messages that hold the same text as their own."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from ..session import write_through
from .base import arrow_map, bit_filter, passes

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_LEAD = re.compile(r"[ \t]*(?:On .{1,200}\bwrote|.{1,100} (?:said|writes|schrieb|escribió|a écrit)) ?:[ \t]*")
#: letters of scripts that put no space between words: Thai to Myanmar, Khmer, kana, Han
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ACCENTS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
_WORD = re.compile(rf"(?:(?![{_UNSPACED}])[\w{_ACCENTS}])+|(?=[\w{_ACCENTS}])[{_UNSPACED}]")
_LETTER = re.compile(f"[{_UNSPACED}]")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？｡])")
#: a passage needs so many words to be linked; two letters are a word where none are spaced
MIN_WORDS = 3


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of each line; the line before a quote that says who
    wrote it has level -1."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    for k in range(len(out) - 1):
        if out[k][0] < out[k + 1][0] and _LEAD.fullmatch(out[k][1].rstrip("\r")):
            out[k] = (-1, out[k][1])
    return out


def digest(text: str) -> tuple[str, int] | None:
    """A hash of the text's words in lower case, and their number; None below MIN_WORDS.
    Letters of scripts without spaces are hashed one by one, wherever lines are broken."""
    words = _WORD.findall(text.lower())
    letters = sum(1 for w in words if _LETTER.match(w))
    n = len(words) - letters + (letters + 1) // 2
    if n < MIN_WORDS:
        return None
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), n


def head(digest: str) -> int:
    """The first 64 bits of a hash."""
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


def parts(text: str) -> list[str]:
    """The text, its paragraphs, its lines and the sentences of its paragraphs."""
    paragraphs = _BLANK.split(text)
    return list(dict.fromkeys([text, *paragraphs, *text.split("\n"), *(x for p in paragraphs for x in _SENTENCE.split(p))]))


def own_hashes(content: str) -> list[str]:
    return list(dict.fromkeys(d[0] for d in map(digest, parts(content)) if d))


def parse(text: str) -> tuple[str, int, int, list[tuple[int, str, int, int]], list[str]]:
    """(content, passages, deepest level, quotes, own). content is the text without quotes
    and without the lines that introduce them. quotes: passage, hash, level and words of
    each passage and of each of its parts. own: hashes of the content and of its parts,
    which are what others may quote."""
    content, n, deepest, quotes = unquoted(text)
    return content, n, deepest, quotes, own_hashes(content)


def unquoted(text: str) -> tuple[str, int, int, list[tuple[int, str, int, int]]]:
    """The same without own."""
    lines = levels(text)
    runs: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    kept = [line for level, line in lines if level == 0]
    content = text if len(kept) == len(lines) else re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")
    quotes, n = [], 0
    for level, block in runs:
        if level > 0 and any(x.strip() for x in block):
            for part in parts("\n".join(block)):
                if found := digest(part):
                    quotes.append((n, found[0], level, found[1]))
            n += 1
    return content, n, max((level for level, _ in lines), default=0), quotes


def parsed(messages: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        found = [unquoted(t or "") for t in batch.column(3).to_pylist()]
        quotes = [[{"passage": p, "hash": h, "head": head(h), "level": v, "words": w} for p, h, v, w in f[3]] for f in found]
        kind = pa.list_(pa.struct([("passage", pa.int32()), ("hash", pa.string()), ("head", pa.int64()), ("level", pa.int32()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], batch.column(4), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([max(f[2], 0) for f in found], pa.int32()), pa.array(quotes, kind)],
            ["conv_id", "turn", "role", "key", "content", "n_quotes", "max_level", "quotes"],
        )

    rows = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), "text", F.xxhash64("conv_id", "turn", "text").alias("key"))
    return arrow_map(rows, run, "conv_id bigint, turn bigint, role string, key bigint, content string, n_quotes int, max_level int, quotes array<struct<passage:int,hash:string,head:bigint,level:int,words:int>>")


def own_texts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, hash: what each message holds as its own, as far as a filter of fixed
    size over all quotes lets it pass."""
    bits = bit_filter(rows.select(F.explode("quotes").alias("q")).select("q.head"), "head")
    held = rows.sparkSession.sparkContext.broadcast(bits)
    any_quote = bool(bits.any())

    def run(batch: pa.RecordBatch):
        found = [own_hashes(t) for t in batch.column(2).to_pylist()] if any_quote else []
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64)
        hashes = [h for f in found for h in f]
        hit = passes(held.value, np.array([head(h) for h in hashes], np.int64))
        if hit.any():
            take = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([hashes[i] for i in np.flatnonzero(hit)], pa.string())], ["conv_id", "turn", "hash"])

    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return arrow_map(known.select("conv_id", "turn", "content"), run, "conv_id bigint, turn bigint, hash string")


def link(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, passage, level, words, from_conv, from_turn: for each passage of
    a message the message it comes from. That is the first one before it in the same
    conversation with that text, else the first one in an earlier conversation. A whole
    passage goes before its parts, longer parts before shorter ones; earlier conversations
    are those with a smaller conv_id. Texts that many messages share are reduced to their
    first message before the join."""
    inside = own_texts(rows).groupBy("conv_id", "hash").agg(F.min("turn").alias("first_turn"))
    asked = rows.select("key", "conv_id", "turn", F.explode("quotes").alias("q")).select("key", "conv_id", "turn", "q.*").drop("head").distinct()
    anywhere = inside.groupBy("hash").agg(F.min(F.struct("conv_id", "first_turn")).alias("first"))
    near = inside.withColumnsRenamed({"conv_id": "c", "hash": "h"})
    found = asked.join(near, (F.col("conv_id") == F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("first_turn") < F.col("turn")), "left").drop("h")
    found = found.join(anywhere, "hash", "left")
    other = F.col("first.conv_id") < F.col("conv_id")
    found = found.select(
        "key", "conv_id", "turn", "passage", "level", "words",
        F.coalesce("c", F.when(other, F.col("first.conv_id"))).alias("from_conv"),
        F.when(F.col("c").isNotNull(), F.col("first_turn")).when(other, F.col("first.first_turn")).alias("from_turn"),
    ).where("from_conv is not null")
    best = F.max(F.struct("words", "from_conv", "from_turn", "level")).alias("x")
    return found.groupBy("key", "conv_id", "turn", "passage").agg(best).select("key", "conv_id", "turn", "passage", "x.level", "x.words", "x.from_conv", "x.from_turn")


def ancestry(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn, depth of each message that replies to another:
    every round follows the parent's own pointer, so rounds grow with the logarithm of the
    deepest reply. Parents come before their replies, so there are no circles."""
    now = write_through(parents.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("bigint").alias("depth")), "reply-links")
    while True:
        up = now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        new = now.join(up, ["root_conv", "root_turn"], "left")
        new = write_through(new.select("conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved")), "reply-links")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def link_quotations(messages: DataFrame) -> DataFrame:
    """thread_id, position, conv_id, turn, role, content, parent_conv, parent_turn, depth,
    n_quotes, n_linked, max_level of every message.

    A message replies to the message that its quotes of the lowest level come from, most
    words first, then the later message. A thread is a conversation with what replies to
    it from others; in it, messages without a parent keep the order of turns, and below
    each come those that reply to it, by depth and then by conversation and turn.
    position counts from 0 in a thread. Null text has empty content. A message whose
    conv_id or turn is null replies and is replied to by none, and null is a thread of its
    own. Rows that repeat are kept, next to each other; other columns are ignored."""
    rows = write_through(parsed(messages), "messages")
    links = write_through(link(rows), "quotations")
    best = F.max(F.struct((-F.col("level")).alias("near"), "words", "from_conv", "from_turn")).alias("x")
    chosen = links.groupBy("key", "conv_id", "turn").agg(best, F.count("*").alias("n_linked"))
    parents = chosen.select("key", "conv_id", "turn", "n_linked", F.col("x.from_conv").alias("parent_conv"), F.col("x.from_turn").alias("parent_turn"))
    one = parents.groupBy("conv_id", "turn").agg(F.max(F.struct("parent_conv", "parent_turn")).alias("p")).select("conv_id", "turn", "p.*")
    roots = ancestry(one)
    mine = parents.select("key", "n_linked", "parent_conv", "parent_turn").dropDuplicates(["key"])
    out = rows.drop("quotes").join(mine, "key", "left").join(roots, ["conv_id", "turn"], "left")
    out = out.select(
        F.coalesce("root_conv", "conv_id").alias("thread_id"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        "conv_id", "turn", "role", "key", "content", "parent_conv", "parent_turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "max_level",
    )
    numbered = number_rows(out, ["root_turn", "depth", "conv_id", "turn", "key", "role"], "position", ["thread_id"], 0)
    return numbered.select("thread_id", "position", "conv_id", "turn", "role", "content", "parent_conv", "parent_turn", "depth", "n_quotes", "n_linked", "max_level")
