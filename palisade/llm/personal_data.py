"""Personal data in text: fixed patterns with checks, and a linear-chain conditional random
field over word shapes that adds spans the patterns cannot spell out.

The field is trained from a small labelled table and decoded by Viterbi over padded numpy
batches. It reads the stretches of text around digits, at signs and spelt-out dots; words
far from any of these are outside every span by definition of the model."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map

KINDS = ("email", "ip", "card", "phone")
#: spans that the field adds, named apart from the patterns' and listed after them
ADDED = {"mail": "crf_email", "phone": "crf_phone", "number": "crf_id"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: a number never starts inside a longer one, so leaving such starts out changes nothing
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> list[Span]:
    """From at sign to at sign, so that long runs without one are read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1) if start == at else free
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost first and apart within a kind, that pass their
    checks; by kind as in KINDS, then by start. Offsets count code points."""
    out = emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m.group()) <= 15]
    return out


#: the labelled table, made up: {kind|text} marks a span, everything else is outside
LABELLED = """
call me on {phone|(415) 555-2671} after six
phone {phone|415-555-0134} or write
tel {phone|020 7946 0958} in the morning
mobile {phone|07700 900123} is best
fax {phone|(212) 555-0199} is old
ring {phone|555-867-5309} now
his number is {phone|303.555.0142} and hers {phone|303.555.0175}
office {phone|(030) 901820-15} until noon
call {phone|1-800-555-0199} free of charge
cell {phone|(646) 555-0111} thanks
write to {mail|jane dot doe at example dot org} please
mail {mail|max (at) example (dot) com} today
contact {mail|info [at] example [dot] net} for more
reach {mail|kim7 at mail dot example dot com} soon
send it to {mail|a.lee (at) example.org} now
email {mail|press at example dot co dot uk} first
ssn {number|078-05-1120} on file
social security number {number|219-09-9999} given
passport {number|C01X00T47} was lost
iban {number|DE89 3704 0044 0532 0130 00} for the rent
iban {number|GB82 WEST 1234 5698 7654 32} is theirs
ssn {number|123-45-6780} is wrong
my ssn {number|457-55-5462} , keep it
the ssn was {number|321-54-9876} then
passport {number|K98765432} was renewed
passport {number|B12C34567} is valid
passport no {number|P4400123X} here
a passport {number|G7H812345} was found
iban {number|ES91 2100 0418 4502 0005 1332} for wages
iban {number|IT60 X054 2811 1010 0000 0123 456} is closed
iban {number|AT61 1904 3002 3457 3201} is mine
iban {number|BE68 5390 0754 7034} for gifts
pay to iban {number|CH93 0076 2011 6238 5295 7} soon
call {phone|0151 496 0821} at the shop
tel {phone|0117 496 0334} in the office
mobile {phone|07700 900877} , home {phone|(040) 667321-22}
phone {phone|1-877-555-0103} for help
dial {phone|512.555.0171} or {phone|1-866-555-0155}
the fax is {phone|702-555-0133} today
order 250-260 boxes at 9 each
in 1756-63 and 1803-15
and 4917484589897108 or 4024007103939508 there
the year 2024 was long and 1999 too
on 2024-01-02 at 12:30 they met
version 1.2.3 follows 1.2.2
Licensed under the License , Version 2.0.
it cost 1,250.00 or 99 in all
pages 10-20 and 155-160 of 300
they won 3-2 and then 21-19
room 204 , floor 12
figure 3.14 and 2.718
chapter 12 verse 7
the score was 100 to 98
at 09:15 on 31/12/2020
24 hours , 7 days , 365 nights
key 1eb9c654e721b4f8 and token = "24be64439e3e49cf"
line 1234567 of 7654321
order 100-200 units at 15 each
he was at home at 10 and at work at 11
a dot on the map at 52.5 by 13.4
ISBN 978-3-16-148410-0 in print
mail the form to me at noon
the phone rang 3 times
call it 42 or call it 7
in 1905-06 and 1914-18
add 10 %, 20 %, 30 %
the ip 10.0.0.1 and port 8080
see section 4.2.1 , table 5
and 7000123400056783 4811000077665541 again
THE!! 6011000990139420!! OF!!
on&&& 3530111333300007$$$ in%%%
of 5105105105105106 by 2223003122003221
from 1 to 10 at most
""".strip().splitlines()

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_MARK = re.compile(r"\{(\w+)\|([^}]*)\}")
_CUE = {"call", "phone", "tel", "mobile", "fax", "ring", "cell", "number", "office", "mail", "email", "contact", "write", "send", "reach", "ssn", "passport", "iban", "security", "at", "dot", "version", "license", "year", "on", "page", "pages", "line", "token", "key", "isbn", "score", "section", "chapter", "from", "to", "ip", "port"}
LABELS = ["O", *[f"{p}-{k}" for k in ADDED for p in "BI"]]


def parse_labelled(rows: list[str]) -> list[tuple[str, list[Span]]]:
    out = []
    for row in rows:
        text, spans, last = "", [], 0
        for m in _MARK.finditer(row):
            text += row[last : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, last = text + m[2], m.end()
        out.append((text + row[last:], spans))
    return out


def shape(token: str) -> str:
    if token.isdecimal():
        return f"9x{min(len(token), 5)}"
    if not token.isalnum():
        return token
    kinds = "".join("9" if c.isdecimal() else "A" if c.isupper() else "a" for c in token[:24])
    return re.sub(r"(.)\1+", r"\1+", kinds)


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), *m.span()) for m in _TOKEN.finditer(text)]


def token_features(found: list[tuple[str, int, int]]) -> list[list[str]]:
    """Features of each token: its shape, cue word and spacing, and those of two tokens to
    each side."""
    own = []
    for k, (word, start, _) in enumerate(found):
        low = word.lower()
        near = k > 0 and found[k - 1][2] == start
        own.append((shape(word), low if low in _CUE else "", near))
    out = []
    for k in range(len(own)):
        here = [f"s{own[k][0]}", f"j{own[k][2]}{own[k][0]}", "bias"]
        for d in (-2, -1, 1, 2):
            s, cue, near = own[k + d] if 0 <= k + d < len(own) else ("<>", "", False)
            here.append(f"{d}s{s}")
            if cue:
                here.append(f"{d}c{cue}")
            if abs(d) == 1:
                here.append(f"{d}b{s}|{own[k][0]}")
        if own[k][1]:
            here.append(f"c{own[k][1]}")
        out.append(here)
    return out


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels, the last row is the start

    def scores(self, sentences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(batch x longest x labels, lengths): the sums of the features' weights."""
        lengths = np.array([len(s) for s in sentences])
        out = np.zeros((len(sentences), lengths.max(initial=0), len(LABELS)))
        row, place, feature = [], [], []
        for i, s in enumerate(sentences):
            for t, names in enumerate(s):
                known = [self.index[n] for n in names if n in self.index]
                feature += known
                row += [i] * len(known)
                place += [t] * len(known)
        if feature:
            np.add.at(out, (np.array(row), np.array(place)), self.emit[np.array(feature)])
        return out, lengths

    def decode(self, sentences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best labels of each sentence, by Viterbi over the whole padded batch."""
        emit, lengths = self.scores(sentences)
        n, longest = emit.shape[:2]
        if not longest:
            return [np.zeros(0, int)] * n
        best = emit[:, 0] + self.move[-1]
        came = np.zeros((longest, n, len(LABELS)), np.int8)
        for t in range(1, longest):
            options = best[:, :, None] + self.move[None, :-1]
            came[t] = options.argmax(axis=1)
            step = options.max(axis=1) + emit[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        label = best.argmax(axis=1)
        path = np.zeros((n, longest), int)
        for t in range(longest - 1, -1, -1):
            live = t < lengths
            path[live, t] = label[live]
            label = np.where(live & (t > 0), came[t, np.arange(n), label], label)
        return [path[i, : lengths[i]] for i in range(n)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[str, list[Span]]], steps: int = 250, rate: float = 0.1, penalty: float = 0.01) -> Field:
    """The field with the highest penalised likelihood: gradients by forward and backward
    sums over the padded table, steps with momentum and adaptive sizes."""
    sentences, truth = [], []
    for text, spans in rows:
        found = tokens(text)
        labels = []
        for _, start, end in found:
            inside = next((s for s in spans if s[1] <= start and end <= s[2]), None)
            labels.append(LABELS.index(f"{'B' if inside[1] == start else 'I'}-{inside[0]}") if inside else 0)
        sentences.append(token_features(found))
        truth.append(labels)
    names = sorted({f for s in sentences for t in s for f in t})
    size = len(LABELS)
    field = Field({f: i for i, f in enumerate(names)}, np.zeros((len(names), size)), np.zeros((size + 1, size)))
    if not sentences:
        return field
    n, longest = len(sentences), max(map(len, sentences))
    at = [(i, t, field.index[f]) for i, s in enumerate(sentences) for t, fs in enumerate(s) for f in fs]
    row, place, feature = (np.array(x) for x in zip(*at, strict=True))
    lengths = np.array([len(s) for s in sentences])
    live = np.arange(longest)[None] < lengths[:, None]
    y = np.zeros((n, longest), int)
    for i, labels in enumerate(truth):
        y[i, : len(labels)] = labels
    gold = np.zeros((n, longest, size))
    gold[np.arange(n)[:, None], np.arange(longest)[None], y] = 1
    gold *= live[:, :, None]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.move)]
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, size))
        np.add.at(emit, (row, place), field.emit[feature])
        ahead = np.zeros((longest, n, size))
        back = np.zeros((longest, n, size))
        ahead[0] = emit[:, 0] + field.move[-1]
        for t in range(1, longest):
            new = _logsum(ahead[t - 1][:, :, None] + field.move[None, :-1], 1) + emit[:, t]
            ahead[t] = np.where(live[:, t, None], new, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(field.move[None, :-1] + (emit[:, t + 1] + back[t + 1])[:, None, :], 2)
            back[t] = np.where(live[:, t + 1, None], new, 0)
        total = _logsum(ahead[-1], 1)
        belief = np.exp(ahead.transpose(1, 0, 2) + back.transpose(1, 0, 2) - total[:, None, None]) * live[:, :, None]
        g_move = np.zeros_like(field.move)
        g_move[-1] = (gold[:, 0] - belief[:, 0]).sum(axis=0)
        for t in range(1, longest):
            pair = np.exp(ahead[t - 1][:, :, None] + field.move[None, :-1] + (emit[:, t] + back[t])[:, None, :] - total[:, None, None])
            both = live[:, t, None, None]
            g_move[:-1] += (gold[:, t - 1, :, None] * gold[:, t, None, :] * both - pair * both).sum(axis=0)
        g_emit = np.zeros_like(field.emit)
        np.add.at(g_emit, feature, (gold - belief)[row, place])
        for p, g, (m, v) in zip((field.emit, field.move), (g_emit, g_move), moments, strict=True):
            g -= penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


_TRIGGER = re.compile(r"[0-9]|[(\[]at[)\]]|\bdot\b", re.IGNORECASE)
#: characters to each side of a trigger that the field reads; words are not cut
AROUND = 40
#: tokens that one Viterbi batch holds, padding included
BATCH_TOKENS = 1 << 15


def stretches(text: str) -> list[tuple[int, int]]:
    """Where the field reads: AROUND characters to both sides of each trigger, stretched to
    white space; those that touch are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - AROUND // 2:
            continue
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        while high < len(text) and not text[high].isspace():
            high += 1
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
            continue
        while low > 0 and not text[low - 1].isspace() and (not out or low > out[-1][1]):
            low -= 1
        out.append([low, high])
    return [(a, b) for a, b in out]


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The spans that the field finds in each text. A spelt-out address needs a dot word or
    sign, a phone number 6 to 15
    digits, other numbers 6 to 34."""
    jobs = []
    for i, text in enumerate(texts):
        for low, high in stretches(text):
            found = [(w, a + low, b + low) for w, a, b in tokens(text[low:high])]
            if found:
                jobs.append((i, found))
    jobs.sort(key=lambda j: len(j[1]))
    out: list[list[Span]] = [[] for _ in texts]
    start = 0
    while start < len(jobs):
        end = start + 1
        while end < len(jobs) and (end + 1 - start) * len(jobs[end][1]) <= BATCH_TOKENS:
            end += 1
        batch = jobs[start:end]
        for (i, found), path in zip(batch, field.decode([token_features(f) for _, f in batch]), strict=True):
            open_: list | None = None
            for (_, a, b), label in [*zip(found, path, strict=True), (("", 0, 0), 0)]:
                name = LABELS[label]
                if open_ and name == f"I-{open_[0]}":
                    open_[2] = b
                    continue
                if open_:
                    part = texts[i][open_[1] : open_[2]]
                    digits = sum(c.isdecimal() for c in part)
                    if "dot" in part.lower() or "." in part if open_[0] == "mail" else 6 <= digits <= (15 if open_[0] == "phone" else 34):
                        out[i].append((ADDED[open_[0]], open_[1], open_[2]))
                open_ = [name[2:], a, b] if label else None
        start = end
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans added) of each text. What overlaps a base span is not added."""
    base = [base_spans(t) for t in texts]
    out = []
    for own, added in zip(base, field_spans(texts, field), strict=True):
        free = [s for s in added if all(s[2] <= b[1] or b[2] <= s[1] for b in own)]
        out.append((own, sorted(free, key=lambda s: (list(ADDED.values()).index(s[0]), s[1]))))
    return out


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, labelled: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are those of the patterns; spans lists these and then what
    the field added, under the names in ADDED. Null text counts as empty; repeated rows
    are searched each; an empty table gives no rows; other columns are ignored. labelled
    holds (text, spans) rows to train from instead of the table in this module."""
    field = train(parse_labelled(LABELLED) if labelled is None else labelled)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch):
        rows = find([t or "" for t in batch.column(1).to_pylist()], held.value)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _ in rows])
        spans = pa.array([write_spans(base + added) for base, added in rows])
        added = pa.array([len(a) for _, a in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return arrow_map(docs.select("doc_id", "text"), run, schema)
