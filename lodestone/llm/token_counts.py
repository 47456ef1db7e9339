"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern, and each pre-token
has a token count. Pre-tokens stand in blocks, and a segment tree over the
blocks holds sums of characters and tokens, so a place is found and a changed
sum is carried to the root in logarithmic time.

An edit re-cuts from the last pre-token that the edit cannot have changed
(the pattern looks at most two characters past a match) until a cut falls on an
old one behind the edit; from there the old pre-tokens hold. Only what lies
between is encoded again.

Defined results: null and empty texts have no tokens (a null text's edits are
made on an empty one). Edits are clipped to the text, made in order, each on
the text that the one before left; null edits or parts of them count as none or
empty. Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, LOOK_PAST, CACHE = 64, 2, 600_000


class Tokenizer:
    """Token counts of pre-tokens by a rank file, remembered up to a bound."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [p for p in set(parts) if p not in known]
        for p in new:
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]


class Segments:
    """The pre-tokens of one text with their counts."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.text, self.tokenizer = text, tokenizer
        parts = tokenizer.cut.findall(text)
        self.recut = 0
        self._build([len(p) for p in parts], tokenizer.counts(parts))

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (sizes, counts) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(sizes), sum(counts)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pretokens(self) -> int:
        return sum(len(s) for s, _ in self.blocks)

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds a character place (the last one for the end), and where the block begins."""
        i, base = 1, 0
        while i < self.width:
            i *= 2
            if place >= base + self.chars[i] and self.chars[i + 1]:
                base += self.chars[i]
                i += 1
        return i - self.width, base

    def _set(self, block: int) -> None:
        sizes, counts = self.blocks[block]
        i = self.width + block
        self.chars[i], self.tokens[i] = sum(sizes), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put new in place of text[start:stop]."""
        old = len(self.text)
        start = min(max(start, 0), old)
        stop = min(max(stop, start), old)
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        # The first pre-token that may have changed ends after start - LOOK_PAST.
        first, base = self._block_at(max(start - LOOK_PAST, 0))
        sizes, k, at = self.blocks[first][0], 0, base
        while k < len(sizes) and at + sizes[k] <= start - LOOK_PAST:
            at += sizes[k]
            k += 1
        # Old cuts from there on, block by block, against the cuts of the new text.
        last, j, old_at = first, k, at
        parts, new_at, edit_end = [], at, start + len(new)
        matches = self.tokenizer.cut.finditer(self.text, at)
        while not (new_at >= edit_end and old_at >= stop and new_at == old_at + shift):
            if new_at < max(edit_end, old_at + shift) or (new_at == old_at + shift and new_at < len(self.text)):
                m = next(matches, None)
                if m is None:
                    break
                parts.append(m.group())
                new_at = m.end()
            else:
                while j >= len(self.blocks[last][0]) and last + 1 < len(self.blocks):
                    last, j = last + 1, 0
                if j >= len(self.blocks[last][0]):
                    break
                old_at += self.blocks[last][0][j]
                j += 1
        if new_at >= len(self.text):  # the cuts ran to the end: nothing old is left behind them
            last, j = len(self.blocks) - 1, len(self.blocks[-1][0])
        counts = self.tokenizer.counts(parts)
        self.recut += len(parts)
        own = self.blocks[first]
        tail = self.blocks[last]
        sizes = own[0][:k] + [len(p) for p in parts] + tail[0][j:]
        counts = own[1][:k] + counts + tail[1][j:]
        if first == last and 0 < len(sizes) <= 2 * BLOCK:
            self.blocks[first] = (sizes, counts)
            self._set(first)
        else:
            put = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)]
            self.blocks[first : last + 1] = put
            self.blocks = self.blocks or [([], [])]
            self._grow()


def _tokenizer(ranks: bytes, pattern: str, held: dict = {}) -> Tokenizer:  # noqa: B006 - one tokenizer per worker
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in held:
        held.clear()
        held[key] = Tokenizer(ranks, pattern)
    return held[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


COUNTS = "n_pretokens long, n_tokens long, edited_chars long, edited_pretokens long, edited_tokens long, recut long"


def count_documents(docs: DataFrame, ranks: bytes, edits: Column | None = None, pattern: str = PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with counts before and after the edits.

    ``edits`` is an array of structs (start, stop, text); ``recut`` is the
    number of pre-tokens that the edits had encoded again.
    """
    none = F.array().cast("array<struct<start:long,stop:long,text:string>>")
    given = docs.select(
        *(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        F.coalesce(edits if edits is not None else none, none).cast("array<struct<start:long,stop:long,text:string>>").alias("_edits"),
    )
    schema = given.select(*(F.col(f"`{c}`") for c in keep)).schema
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for name in names:
        schema = schema.add(name, "long")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file

    def run(batches):
        tokenizer = _tokenizer(shared.value, pattern)
        for b in batches:
            out = []
            for value, changes in zip(b.column("_text"), b.column("_edits"), strict=True):
                tree = Segments(value.as_py(), tokenizer)
                row = [tree.pretokens, tree.total]
                for e in changes.as_py():
                    if e is not None:
                        tree.replace(e["start"] or 0, e["stop"] if e["stop"] is not None else e["start"] or 0, e["text"] or "")
                out.append((*row, len(tree.text), tree.pretokens, tree.total, tree.recut))
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *names])

    return given.mapInArrow(run, schema)
