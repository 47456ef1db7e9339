"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

White space is marked as the model says and a text is cut into marked words:
at each mark, and between two characters that stand side by side in no piece,
since no segmentation reaches across there. The distinct words of a batch are
sorted, which lays them out as a trie in depth-first order: a word keeps the
forward states of the prefix that it shares with the word before and only the
rest is computed. The ids of a text are those of its words, one after another.

The forward state of a prefix is the node of the automaton of pieces that it
leads to (which names the pieces that can end there), and, by the model's kind:

* unigram: the best score of a segmentation of the prefix and its last piece
  (Viterbi);
* BPE: the last piece of the one segmentation that merging gives the prefix.
  A piece can end there only if merging leaves it and the prefix's last piece
  before it apart, so the search over pieces is the same with scores of
  "possible" and "impossible"; whether a pair stays apart is learned once.

Unknown characters become bytes if the model has byte pieces, else a run of
them becomes one <unk>.

What a worker keeps between batches is bounded: words by bytes, pairs and
automaton steps by number. A word of any length is encoded; a long one is not
kept.

Defined results: a null text gives null ids; an empty text gives no ids; an
empty table gives an empty result and repeated rows a row each. Models whose
normalization is not the identity, those with user-defined pieces, and those in
which a piece could reach across a mark, are refused. A mark character in a
text is decoded as a space.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded_batches, pieces_of

MARK = "▁"
#: Pairs, and steps of the automaton, that a worker keeps.
CACHE = 400_000
#: Bytes of words and ids that a worker keeps, with what an entry takes besides them; longer words are not kept.
WORD_BYTES, ENTRY, LONGEST = 64_000_000, 230, 64


class _Node:
    """A state of the automaton of pieces: its string, the pieces that end there, longest first, and the states after it."""

    __slots__ = ("after", "ends", "name")

    def __init__(self, name: str, ends: tuple):
        self.name, self.ends, self.after = name, ends, {}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after another."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


class Codec:
    """Encoder and decoder for a serialized model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalization with marks before words")
        self.bpe = proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("only unigram and BPE models")
        self.prefix = spec.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        kind = [p.type for p in proto.pieces]
        if 4 in kind:
            raise ValueError("user-defined pieces")
        self.pieces = {p: i for i, p in enumerate(self.text) if kind[i] == 1}
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(kind) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, k in enumerate(kind) if k == 3}
        self.unknown = kind.index(2)
        self.unknown_score = min((self.score[i] for i in self.pieces.values()), default=0.0) - 10.0  # fixed by the library
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark after other characters")
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        self.root, self.steps = _Node("", ()), 0
        # By last piece: which pieces before it stay apart from it.
        self.apart: dict[str, dict[str, bool]] = {p: {} for p in self.pieces}
        self.pairs = 0
        # Words used since the last change of generations, and those of the generation before.
        self.words: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.held = 0
        # Classes of characters in pieces of several, and which of them follow each other in one; both are as large as the model makes them.
        several = [p for p in self.pieces if len(p) > 1]
        letters = sorted({c for p in several for c in p})
        self.kind_of = np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.uint32)
        self.kind_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.follows = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = {(a, b) for p in several for a, b in zip(p, p[1:], strict=False)}
        for a, b in pairs:
            self.follows[self.kind_of[ord(a)], self.kind_of[ord(b)]] = True
        # What each id decodes to; None for control pieces.
        self.raw = [None if k == 3 else " ⁇ ".encode() if k == 2 else bytes([self.byte_of[i]]) if k == 6 else self.text[i].encode() for i, k in enumerate(kind)]
        spaced = [(r or b"").replace(MARK.encode(), b" ") for r in self.raw]
        self.out_size = np.array([len(r) for r in spaced], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(spaced), np.uint8)

    # -- merging, used for pairs, runs of marks and as the plain definition --

    def merged(self, text: str) -> list[str]:
        """Merge neighbours in the order of scores, leftmost first among equals."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        pieces, score = self.pieces, self.score
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (t := pieces.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score[t], i, part[i] + part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != whole:
                continue
            part[i], part[j], after[i] = whole, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def stays_apart(self, a: str, b: str) -> bool:
        if self.pairs >= CACHE:
            self.pairs = 0
            for seen in self.apart.values():
                seen.clear()
        self.pairs += 1
        got = self.apart[b][a] = self.merged(a + b) == ([a, b] if a else [b])  # without a, b starts the word
        return got

    # -- the shared-prefix pass --

    def step(self, node: _Node, c: str) -> _Node:
        """The state after one more character: the longest end of the string that starts a piece."""
        if self.steps >= CACHE:
            self.root, self.steps = _Node("", ()), 0
        self.steps += 1
        name = node.name + c
        if name in self.prefixes:
            ends = tuple((len(name) - i, name[i:], self.apart[name[i:]]) for i in range(len(name)) if name[i:] in self.pieces)
            got = _Node(name, ends)
        else:
            while name and name not in self.prefixes:
                name = name[1:]
            got = self.root
            for x in name:
                got = got.after.get(x) or self.step(got, x)
        node.after[c] = got
        return got

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (4 bytes each) of distinct marked words."""
        out, last = {}, ""
        # Index of a state: the number of characters of the prefix.
        node: list[_Node] = [self.root]
        piece: list[str] = [""]
        best: list[float] = [0.0]
        total = array("f", [0.0])  # sums are rounded as the library rounds them, so that ties are its ties
        pieces, score, bpe = self.pieces, self.score, self.bpe
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            if word.startswith(last):
                shared = most
            else:
                while shared < most and last[shared] == word[shared]:
                    shared += 1
            del node[shared + 1 :], piece[shared + 1 :], best[shared + 1 :]
            state, end = node[shared], shared
            for c in word[shared:]:
                state = state.after.get(c) or self.step(state, c)
                node.append(state)
                end += 1
                if bpe:
                    for size, p, seen in state.ends:
                        before = piece[end - size]
                        ok = seen.get(before)
                        if ok if ok is not None else self.stays_apart(before, p):
                            piece.append(p)
                            break
                    else:
                        piece.append(c)
                else:
                    top, found = -np.inf, c
                    for size, p, _ in state.ends:
                        total[0] = best[end - size] + score[pieces[p]]
                        if total[0] > top:
                            top, found = total[0], p
                    if c not in pieces:
                        total[0] = best[end - 1] + self.unknown_score
                        if total[0] > top:
                            top, found = total[0], c
                    piece.append(found)
                    best.append(top)
            last = word
            ids: list[int] = []
            while end:
                p = piece[end]
                t = pieces.get(p)
                if t is not None:
                    ids.append(t)
                else:
                    ids += self.ids_of(p)[::-1]
                end -= len(p)
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def ids_of(self, p: str) -> list[int]:
        t = self.pieces.get(p)
        if t is not None:
            return [t]
        return [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode_run(self, word: str) -> bytes:
        """A word after several marks, by plain merging: runs of marks have pieces of equal scores, whose order counts.

        Marks beyond the first merge among themselves only after all else, so the
        word's own pieces come from the word with one mark.
        """
        bare = word.lstrip(MARK)
        marks = len(word) - len(bare)
        ids = np.frombuffer(self.encode_words([MARK + bare])[MARK + bare], np.int32)
        alone = not bare or (len(ids) > 0 and ids[0] == self.pieces.get(MARK))
        run = marks if alone else marks - 1
        head = [i for p in self.merged(MARK * run) for i in self.ids_of(p)]
        return np.array([*head, *(ids[1:] if alone else ids)], np.int32).tobytes()

    def marked(self, texts: pa.Array) -> pa.Array:
        """Texts with marks for spaces and, if the model has one, the mark before a text that is not empty; none for nulls."""
        given = pc.fill_null(texts.cast(pa.large_string()), "")
        out = pc.replace_substring(given, " ", MARK)
        if not self.prefix:
            return out
        return pc.if_else(pc.equal(pc.binary_length(out), 0), out, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), out, pa.scalar("", pa.large_string())))

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts in order, and where each text's words start among them (with the end of the last)."""
        m = self.marked(texts)
        at = np.frombuffer(m.buffers()[1], np.int64)[m.offset : m.offset + len(m) + 1]
        raw = m.buffers()[2][int(at[0]) : int(at[-1])] if at[-1] > at[0] else pa.py_buffer(b"")
        at = at - at[0]
        codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        kind = self.kind_of[codes]
        start = np.ones(len(codes), bool)
        start[1:] = ~self.follows[kind[:-1], kind[1:]]
        start[np.searchsorted(first, at[:-1][np.diff(at) > 0])] = True
        first = first[start]
        ends = np.append(first, at[-1]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), raw)
        return words.dictionary_encode(), np.searchsorted(first, at)

    def known_ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of the words that are kept; used words pass to the present generation."""
        out, again = list(map(self.words.get, words)), {}
        if self.aged:
            for n, i in enumerate(out):
                if i is None and (i := self.aged.get(words[n])) is not None:
                    out[n] = again[words[n]] = i
            self.keep(again)
        return out

    def keep(self, got: dict[str, bytes]) -> None:
        """Keep words for later batches; of two generations of half the bound each, the older goes as a whole."""
        for w, i in got.items():
            if len(w) <= LONGEST:
                if self.held >= WORD_BYTES // 2:
                    self.aged, self.words, self.held = self.words, {}, 0
                self.words[w] = i
                self.held += ENTRY + len(w) + len(i)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's start (with the end of the last)."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words, bounds = self.cut(texts)
        distinct = words.dictionary.to_pylist()
        ids = self.known_ids(distinct)
        new = [w for w, i in zip(distinct, ids, strict=True) if i is None]
        runs = [w for w in new if self.bpe and w.startswith(MARK * 2)]
        got = self.encode_words([w for w in new if not w.startswith(MARK * 2)] if runs else new)
        got.update((w, self.encode_run(w)) for w in runs)
        ids = [got[w] if i is None else i for w, i in zip(distinct, ids, strict=True)]
        self.keep(got)
        size = np.array([len(i) // 4 for i in ids], np.int64)
        place = np.cumsum(size) - size
        which = words.indices.to_numpy()
        flat = np.frombuffer(b"".join(ids), np.int32)[spread(place[which], size[which])]
        bounds = np.concatenate([[0], np.cumsum(size[which])])[bounds]
        if not self.bytes:
            # One <unk> for a run of unknown characters.
            repeated = np.zeros(len(flat), bool)
            repeated[1:] = (flat[1:] == self.unknown) & (flat[:-1] == self.unknown)
            repeated[bounds[:-1][bounds[:-1] < len(flat)]] = False
            bounds = bounds - np.concatenate([[0], np.cumsum(repeated)])[bounds]
            flat = flat[~repeated]
        return flat, bounds

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        flat, bounds = self.encode_flat(pa.array(texts, pa.string()))
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; control pieces are silent, runs of byte pieces are UTF-8 with replacement of broken ones."""
        # Pieces are whole characters, so a broken run of bytes ends where a piece starts. Only control pieces could join two runs.
        raw = self.raw
        if self.control and not self.control.isdisjoint(ids):
            text = "".join(b"".join(map(raw.__getitem__, g)).decode("utf-8", "replace") for silent, g in groupby(ids, self.control.__contains__) if not silent)
        else:
            text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def round_trips(self, texts: pa.Array, flat: np.ndarray, bounds: np.ndarray) -> list[bool | None]:
        """Whether decoding all ids of each text gives the unchanged text again; None for nulls.

        The ids of all texts are decoded to bytes at once. What does not come
        back, and a text that holds a mark, is decoded again by itself.
        """
        given = pc.fill_null(texts.cast(pa.large_string()), "")
        size = self.out_size[flat]
        decoded = self.out[spread(self.out_start[flat], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[bounds]
        marks = pc.match_substring(given, MARK).to_numpy(zero_copy_only=False)
        out: list[bool | None] = []
        for i, (t, a, b) in enumerate(zip(given, upto[:-1], upto[1:], strict=True)):
            raw = t.as_buffer()
            lead = 1 if self.prefix and b > a else 0  # the mark that encoding put first
            same = not marks[i] and b - a - lead == raw.size and decoded[a + lead : b].tobytes() == raw.to_pybytes()
            out.append(None if not texts[i].is_valid else same or self.decode(flat[bounds[i] : bounds[i + 1]].tolist()) == t.as_py())
        return out


def _codec(model: bytes, held: dict = {}) -> Codec:  # noqa: B006 - one codec per worker
    key = hashlib.sha256(model).digest()
    if key not in held:
        held.clear()
        held[key] = Codec(model)
    return held[key]


def read_model(path: str) -> bytes:
    """The model file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The ``keep`` columns, ``n_tokens`` and ``ids``; with ``digest``, instead of ids their sha256
    (4 bytes each, little-endian) and whether decoding all of them gives the unchanged text again."""
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    extra = [("ids_sha256", "string"), ("round_trip", "boolean")] if digest else [("ids", T.ArrayType(T.IntegerType()))]
    schema = given.drop("_text").schema.add("n_tokens", "long")
    for name, kind in extra:
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file

    def run(batches):
        codec = _codec(shared.value)
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("_text")), 0).to_pylist()
            for lo, hi in pieces_of(lengths, 4_000_000):
                rows = b.slice(lo, hi - lo)
                texts = rows.column("_text")
                null = pc.is_null(texts)
                flat, bounds = codec.encode_flat(texts)
                n = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(np.diff(bounds)))
                if digest:
                    ids = flat.astype("<i4").tobytes()
                    sha = [None if x else hashlib.sha256(ids[4 * s : 4 * e]).hexdigest() for x, s, e in zip(null.to_pylist(), bounds[:-1], bounds[1:], strict=True)]
                    cols = [n, pa.array(sha, pa.string()), pa.array(codec.round_trips(texts, flat, bounds), pa.bool_())]
                else:
                    cols = [n, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()), mask=null)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *cols], names=[*keep, "n_tokens", *(x for x, _ in extra)])

    bounded_batches(docs.sparkSession)
    return given.mapInArrow(run, schema)


def decode_documents(df: DataFrame, model: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the decoded ``text``."""
    given = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").cast("array<int>").alias("_ids"))
    schema = given.drop("_ids").schema.add("text", "string")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = _codec(shared.value)
        for b in batches:
            out = [codec.decode(x) if x is not None else None for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "text"])

    return given.mapInArrow(run, schema)
