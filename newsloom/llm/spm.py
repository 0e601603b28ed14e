"""SentencePiece (BPE) encoding and decoding by a max-plus scan over boundary states.

Method.  A sequence of pieces is the model's BPE encoding of its text exactly if every piece encodes to itself and
every two neighbours encode, joined, to those two.  So encoding is a best path through the lattice of pieces, with
weight 0 for neighbours that fit and minus infinity for those that do not; exactly one path is finite.  A boundary
state is (where the last piece that began before the boundary ends, that piece).  A giant text is cut into chunks;
each chunk yields the transfer matrix from its left to its right boundary states; neighbouring matrices are multiplied
pairwise in max-plus algebra, in rounds; the finite path fixes the boundaries' states down the same tree, and each chunk is
backtraced on its own.  A change from a non-space to a space resets the state, as no piece reaches across it, so inside a chunk the
words between two resets are encoded once each and remembered.

Runs of spaces: their pieces share one score, which breaks the two-neighbour rule; a run is encoded by its length (the
longest run piece repeatedly, then the merges of the rest), and chunk boundaries never fall into a run.

Scale.  Texts up to CHUNK_CHARS are encoded where they are read.  Longer ones are stored and cut; matrices meet two at a
time, and chunk texts are not shuffled together.  Memory per task is a chunk and bounded memories
of words and neighbours.

Edge cases.  Null or empty text has no ids (an empty array).  Characters without a piece become byte pieces.  Decoding
gives back the text, with U+2581 read as a space, as the library does.  Repeated rows are each returned; all columns
of the input are kept, except that columns named like the new ones are replaced.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from array import array
from contextlib import contextmanager
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

CHUNK_CHARS = 1 << 16
_FITS = 100_000            # remembered pairs of neighbours
_MEMORY = 250_000          # words in each of two generations
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """The piece table of a BPE model with byte fallback, and encoding by neighbour checks."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece reaches across the start of a word")
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        known = set(plain)
        back = {i: b for b, i in self.byte.items()}
        self.raw = [sp.id_to_piece(i).replace(SPACE, " ").encode("utf-8") if i in known else
                    bytes([back[i]]) if i in back else b"" for i in range(n)]
        # pieces of the lattice: those that encode to themselves; runs of spaces are handled by length
        self.pieces, self.split = set(), {}
        for p in self.id:
            if p == SPACE or not p.startswith(SPACE * 2):
                parts, last = self._merged(p)
                if parts == [p]:
                    self.pieces.add(p)
                    self.split[p] = last
        order = sorted((p for p in self.id if len(p) > 1 and p.strip(SPACE)), key=lambda p: -self.score[p])
        self.rank = {p: r for r, p in enumerate(order)}
        self.longest = max(map(len, self.pieces))
        self.run_longest = max((len(p) for p in self.id if not p.strip(SPACE)), default=1)
        self.fits = lru_cache(_FITS)(self._fits)
        self.code = "H" if n <= 1 << 16 else "I"
        self.memory: dict[str, bytes] = {}               # by segment; words after one space are in ``words``
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.newline_alone = not any("\n" in p for p in self.pieces if len(p) > 1)
        self.newline = self.pack(self.ids(["\n"]))
        if any(c not in self.pieces for p in self.pieces for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Best pair first, the leftmost of equals, until no pair is a piece (the definition, for short strings); and
        the last pair that was merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: str, b: str) -> bool:
        """Whether a and b, each encoding to itself, stay apart when joined: undo their merges, latest first; a piece
        across the border that would have been merged before the merge just undone would have won."""
        rank, split = self.rank, self.split
        limit = len(rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8")]
        return out

    def run(self, n: int) -> list[str]:
        """Pieces of a run of ``n`` spaces."""
        full, rest = divmod(n, self.run_longest)
        return [SPACE * self.run_longest] * full + self._merged(SPACE * rest)[0]

    def walk(self, text: str, start: int, piece: str | None, end: int, follower: str | None = None) -> list[str] | None:
        """The pieces from ``start`` (after ``piece``, or None after a reset) to ``end``, the last of which fits
        ``follower`` if one is given; None if there are none."""
        reach: dict[int, dict[str, str | None]] = {start: {piece or "": None}}
        pieces, fits, longest = self.pieces, self.fits, self.longest
        for i in range(start + 1, end + 1):
            here: dict[str, str | None] = {}
            for j in range(max(start, i - longest), i):
                before = reach.get(j)
                if before:
                    t = text[j:i]
                    if i - j == 1 or t in pieces:
                        for p in before:
                            if not p or fits(p, t):
                                here[t] = p
                                break
            if here:
                reach[i] = here
        for t in reach.get(end, ()):
            if not follower or not t or fits(t, follower):
                out, i = [], end
                while i > start:
                    out.append(t)
                    t, i = reach[i][t], i - len(t)
                return out[::-1]
        return None

    def word(self, core: str) -> list[str]:
        """Pieces of a text that begins after a reset: the one state each position has, left to right.  The automaton
        names the pieces that end at each position, longest first."""
        if core in self.pieces:
            return [core]
        last: list[str | None] = [""] + [None] * len(core)
        fits = self.fits
        for end, t in self.automaton.iter(core):
            if last[end + 1] is None:
                j = end + 1 - len(t)
                before = last[j]
                if before is None:                   # a character that no piece holds
                    before = last[j] = core[j - 1]
                if not j or fits(before, t):
                    last[end + 1] = t
        out, i = [], len(core)
        while i:
            t = last[i] or core[i - 1]
            out.append(t)
            i -= len(t)
        return out[::-1]

    def pack(self, ids: list[int]) -> bytes:
        """Ids as the bytes of an array: smaller than a tuple, joined without a loop, and nothing for the garbage collector
        to visit."""
        return array(self.code, ids).tobytes()

    def plain(self, core: str) -> bytes:
        """Ids of a text that begins after a reset and holds no further space."""
        parts = self.word(core)
        try:
            return array(self.code, [self.id[p] for p in parts]).tobytes()
        except KeyError:                             # a character without a piece
            return self.pack(self.ids(parts))

    def spaced(self, word: str) -> bytes:
        """Ids of one space and ``word``; a newline that is in no longer piece is a reset too, so the words beside it are
        remembered by themselves."""
        got = self.older.get(word)
        if got is None:
            if not word:
                got = self.segment(SPACE)
            elif self.newline_alone and "\n" in word:
                head, *rest = word.split("\n")
                parts = [self.plain(SPACE + head)]
                for w in rest:
                    known = self.words.get("\n" + w)
                    if known is None:
                        known = self.remember("\n" + w, self.newline + (self.plain(w) if w else b""))
                    parts.append(known)
                got = b"".join(parts)
            else:
                got = self.plain(SPACE + word)
        return self.remember(word, got)

    def remember(self, key: str, got: bytes) -> bytes:
        """Two generations, so that filling up drops only what was not used since.  A key that begins with a newline is
        what follows a word; such a word after a space is not kept."""
        if len(self.words) >= _MEMORY:
            self.older, self.words = self.words, {}
        self.words[key] = got
        return got

    def segment(self, text: str) -> bytes:
        """Ids of a run of spaces with the word after it."""
        got = self.memory.get(text)
        if got is None:
            if len(self.memory) > _MEMORY // 4:
                self.memory.clear()
            word = text.lstrip(SPACE)
            lead = len(text) - len(word)
            parts = self.word(SPACE + word if lead else word) if word else []
            if parts and lead:
                alone = parts[0] == SPACE
                parts = self.run(lead - 1 + alone) + parts[alone:]
            got = self.pack(self.ids(parts or self.run(lead)))
            if lead != 1 and len(text) <= 64:
                self.memory[text] = got
        return got

    def encoded(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        if "  " not in text and SPACE not in text and text[0] not in " \n" and text[-1] != " " and " \n" not in text:
            known, spaced = self.words, self.spaced
            out = []
            for w in text.split(" "):                # every segment is one space and a word
                got = known.get(w)
                if got is None:
                    got = spaced(w)
                    known = self.words
                out.append(got)
            return b"".join(out)
        out = []
        for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            if s[0] == SPACE and s[1:2] not in (SPACE, "\n", ""):
                got = self.words.get(s[1:])
                out.append(self.spaced(s[1:]) if got is None else got)
            else:
                out.append(self.segment(s))
        return b"".join(out)

    def unpacked(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.code)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.unpacked(self.encoded(text)).tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[raw.startswith(b" "):].decode("utf-8", "replace")

    # ---- chunks of giant texts ----

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """Boundary states at ``at``: (end - at, piece) of every piece that begins before it and ends at or after it."""
        out = []
        for end in range(at, min(len(text), at + self.longest - 1) + 1):
            for start in range(max(0, end - self.longest), at):
                t = text[start:end]
                if (end - start == 1 or t in self.pieces) and SPACE not in t[1:]:
                    out.append((end - at, t))
        return out

    def transfer(self, text: str, lo: int, hi: int, last: bool) -> list[tuple[int, str, int, str]]:
        """Finite entries (left end, left piece, right end, right piece) of the chunk text[lo:hi] with its context.
        A first chunk (lo == 0) has the one left state (0, ""), a last one the one right state (0, "")."""
        left = self.states(text, lo) if lo else [(0, "")]
        reset = text.find(SPACE, lo + (lo == 0), hi)
        if reset >= 0 and lo:
            ok = [s for s in left if lo + s[0] == reset or self.walk(text, lo + s[0], s[1], reset) is not None]
        else:
            ok = left
        if reset >= 0 or not lo:
            core = self._core(text, lo, hi)
            right = [(0, "")] if last else [s for s in self.states(text, hi) if self._ends(text, core, hi, s)]
            return [(*a, *b) for a in ok for b in right]
        return self._matrix(text, lo, hi, last, left)

    @staticmethod
    def _core(text, lo, hi):
        """Where the last word before ``hi`` begins (its last leading space)."""
        at = text.rfind(SPACE, lo, hi)
        return at if at >= 0 else lo

    def _ends(self, text, core, hi, state) -> bool:
        """Whether the word that begins at ``core`` can end in the right boundary state."""
        start = hi + state[0] - len(state[1])
        return start >= core and self.walk(text, core, None, start, state[1]) is not None

    def _matrix(self, text, lo, hi, last, left):
        """No reset inside: one pass that carries, for every (position, piece), the set of left states that reach it."""
        reach: dict[int, dict[str, int]] = {}
        for n, (end, piece) in enumerate(left):
            box = reach.setdefault(lo + end, {})
            box[piece] = box.get(piece, 0) | 1 << n
        out = []
        stop = hi if last else min(len(text), hi + self.longest - 1)
        for i in range(lo, stop + 1):
            here = reach.get(i, {})
            for j in range(max(lo, i - self.longest), min(i, hi)):
                before = reach.get(j)
                if before:
                    t = text[j:i]
                    if (i - j == 1 or t in self.pieces) and SPACE not in t[1:]:
                        mask = 0
                        for p, m in before.items():
                            if self.fits(p, t):
                                mask |= m
                        if mask:
                            here[t] = here.get(t, 0) | mask
            if here:
                reach[i] = here
            reach.pop(i - self.longest - 1, None)
            if i >= hi:
                for t, mask in here.items():
                    if i - len(t) < hi:
                        right = (0, "") if last else (i - hi, t)
                        out += [(*left[n], *right) for n in range(len(left)) if mask >> n & 1]
        return out

    def backtrace(self, text: str, lo: int, hi: int, last: bool, left: tuple[int, str], right: tuple[int, str]) -> list[int]:
        """Ids of the pieces that begin in the chunk, given both boundary states."""
        start = lo + left[0]
        stop = len(text) if last else hi + right[0] - len(right[1])        # where the crossing piece begins
        reset = text.find(SPACE, start + (lo == 0), hi)
        tail = [] if last else [right[1]]
        if reset < 0 and lo:
            if not last and stop < start:
                return []                                                    # one piece covers the whole chunk
            return self.ids((self.walk(text, start, left[1], stop, right[1] or None) if stop > start else []) + tail)
        out: list[int] = []
        if lo and reset > start:
            out += self.ids(self.walk(text, start, left[1], reset) or [])
        begin = reset if lo else 0
        if last:
            for s in _SEGMENT.findall(text[begin:]):
                out += self.unpacked(self.segment(s)).tolist()
            return out
        core = self._core(text, begin, hi)
        first = core                                                         # start of the last run of spaces
        while first > begin and text[first - 1] == SPACE:
            first -= 1
        for s in _SEGMENT.findall(text[begin:first]):
            out += self.unpacked(self.segment(s)).tolist()
        parts = (self.walk(text, core, None, stop, right[1]) if stop > core else []) + tail
        alone = parts[0] == SPACE
        return out + self.ids(self.run(core - first + alone) + parts[alone:])


@lru_cache(2)
def _loaded(model_path: str) -> PieceModel:
    return PieceModel(model_path)


@contextmanager
def piece_model(model_path: str):
    """The model for one task: the table stays in the worker, what was remembered goes when the task ends."""
    model = _loaded(model_path)
    try:
        yield model
    finally:
        model.words.clear()
        model.older.clear()
        model.memory.clear()
        model.fits.cache_clear()


def cut(text: str, size: int, longest: int) -> list[tuple[str, int, int]]:
    """(context text, from, to) for each chunk of the normalised text; boundaries never fall on a space."""
    s = SPACE + text.replace(" ", SPACE)
    at = [0]
    while at[-1] < len(s):
        p = at[-1] + size
        while p < len(s) and s[p] == SPACE:
            p += 1
        at.append(min(p, len(s)))
    out = []
    for lo, hi in zip(at, at[1:]):
        a = max(0, lo - longest)
        out.append((s[a:hi + longest], lo - a, hi - a))
    return out


Entry = tuple[int, str, int, str]      # left state (end, piece) and right state of a finite entry


def product(left: list[Entry], right: list[Entry]) -> list[Entry]:
    """Max-plus product of two transfer matrices whose finite entries weigh 0."""
    by_state: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for a, b, c, d in right:
        by_state.setdefault((a, b), []).append((c, d))
    return list(dict.fromkeys((*x[:2], *end) for x in left for end in by_state.get(x[2:], ())))


def middle(left: list[Entry], right: list[Entry], start: tuple[int, str], end: tuple[int, str]) -> tuple[int, str]:
    """The one state between two neighbours on the finite path from ``start`` to ``end``."""
    reached = {x[2:] for x in left if x[:2] == start}
    return next(x[:2] for x in right if x[2:] == end and x[:2] in reached)


_MATRIX = "uid long, n int, a array<int>, b array<string>, c array<int>, d array<string>"
_STATES = "uid long, n int, le int, lp string, re int, rp string"


def _entries(row) -> list[Entry]:
    return [(int(a), b, int(c), d) for a, b, c, d in zip(row["a"], row["b"], row["c"], row["d"])]


def _pair_product(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows n = 2 k and 2 k + 1 (or the last one alone) of one text become row k."""
    rows = rows.sort_values("n")
    both = [_entries(r) for _, r in rows.iterrows()]
    out = product(*both) if len(both) == 2 else both[0]
    first = rows.iloc[0]
    return pd.DataFrame({"uid": [first["uid"]], "n": np.array([first["n"] // 2], np.int32), **{k: [[x[i] for x in out]] for i, k in enumerate("abcd")}})


def _pair_states(rows: pd.DataFrame) -> pd.DataFrame:
    """The states of a pair's outer boundaries fix the one between."""
    rows = rows.sort_values("n")
    first = rows.iloc[0]
    states = [(int(first["le"]), first["lp"]), (int(first["re"]), first["rp"])]
    if len(rows) == 2:
        states.insert(1, middle(_entries(first), _entries(rows.iloc[1]), *states))
    return pd.DataFrame({"uid": rows["uid"].to_numpy(), "n": rows["n"].to_numpy(), "le": [x[0] for x in states[:-1]],
                         "lp": [x[1] for x in states[:-1]], "re": [x[0] for x in states[1:]], "rp": [x[1] for x in states[1:]]})


def boundary_states(matrices: DataFrame) -> DataFrame:
    """(uid, n, le, lp, re, rp): the states at both boundaries of each chunk, from (uid, n, a, b, c, d), its matrix.

    Neighbours are multiplied pairwise, by chunk number, until one matrix a text is left; then the states go down the same
    tree.  Groups have two rows at most, and rounds are the logarithm of the chunks of the longest text.
    """
    levels = [stored(matrices, "giant-matrices")]
    chunks = (levels[0].agg(F.max("n")).first()[0] or 0) + 1
    while chunks > 1:
        pairs = levels[-1].groupBy("uid", F.expr("n div 2").alias("k"))
        levels.append(stored(pairs.applyInPandas(_pair_product, _MATRIX), "giant-products"))
        chunks = -(-chunks // 2)
    edge = [F.lit(0).alias("le"), F.lit("").alias("lp"), F.lit(0).alias("re"), F.lit("").alias("rp")]
    states = levels.pop().select("uid", "n", *edge)
    while levels:
        above = states.withColumnRenamed("n", "k")
        below = levels.pop().withColumn("k", F.expr("cast(n div 2 as int)")).join(above, ["uid", "k"])
        states = stored(below.groupBy("uid", "k").applyInPandas(_pair_states, _STATES), "giant-states")
    return states


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids",
                     count_col: str = "n_tokens", chunk_chars: int = CHUNK_CHARS, verify_col: str | None = None) -> DataFrame:
    """``docs`` with its columns, the ids of each text and their number; with ``verify_col`` also whether the ids decode
    to the text (null texts count as empty), checked where the ids are made."""
    added = [ids_col, count_col, *([verify_col] if verify_col else [])]
    docs = docs.drop(*added)
    names = docs.columns
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))
    full = docs.withColumn(ids_col, F.lit(None).cast("array<int>")).withColumn(count_col, F.lit(None).cast("long"))
    full = (full.withColumn(verify_col, F.lit(None).cast("boolean")) if verify_col else full).schema
    at = names.index(text_col)

    def short(batches):
        with piece_model(model_path) as model:
            for b in batches:
                for lo in range(0, b.num_rows, 200):
                    part = b.slice(lo, 200)
                    texts = [t.as_py() or "" for t in part.column(at)]
                    ids = [model.unpacked(model.encoded(t)) for t in texts]
                    same = [pa.array([model.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts)], pa.bool_())] if verify_col else []
                    yield pa.RecordBatch.from_arrays([*part.columns, *_id_arrays(ids), *same], [*names, *added])

    done = docs.where(size <= chunk_chars).mapInArrow(short, full)

    uid, decoded = free_name(docs, "uid"), free_name(docs, "decoded")
    giants = stored(docs.where(size > chunk_chars).withColumn(uid, F.monotonically_increasing_id()), "giants")

    def split(batches):
        with piece_model(model_path) as model:
            for b in batches:
                for u, t in zip(b.column(0), b.column(1)):
                    parts = cut(t.as_py(), chunk_chars, model.longest)
                    for n, (text, lo, hi) in enumerate(parts):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([u.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([text], pa.string()), pa.array([lo], pa.int32()),
                             pa.array([hi], pa.int32()), pa.array([n == len(parts) - 1], pa.bool_())], ["uid", "n", "s", "lo", "hi", "last"])

    parts = giants.select(F.col(uid).alias("uid"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        split, "uid long, n int, s string, lo int, hi int, last boolean")
    parts = stored(parts.repartition("uid", "n"), "giant-chunks")

    def matrices(batches):
        with piece_model(model_path) as model:
            for b in batches:
                for u, n, s, lo, hi, last in zip(*b.columns):
                    m = model.transfer(s.as_py(), lo.as_py(), hi.as_py(), last.as_py())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u.as_py()], pa.int64()), pa.array([n.as_py()], pa.int32()),
                         *(pa.array([[x[i] for x in m]], pa.list_(pa.int32() if i % 2 == 0 else pa.string())) for i in range(4))],
                        ["uid", "n", "a", "b", "c", "d"])

    bounds = boundary_states(parts.mapInArrow(matrices, _MATRIX))

    def trace(batches):
        with piece_model(model_path) as model:
            for b in batches:
                for u, n, s, lo, hi, last, le, lp, re_, rp in zip(*(c.to_pylist() for c in b.columns)):
                    ids = model.backtrace(s, lo, hi, last, (le, lp), (re_, rp))
                    yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([n], pa.int32()), _id_arrays([ids])[0]],
                                                     ["uid", "n", "ids"])

    traced = parts.join(bounds, ["uid", "n"]).select("uid", "n", "s", "lo", "hi", "last", "le", "lp", "re", "rp").mapInArrow(
        trace, "uid long, n int, ids array<int>")
    whole = traced.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias(ids_col))
    giant = giants.join(whole.withColumnRenamed("uid", uid), uid).withColumn(count_col, F.size(ids_col).cast("long"))
    if verify_col:
        text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
        giant = decode_documents(giant, model_path, ids_col, decoded).withColumn(verify_col, F.col(decoded) == text)
    return done.unionByName(giant.select(*names, *added))


def _id_arrays(ids: list) -> list[pa.Array]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(size)]


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with its columns and the text of its ids; null ids give a null text."""
    encoded = encoded.drop(text_col)
    full = encoded.withColumn(text_col, F.lit(None).cast("string")).schema
    at, names = encoded.columns.index(ids_col), [*encoded.columns, text_col]

    def run(batches):
        with piece_model(model_path) as model:
            for b in batches:
                for lo in range(0, b.num_rows, 200):
                    part = b.slice(lo, 200)
                    texts = [model.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in part.column(at)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, full)
