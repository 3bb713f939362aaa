"""Operator 1: byte-pair encoding and decoding with a deterministic tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens whose
paths are exactly the right tokenizations (successive merge gadgets, as in
"Constructing a BPE Tokenization DFA", 2024):

* Start with one state that loops on every byte.
* For the merge ``u v -> w``, in order of priority: let ``s`` be the state that
  ``u`` arcs lead to. A copy of ``s`` without its ``v`` arc becomes the new
  target of all ``u`` arcs, so ``u v`` can no longer be read as two tokens;
  wherever ``u`` may be read, a ``w`` arc is added, to the state that followed
  ``v``.

Every arc with one label leads to one state, so a merge adds one state: the
automaton has at most ``merges + 1`` states and is stored as their gadgets
(which state was copied, which arc it lost). Whether a state has an arc is
found from the gadgets and kept in the transition table.

A prefix of a right tokenization is one too, so each byte position is reached
in at most one state; a position from which the word can't be ended is never
tried twice, so encoding is linear in the word. Decoding emits the labels of
the arcs.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.llm.common import WordCache, slices, with_columns

# The classes of the split pattern. Latin text takes the faster
# engine, whose classes are written out; all other text takes full Unicode classes.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LATIN_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

_latin = re.compile(SPLIT.format(L=LATIN_LETTER, N=LATIN_NUMBER, S=SPACE))
_any = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=SPACE))
_not_latin = re.compile(f"[^\x00-{chr(0x24F)}{chr(0x2010)}-{chr(0x2027)}{chr(0x2030)}-{chr(0x205E)}{chr(0x20AC)}]")


def split_words(text: str) -> list[str]:
    """The pieces of a text that merges never cross; joined, they give the text."""
    return (_any if _not_latin.search(text) else _latin).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """The automaton of one merge list. ``spec``: text of the vocabulary file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        raw = {t: bytes(map(letters.__getitem__, t)) for t in data["model"]["vocab"]}
        ids = data["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
        size = max(ids.values()) + 1
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.labels = {i: raw[t] for t, i in ids.items()}
        self.labels.update({i: content.encode() for content, i in self.added.items()})
        self.added_pattern = re.compile("(" + "|".join(
            re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # state 0 loops on the bytes; state k + 1 is made by the gadget of merge k
        self.target, self.start_target = [0] * size, [0] * size
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.owner, self.gadget = [-1], {}
        for k, (a, b) in enumerate(merges):
            u, v, w = ids[a], ids[b], ids[a + b]
            after_v = self.target[v]
            self.gadget[u, v] = k + 1
            self.owner.append(u)
            self.target[u] = k + 1
            self.target[w] = self.start_target[w] = after_v
            self.born[w], self.left[w], self.right[w] = k, u, v
        reachable = {t: i for t, i in ids.items() if len(raw[t]) == 1 or self.born[i] >= 0}
        self.prefixes: dict[bytes, int] = {}
        for t, i in reachable.items():
            r = raw[t]
            for n in range(1, len(r)):
                self.prefixes.setdefault(r[:n], -1)
            self.prefixes[r] = i
        self.table: dict[tuple[int, int], bool] = {}
        self.words = WordCache(400_000)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``; kept in the transition table."""
        key = (state, token)
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 1_000_000:
                self.table.clear()
            known = self.table[key] = self._derive_arc(state, token)
        return known

    def _derive_arc(self, state: int, token: int) -> bool:
        while True:
            # was the arc lost in one of the copies made after the token came up?
            at, owner = state, self.owner[state]
            while at > self.born[token] + 1 and at > 0:
                made = self.gadget.get((owner, token))
                if made is not None and made <= at:
                    return False
                at = self.start_target[owner]
                owner = self.right[owner]
            if self.born[token] < 0:
                return True
            # at its birth the token went to all states that could read its left part;
            # step to the copy that the state came from at that time
            state, token = self._as_of(state, self.born[token] + 1), self.left[token]

    def _as_of(self, state: int, limit: int) -> int:
        """The state at number ``limit`` or below that ``state`` was copied from."""
        at, owner = state, self.owner[state]
        while at > limit:
            # copies made for one owner form a run; below it lies the owner's first target
            first = self.start_target[owner]
            if first >= limit or self._runs(owner)[0] > limit:
                at, owner = first, self.right[owner]
                continue
            run = self._runs(owner)
            lo, hi = 0, len(run)
            while lo < hi:
                mid = (lo + hi) // 2
                if run[mid] <= limit:
                    lo = mid + 1
                else:
                    hi = mid
            return run[lo - 1]
        return at

    def _runs(self, owner: int) -> list[int]:
        """The states made by gadgets of one owner, ascending."""
        if not hasattr(self, "_by_owner"):
            self._by_owner: dict[int, list[int]] = {}
            for s, o in enumerate(self.owner):
                self._by_owner.setdefault(o, []).append(s)
        return self._by_owner[owner]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Read the one accepted path that spells the word."""
        data = word.encode()
        n, p, q = len(data), 0, 0
        path: list[tuple[int, int]] = []  # (state before, label) of the arcs taken
        dead: set[int] = set()  # positions from which no path spells the rest
        get, table, target = self.prefixes.get, self.table, self.target
        while p < n:
            found = []
            for e in range(p + 1, n + 1):
                token = get(data[p:e])
                if token is None:
                    break
                if token >= 0:
                    found.append((e, token))
            for e, token in reversed(found):
                if e not in dead:
                    known = table.get((q, token))
                    if self.has_arc(q, token) if known is None else known:
                        path.append((q, token))
                        p, q = e, target[token]
                        break
            else:
                dead.add(p)
                q, token = path.pop()
                p -= len(self.labels[token])
        return tuple([token for _, token in path])

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; strings of added tokens become their ids."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._encode_plain(text)
        out: list[int] = []
        for i, part in enumerate(self.added_pattern.split(text)):
            out += [self.added[part]] if i % 2 else self._encode_plain(part)
        return out

    def _encode_plain(self, text: str) -> list[int]:
        pieces = self.words.get_many(split_words(text), lambda new: map(self.encode_word, new))
        return list(chain.from_iterable(pieces))

    def decode(self, ids) -> str:
        """Emit the arc labels."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_automata: dict[int, TokenAutomaton] = {}


def automaton(spec: str) -> TokenAutomaton:
    """Compiled once in each Python worker."""
    key = hash(spec)
    if key not in _automata:
        _automata.clear()
        _automata[key] = TokenAutomaton(spec)
    return _automata[key]


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver (a fixed, small size) and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Add ``ids_col`` array<int>, the tokens of each whole text; with ``decoded_col``
    also the text that these ids decode to.

    One pass over the rows, no shuffle. Null and empty texts give no ids. Equal
    rows stay as they are. A column that has the name of an output column is
    replaced. Very long texts are read once, in time proportional to their length.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    out = [ids_col] + ([decoded_col] if decoded_col else [])
    fields = [f for f in df.schema.fields if f.name not in out]
    names = [f.name for f in fields] + out
    schema = T.StructType(fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)] + (
        [T.StructField(decoded_col, T.StringType(), False)] if decoded_col else []))

    def run(batches):
        bpe = automaton(spec.value)
        for batch, texts in slices(batches, text_col, 1 << 20):
            ids = [bpe.encode(t) if t else [] for t in texts]
            arrays = {ids_col: pa.array(ids, pa.list_(pa.field("element", pa.int32(), False)))}
            if decoded_col:
                arrays[decoded_col] = pa.array(map(bpe.decode, ids), pa.string())
            yield with_columns(batch, names, arrays)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``, the text of the ids (null ids: empty). Unknown ids fail the job."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    fields = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in fields] + [text_col]

    def run(batches):
        bpe = automaton(spec.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield with_columns(batch, names, {text_col: pa.array([bpe.decode(x or ()) for x in ids], pa.string())})

    return df.mapInArrow(run, T.StructType(fields + [T.StructField(text_col, T.StringType(), False)]))


def roundtrip_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    df = encode(docs.select("doc_id", "text"), tokenizer, "text", "ids", "decoded")
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
