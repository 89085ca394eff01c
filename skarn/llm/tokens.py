"""Problem 8: a byte-level BPE vocabulary compiled into a deterministic automaton over its tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts with one state that allows every
byte; each merge (u, v) -> w then adds one gadget: arcs labelled u lead to a new state, a copy of the old one that no
longer allows v; w is allowed wherever u is; and arcs labelled w lead where v led before. The merges are compiled one by
one into a table of states and labels. A byte string has exactly one accepted path; it is found by walking positions
from left to right with two table lookups a step, since every prefix of an accepted path is accepted. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import json
import os

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.session import read_table, ship_package, spread

#: Folder of the public vocabularies.
VOCABULARIES = os.environ.get("SKARN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + n)] = b
    return out


class Automaton:
    """The compiled table. Every merge must join tokens that can stand side by side when its turn comes, as trained ones do.

    labels: the bytes of each token, the label of its arcs. state: the number of the state to which arcs of a token lead.
    barred: for each token the states that have no arc for it, one bit per state; tokens with equal sets share one.
    steps, ends: the byte transitions from the start of a token, (node << 8 | byte) -> node, and the token that a node ends.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        n = max(ids.values()) + 1
        self.labels: list[bytes] = [b""] * n
        for label, i in ids.items():
            self.labels[i] = label
        gadgets = [(ids[u], ids[v], ids[u + v]) for u, v in merges]
        leads = {i: 0 for label, i in ids.items() if len(label) == 1}  # token -> state; state 0 is the first one
        origin = [-1]  # state -> the state that it was copied from
        for u, v, w in gadgets:
            if u not in leads or v not in leads:
                raise ValueError("a merge uses a token that no earlier merge makes")
            if w in leads:
                raise ValueError("two merges make one token")
            leads[w] = leads[v]
            origin.append(leads[u])
            leads[u] = len(origin) - 1
        # States that arcs still lead to at the end, numbered so that all copies of a state, and copies of those, are a span.
        ends = dict.fromkeys(leads.values())
        copies: list[list[int]] = [[] for _ in origin]
        for state in range(len(origin) - 1, 0, -1):
            copies[origin[state]].append(state)
        first, after, number = [0] * len(origin), [0] * len(origin), 0
        todo = [(0, False)]
        while todo:
            state, left = todo.pop()
            if left:
                after[state] = number
                continue
            first[state] = number
            if state in ends:
                ends[state] = number
                number += 1
            todo.append((state, True))
            todo += [(x, False) for x in copies[state]]
        barred = dict.fromkeys((i for label, i in ids.items() if len(label) == 1), 0)
        for made, (u, v, w) in enumerate(gadgets, 1):  # the gadget of this merge made the state of this number
            barred[v] |= ((1 << (after[made] - first[made])) - 1) << first[made]
            barred[w] = barred[u]
        size = number // 8 + 1
        shared: dict[int, bytes] = {}
        self.state = [ends[leads[i]] if i in leads else -1 for i in range(n)]
        self.barred = [shared.setdefault(barred[i], barred[i].to_bytes(size, "little")) if i in barred else b"" for i in range(n)]
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i in leads:
            node = 0
            for byte in self.labels[i]:
                new = self.steps.setdefault(node << 8 | byte, len(self.ends))
                if new == len(self.ends):
                    self.ends.append(-1)
                node = new
            self.ends[node] = i
        self.words: dict[str, list[int]] = {}

    def __reduce__(self):
        return _load, ({k: v for k, v in self.__dict__.items() if k != "words"},)

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after token a has an arc for token b."""
        return not self.barred[b][self.state[a] >> 3] >> (self.state[a] & 7) & 1

    def encode_bytes(self, data: bytes) -> list[int]:
        """The accepted path of a byte string."""
        steps, ends, barred, state = self.steps.get, self.ends, self.barred, self.state
        n = len(data)
        last = [-1] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            at = state[last[i]] if i else -1
            place, bit = at >> 3, 1 << (at & 7)
            node, j = 0, i
            while j < n and (node := steps(node << 8 | data[j])) is not None:
                j += 1
                token = ends[node]
                if token >= 0 and last[j] < 0 and (not i or not barred[token][place] & bit):
                    last[j] = token
        out = []
        while n:
            out.append(last[n])
            n -= len(self.labels[last[n]])
        return out[::-1]

    #: Distinct words whose paths are kept; beyond it the store is emptied.
    MOST_WORDS = 300_000

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; the text is split by SPLIT first."""
        out: list[int] = []
        words = self.words
        for word in _SPLIT.findall(text):
            path = words.get(word)
            if path is None:
                if len(words) >= self.MOST_WORDS:
                    words.clear()
                path = self.encode_bytes(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    words[word] = path
            out += path
        return out

    def decode(self, ids) -> str:
        """The text whose path has these labels."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_SPLIT = regex.compile(SPLIT)


def _load(state: dict) -> Automaton:
    new = Automaton.__new__(Automaton)
    new.__dict__.update(state, words={})
    return new


def compile_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Automaton:
    """The automaton of a byte-level BPE vocabulary file (name.json with its merges)."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    as_bytes = lambda text: bytes(letters[ch] for ch in text)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pairs = [(as_bytes(a), as_bytes(b)) for a, b in merges]
    used = {x for pair in pairs for x in (*pair, pair[0] + pair[1])}
    ids = {}
    for text, i in model["vocab"].items():
        if all(ch in letters for ch in text) and (len(data := as_bytes(text)) == 1 or data in used):
            ids[data] = i
    return Automaton(ids, pairs)


def encode_column(df: DataFrame, text: str, into: str, automaton: Automaton) -> DataFrame:
    """Adds into: array<int> of the text's token ids. Null and empty texts have an empty list.

    The automaton, whose size is that of the vocabulary, is broadcast; texts are encoded whole where they lie, without
    a shuffle. Repeated rows stay; an existing column of that name is replaced.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def encode(texts: pd.Series) -> pd.Series:
        a = shared.value
        return pd.Series([[] if t is None else a.encode(t) for t in texts], index=texts.index)

    return df.withColumn(into, F.pandas_udf(encode, "array<int>")(F.col(text)))


def decode_column(df: DataFrame, ids: str, into: str, automaton: Automaton) -> DataFrame:
    """Adds into: the text of a list of token ids; null for a null list."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def decode(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(x) for x in lists], index=lists.index)

    return df.withColumn(into, F.pandas_udf(decode, "string")(F.col(ids)))


def token_ids(spark, sf_dir: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids of every row of documents."""
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_column(documents, "text", "ids", compile_vocabulary(name, folder)).select("doc_id", "ids")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document by byte_bpe_50k, without special tokens; an empty list for null and empty texts."""
    return token_ids(spark, sf_dir)


def p8_restored(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and whether decoding the ids gives back the text; null texts count as empty."""
    automaton = compile_vocabulary()
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = decode_column(encode_column(documents, "text", "ids", automaton), "ids", "back", automaton)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("restored"))
