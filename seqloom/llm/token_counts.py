"""Token counts by trie-shared dynamic programming under a unigram model of tokens.

The tokens of a byte-level vocabulary have log-probabilities by Zipf's law of their ranks (fixed by the
file, nothing is trained), in whole units so that sums are exact. Distinct pre-tokens go into a trie of
bytes; each new node gets the best forward score of its prefix once, over the tokens that end there, with
the number of tokens on that path, and terminal nodes keep the count for their pre-token. Of equally
likely paths the one of fewer tokens counts. Tries are per worker and bounded; a full one starts anew. A
pre-token of more than LONG_WORD bytes, which hardly shares a prefix, is scored alone, with the scores of
its last bytes only, so memory doesn't follow the longest word.

Null and empty texts have no tokens; an empty table gives no rows. All 256 bytes are tokens, so every text has
a path. Repeated rows are counted alike, each on its own; ties are settled as said. Other columns than id and
text are never read, so their names can't clash.
"""

from __future__ import annotations

import base64
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Vocabulary
from .common import map_arrow, texts_of, tokenizer_path

NODES = 400_000
WORDS = 300_000
LONG_WORD = 1024
UNIT = 1 << 20
SHIFT = 2.7


class Trie:
    """Forward scores of prefixes; children are found by (parent, byte)."""

    def __init__(self, ranks: dict[bytes, int]):
        norm = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
        self.cost = {p: round(UNIT * (math.log(r + SHIFT) + norm)) for p, r in ranks.items()}
        #: Ends of tokens: beyond a string that isn't one, no longer token can end at the node.
        self.tails = {p[k:] for p in ranks for k in range(len(p))}
        self.longest = max(map(len, ranks), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0], [0]

    def insert(self, word: bytes) -> int:
        """Tokens on the best path of the word, which becomes a terminal."""
        child, best, tokens, cost, tails = self.child, self.best, self.tokens, self.cost, self.tails
        node, path = 0, [0]
        for d, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                least, count = None, 0
                for k in range(d - 1, -1, -1):
                    piece = word[k:d]
                    if piece not in tails:
                        break
                    c = cost.get(piece)
                    if c is not None:
                        at = path[k]
                        here, n = best[at] + c, tokens[at] + 1
                        if least is None or here < least or (here == least and n < count):
                            least, count = here, n
                node = child[key] = len(best)
                best.append(least)
                tokens.append(count)
            path.append(node)
        return tokens[node]


    def alone(self, word: bytes) -> int:
        """The same without the trie: scores of the last bytes, as many as the longest token has."""
        best, tokens, cost, tails = deque([0], self.longest), deque([0], self.longest), self.cost, self.tails
        for d in range(1, len(word) + 1):
            least, count = None, 0
            for back in range(1, min(d, self.longest) + 1):
                piece = word[d - back : d]
                if piece not in tails:
                    break
                c = cost.get(piece)
                if c is not None:
                    here, n = best[-back] + c, tokens[-back] + 1
                    if least is None or here < least or (here == least and n < count):
                        least, count = here, n
            best.append(least)
            tokens.append(count)
        return tokens[-1]


class Counter:
    """Token counts of texts, with terminals shared by all texts of a worker."""

    def __init__(self, ranks: bytes, split: str):
        self.trie = Trie({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a})
        self.vocabulary = Vocabulary(split)
        self.vocabulary.cut = None
        self.terminal: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = self.vocabulary.words(text)
        found = list(map(self.terminal.get, words))
        if None in found:
            terminal, trie = self.terminal, self.trie
            if len(terminal) > WORDS or len(trie.best) > NODES:
                terminal.clear()
                trie.clear()
            total = 0
            for w in words:
                n = terminal.get(w)
                if n is None:
                    piece = w.encode()
                    if len(piece) > LONG_WORD:
                        n = trie.alone(piece)
                    else:
                        n = terminal[w] = trie.insert(piece)
                total += n
            return len(words), total
        return len(words), sum(found)


_loaded: dict[int, Counter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, split_path: str | None = None) -> DataFrame:
    """Rows of id, n_pretokens and n_tokens for every document."""
    with open(ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    with open(split_path or tokenizer_path(), encoding="utf-8") as f:
        split = f.read()
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = hash(ranks)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Counter(ranks, split)
        found = [_loaded[key].count(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kernel, f"id {kind}, n_pretokens long, n_tokens long", "text").withColumnRenamed("id", id_col)
