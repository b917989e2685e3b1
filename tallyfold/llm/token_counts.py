"""Token counts of whole texts by byte-pair merging on a heap and a linked list, with no ids made for the caller.

A word's symbols are a linked list; a heap holds its adjacent pairs by rank, then by place. The least pair is popped, its two
symbols become one, and the pairs at either side enter the heap; a popped pair whose symbols have changed meanwhile is
passed over. A word has as many tokens as it had symbols less its merges, so a text's count needs no id at all.

Words come from the file's own pre-tokenizer. It never joins text across a blank, line feed or tab behind something that is
not white space, so a text is cut there first and a chunk's count is remembered (in a worker, within a bound).

Scale: one map over the scan, without a shuffle; a worker holds the merge table (50,000 pairs) and its two caches.
"""

from __future__ import annotations

import json
import sys
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, local_tokenizer, text_of, tokenizer_path

CACHE = 300_000  # chunks, and words, in each of two generations of a worker's caches
LONG = 64  # characters of a word beyond which its count is not remembered
SHIFT = 20  # bits of a symbol


class PairCounter:
    """``count(text)`` equals the length of ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" and "merges" not in model or spec.get("normalizer") or any(model.get(k) for k in ("ignore_merges", "end_of_word_suffix", "continuing_subword_prefix", "dropout")):
            raise ValueError("the file is not a plain byte-level BPE without a normalizer")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.symbol = {s: i for s, i in vocab.items() if len(s) == 1}
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << SHIFT | vocab[b], k)
        self.made = [vocab[a + b] for a, b in pairs]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.mark = special[0][0] if len({s[0] for s in special}) == 1 else ""  # what every special token begins with
        self.words: list[dict[str, int]] = [{}, {}]
        self.chunks: list[dict[str, int]] = [{}, {}]

    def merges(self, word: str) -> int:
        """How many pairs of the word's symbols merge."""
        symbols = [self.symbol[c] for c in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        heap = [(r, k) for k in range(n - 1) if (r := rank.get(symbols[k] << SHIFT | symbols[k + 1])) is not None]
        heapify(heap)
        done = 0
        while heap:
            r, k = heappop(heap)
            right = after[k]
            if right >= n or symbols[k] < 0 or rank.get(symbols[k] << SHIFT | symbols[right]) != r:
                continue
            done += 1
            symbols[k], symbols[right] = made[r], -1
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (s := rank.get(symbols[k] << SHIFT | symbols[far])) is not None:
                    heappush(heap, (s, k))
            near = before[k]
            if near >= 0 and (s := rank.get(symbols[near] << SHIFT | symbols[k])) is not None:
                heappush(heap, (s, near))
        return done

    def word(self, word: str) -> int:
        got = self.words[0].get(word)
        if got is None:
            got = self.words[1].get(word)
            if got is None:
                got = len(word) - self.merges(word)
            if len(word) <= LONG:
                if len(self.words[0]) >= CACHE:
                    self.words = [{}, self.words[0]]
                self.words[0][word] = got
        return got

    def chunk(self, chunk: str) -> int:
        got = self.chunks[1].get(chunk)
        if got is None:
            got = sum(self.word(w) for w, _ in self.splitter.pre_tokenize_str(chunk))
        if len(chunk) <= LONG:
            if len(self.chunks[0]) >= CACHE:
                self.chunks = [{}, self.chunks[0]]
            self.chunks[0][chunk] = got
        return got

    def plain(self, text: str) -> int:
        total = 0
        find = self.chunks[0].get
        for chunk in chunks_of(text):
            got = find(chunk)
            if got is None:
                got = self.chunk(chunk)
                find = self.chunks[0].get
            total += got
        return total

    def count(self, text: str) -> int:
        if self.mark not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def worker_counter(path: str) -> PairCounter:
    """The worker's counter, kept on ``sys`` from task to task, as functions sent by value lose their module."""
    held = sys.__dict__.setdefault("_tallyfold_pair_counters", {})
    if path not in held:
        held.clear()
        held[path] = PairCounter(path)
    return held[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (of UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    n_tokens is what the tokenizers library gives for the byte-level BPE file at ``path`` without added tokens; special
    tokens written in a text count as one each, as there. A null text is the empty text: no bytes, no tokens. Rows with
    the same id or text are counted each for itself, null ids stay, other columns are not looked at, an empty table gives
    an empty one, and a text of any length is counted whole.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        counter = worker_counter(local_tokenizer(path))
        for batch in batches:
            texts = batch.column("text")
            n = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
