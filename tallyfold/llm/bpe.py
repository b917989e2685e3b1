"""BPE by automaton: the merges of a vocabulary file compiled, one gadget after another, into a deterministic automaton
over tokens that accepts exactly the right tokenizations; words are encoded by its transition tables.

The automaton starts as one state that loops on every base symbol. The gadget of a merge (a, b) -> c, applied in order
of priority: wherever b may follow a, the state behind a is split off without its arc b, and every state with an arc a
gets an arc c to the state behind b. A token always leads to the same state, so states are kept as rows of bits (which
tokens may follow), tokens with equal incoming arcs share a column, and both are split only when a gadget parts them.

Encoding walks a trie of the tokens' bytes from each place of a word, for many words of a length at once, and follows
an arc where the automaton has one: as a word and each of its starts has exactly one accepted path, every place gets
one state and one incoming arc. Decoding emits the arcs' labels.

Scale: a map over the scan, no shuffle; the tables (about 50 MB, fixed by the vocabulary) are broadcast. A worker
remembers words it has encoded, in two generations of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_symbols, text_of, tokenizer_path

WORD_END = "</w>"
CACHE_CHUNKS = 150_000
PIECE = 1 << 21  # characters of text encoded at once


@functools.lru_cache(maxsize=2)
def compile_automaton(path: str) -> dict:
    """The tables for a BPE file with word ends: ``follow`` (bits: state x column), state and column of each token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    size = len(vocab)
    labels = [""] * size
    for token, i in vocab.items():
        labels[i] = token
    final = np.array([t.endswith(WORD_END) for t in labels])
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
    made = {c for _, _, c in pairs}
    base = [i for i in range(size) if i not in made]
    lefts, rights = len({a for a, _, _ in pairs}), len({b for _, b, _ in pairs})
    follow = np.zeros((2 * lefts + 2, (2 * rights + 16) // 8), np.uint8)
    state, column = np.full(size, -1), np.full(size, -1)
    state[[i for i in base if not final[i]]], column[base] = 0, 0
    follow[0, 0] = 1
    rows, cols = 1, 1
    row_uses, col_uses = np.zeros(len(follow), np.int64), np.zeros(8 * follow.shape[1], np.int64)
    row_uses[0], col_uses[0] = 1 + sum(not final[i] for i in base), len(base)  # 1: the start is state 0 for good
    for a, b, c in pairs:
        behind_a, col = state[a], column[b]
        if behind_a < 0 or col < 0 or not follow[behind_a, col >> 3] >> np.uint8(col & 7) & np.uint8(1):
            continue  # b never follows a, so this merge never applies
        behind_c = behind_a if a == b else state[b]
        if row_uses[behind_a] > 1 or a == b:
            if rows == len(follow):
                follow, row_uses = np.vstack([follow, np.zeros_like(follow)]), np.concatenate([row_uses, np.zeros_like(row_uses)])
            follow[rows] = follow[behind_a]
            row_uses[behind_a] -= 1
            state[a] = behind_a = rows
            row_uses[rows], rows = 1, rows + 1
        if col_uses[col] > 1:
            if cols == 8 * follow.shape[1]:
                follow, col_uses = np.hstack([follow, np.zeros_like(follow)]), np.concatenate([col_uses, np.zeros_like(col_uses)])
            bit = follow[:rows, col >> 3] >> np.uint8(col & 7) & np.uint8(1)
            follow[:rows, cols >> 3] |= bit << np.uint8(cols & 7)
            col_uses[col] -= 1
            column[b] = col = cols
            col_uses[cols], cols = 1, cols + 1
        follow[behind_a, col >> 3] &= np.uint8(255 - (1 << (col & 7)))
        column[c] = column[a]
        col_uses[column[a]] += 1
        if not final[c]:
            state[c] = behind_c
            row_uses[behind_c] += 1
    symbols = {s: b for b, s in enumerate(byte_symbols())}
    inner: list[dict[int, int]] = [{}]
    mid, last = [-1], [-1]
    for i, token in enumerate(labels):
        if column[i] < 0:
            continue
        node = 0
        for s in token.removesuffix(WORD_END) if final[i] else token:
            byte = symbols[s]
            if byte not in inner[node]:
                inner[node][byte] = len(inner)
                inner.append({})
                mid.append(-1)
                last.append(-1)
            node = inner[node][byte]
        (last if final[i] else mid)[node] = i
    parents = [k for k, x in enumerate(inner) if x]
    place = np.zeros(len(inner), np.int32)  # row 0 of next is empty: where leaves point
    place[parents] = np.arange(1, len(parents) + 1)
    step = np.zeros((len(parents) + 1, 256), np.int32)
    for k in parents:
        for byte, to in inner[k].items():
            step[place[k], byte] = to
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    names = list(labels)
    for text, i in special.items():
        names += [""] * (i + 1 - len(names))
        names[i] = text
    return {
        "follow": np.ascontiguousarray(follow[:rows, : (cols + 7) // 8]),
        "state": state.astype(np.int32),
        "column": column.astype(np.int32),
        "step": step,
        "place": place,
        "mid": np.array(mid, np.int32),
        "last": np.array(last, np.int32),
        "length": np.array([len(t.removesuffix(WORD_END)) for t in labels], np.int32),
        "labels": names,
        "special": special,
        "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


LONG_WORD = 256  # bytes: words beyond go through the tables one by one, as few have the same length


def encode_long(tables: dict, word: bytes) -> list[int]:
    """The ids of one word by the same transitions, a byte and an arc at a time: no arrays as long as the word but two."""
    follow, stride = memoryview(tables["follow"].ravel()), tables["follow"].shape[1]
    step, place = memoryview(tables["step"].ravel()), memoryview(tables["place"])
    state, column, length = (memoryview(tables[k]) for k in ("state", "column", "length"))
    n = len(word)
    at, arc = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    at_view, arc_view = memoryview(at), memoryview(arc)
    ends = {False: memoryview(tables["mid"]), True: memoryview(tables["last"])}
    for j in range(n):
        node, row = 0, at_view[j] * stride
        for end in range(j + 1, n + 1):
            node = step[place[node] * 256 + word[end - 1]]
            if not node:
                break
            token = ends[end == n][node]
            if token < 0:
                continue
            col = column[token]
            if follow[row + (col >> 3)] >> (col & 7) & 1:
                arc_view[end] = token
                at_view[end] = state[token]
    out, left = [], n
    while left:
        out.append(arc_view[left])
        left -= length[out[-1]]
    return out[::-1]


def encode_words(tables: dict, words: list[bytes]) -> list[list[int]]:
    """The ids of each (non-empty) word."""
    out: list[list[int]] = [[]] * len(words)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[k] = encode_long(tables, w)
        else:
            by_length.setdefault(len(w), []).append(k)
    flat, stride = tables["follow"].ravel(), tables["follow"].shape[1]
    state, column, step, place, length = (tables[k] for k in ("state", "column", "step", "place", "length"))
    for n, mine in by_length.items():
        w = np.frombuffer(b"".join([words[k] for k in mine]), np.uint8).reshape(-1, n)
        count = len(mine)
        at = np.zeros((n + 1, count), np.int64)  # the state reached at each place, times the stride
        arc = np.zeros((n + 1, count), np.int32)
        for j in range(n):
            rows, node = np.arange(count), np.zeros(count, np.int32)
            for end in range(j + 1, n + 1):
                node = step[place[node], w[rows, end - 1]]
                if not node.all():
                    live = np.flatnonzero(node)
                    rows, node = rows[live], node[live]
                    if not len(rows):
                        break
                token = tables["last" if end == n else "mid"][node]
                has = np.flatnonzero(token >= 0)
                t, r = token[has], rows[has]
                col = column[t]
                may = np.flatnonzero(flat[at[j, r] + (col >> 3)] >> (col & 7).astype(np.uint8) & np.uint8(1))
                t, r = t[may], r[may]
                arc[end, r] = t
                if end < n:
                    at[end, r] = state[t].astype(np.int64) * stride
        back = np.full((count, n), -1, np.int32)
        rows, left = np.arange(count), np.full(count, n)
        for k in range(n - 1, -1, -1):
            t = arc[left, rows]
            back[rows, k] = t
            left = left - length[t]
            live = np.flatnonzero(left)
            if not len(live):
                break
            rows, left = rows[live], left[live]
        full = back >= 0
        ids, cut = back[full].tolist(), np.concatenate([[0], np.cumsum(full.sum(axis=1))]).tolist()
        for k, a, b in zip(mine, cut, cut[1:], strict=False):
            out[k] = ids[a:b]
    return out


class AutomatonTokenizer:
    """Whole texts to (ids, decoded text), both as UTF-8: decimal ids joined by a space, labels joined by a space."""

    def __init__(self, tables: dict):
        self.tables = tables
        self.words = regex.compile(tables["pattern"])
        self.special = regex.compile("|".join(map(regex.escape, tables["special"])) or r"(?!)")
        self.id_text = [str(i).encode() for i in range(len(tables["labels"]))]
        self.label_text = [t.encode() for t in tables["labels"]]
        self.young: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}

    def split(self, chunk: str) -> list[bytes | int]:
        """Words as bytes, special tokens as ids."""
        out: list[bytes | int] = []
        at = 0
        for m in self.special.finditer(chunk) if "<" in chunk else ():
            out += self.plain(chunk[at : m.start()])
            out.append(self.tables["special"][m[0]])
            at = m.end()
        return out + self.plain(chunk[at:])

    def plain(self, text: str) -> list[bytes]:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        return [w.encode() for w in self.words.findall(text)]

    def learn(self, chunks: set[bytes]) -> None:
        parts = {c: self.split(c.decode()) for c in chunks}
        words = list({p for ps in parts.values() for p in ps if isinstance(p, bytes)})
        ids = dict(zip(words, encode_words(self.tables, words), strict=True))
        for c, ps in parts.items():
            mine = [i for p in ps for i in (ids[p] if isinstance(p, bytes) else (p,))]
            self.young[c] = (b" ".join([self.id_text[i] for i in mine]), b" ".join([self.label_text[i] for i in mine]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.young) >= CACHE_CHUNKS:  # only here, so that all of these texts' chunks stay at hand
            self.old, self.young = self.young, {}
        split = [t.encode().split() for t in texts]
        new = {c for chunks in split for c in set(chunks) if c not in self.young}
        for c in [c for c in new if c in self.old]:
            self.young[c] = self.old[c]
            new.discard(c)
        self.learn(new)
        out = []
        for chunks in split:
            got = [x for x in map(self.young.__getitem__, chunks) if x[0]]
            out.append((b" ".join([x[0] for x in got]), b" ".join([x[1] for x in got])))
        return out


def worker_tokenizer(path: str, tables: dict) -> AutomatonTokenizer:
    held = sys.__dict__.setdefault("_tallyfold_automata", {})
    if path not in held:
        held.clear()
        held[path] = AutomatonTokenizer(tables)
    return held[path]


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ids and decoded (strings).

    Equal to the tokenizers library with the file at ``path`` (no special tokens added; those written in a text count;
    no decoder: labels joined by one space). A null text is the empty text: no tokens, both digests of ''.
    """
    path = path or tokenizer_path()
    tables = df.sparkSession.sparkContext.broadcast(compile_automaton(path))
    kind = dict(df.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        tokenizer = worker_tokenizer(path, tables.value)
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            rows: list[tuple] = []
            first = 0
            while first < len(all_texts):
                last, size = first, 0
                while last < len(all_texts) and (size == 0 or size + len(all_texts[last]) < PIECE):
                    size += len(all_texts[last])
                    last += 1
                for ids, decoded in tokenizer.encode(all_texts[first:last]):
                    row = (ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, ids.decode(), decoded.decode()) if texts else row)
                first = last
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names)

    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
