"""A hierarchical Pitman-Yor language model over words, trained and applied on the cluster.

Restaurants: every word is a customer of the restaurant of the two words before it; all such restaurants with the same
last word share one parent, the restaurant of that word; these share the root, over a uniform base on the V known words
and one unknown word. A table of a restaurant is a customer of its parent. Words are known by a 64-bit hash, a context of
two words by a hash of theirs; a text begins after two START words.

Seating is sampled by Gibbs: in each sweep every dish of every restaurant takes its customers out and seats them anew,
one after another, by the Chinese-restaurant rule, given the parent's current probabilities and the restaurant's tables
as they stood (beyond 64 customers in steps of a tenth, by their expectation rounded at random). Discounts follow in each
sweep from how many dishes of a level have one and two customers. Probabilities are averaged over SAMPLES sweeps that
follow BURN others.

The same on any cluster: random numbers are hashes of the dish, the sweep and the customer; totals are exact sums over
all rows; a token's log-probability is rounded to 2**-28 and added as an integer. So neither the number of parts nor the
order or dealing of rows changes a score.

Data flow, all rows counted:
1. each scan task cuts its texts into blocks and sends each part of the vocabulary the block's tokens whose word before
   is in that part: at most one message per token, packed in arrays. A part holds whole restaurants of two words and of
   one; a word before so frequent that a part would overflow is dealt over parts by the word that follows;
2. each part adds up its dishes and seats them. Before each sweep the parts exchange totals: of the root's dishes, and of
   the restaurants that are dealt over parts. Each is summed at the part that owns its hash (one in OWNED parts owns some),
   where the root's dishes are seated, and goes back to the parts that have it;
3. each part adds its tokens' log-probabilities by text, and the sums of a block's texts meet.
Blocks and parts are of bounded size; the driver gets a dozen sums per sweep, and of a bounded sample the words
whose restaurants are dealt over parts (MOST_HOT at most), which settles where they are seated, not how.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, kept_table, mixed, shuffle_partitions, text_of, word_hashes

SAMPLES = 2
BURN = 2
BLOCK_CHARS = 6 << 20
PART_CHARS = 10 << 20
LEAST_CHARS = 2 << 20  # of a part, where the session's shuffle partitions ask for more parts
HASHED_AT_ONCE = 1 << 20  # characters
SAMPLE_CHARS = 24 << 20  # of the sample that tells hot and common words
MOST_HOT, MOST_COMMON = 1 << 16, 1 << 18
SAMPLE_PARTS = 4  # that add up the sample's words
OWNED = 3  # parts for each that owns totals: messages, and the files they come in, go with parts times owners
HOT_PARTS = 0.75  # parts that a word's restaurants would fill before they are dealt over several
STRENGTHS = (100.0, 10.0, 1.0)  # of the root, of one word before, of two
END = np.uint64(0x243F6A8885A308D3)  # the hash of the token that ends a text
START = np.uint64(0x13198A2E03707344)  # what stands before a text's first token, twice
MULT = np.uint64(0x9E3779B97F4A7C15)
ONE = 1 << 28  # of the fixed-point log-probabilities


def squeeze(a: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes of equal weight side by side, compressed; read back by ``expand`` with the same kind."""
    planes = np.ascontiguousarray(a, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def expand(raw: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def together(lists: list[np.ndarray]) -> tuple[tuple[int, ...], bytes]:
    """Short lists of numbers below 2**32 packed as one, with their sizes; read back by ``apart``."""
    return tuple(map(len, lists)), squeeze(np.concatenate(lists), "<u4")


def apart(packed: tuple[tuple[int, ...], bytes]) -> list[np.ndarray]:
    numbers, out, at = expand(packed[1], "<u4"), [], 0
    for size in packed[0]:
        out.append(numbers[at : at + size])
        at += size
    return out


def squeeze_rising(a: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their steps."""
    return squeeze(np.diff(a.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def expand_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, "<u8"))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of (a, b)."""
    return mixed(a * MULT + b)


def ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers below ``most``, and the numbers in it. Where a number and its place fit into 63 bits, they
    are sorted as one number: a fraction of the time that a sort of places takes."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = keys.astype(np.int64)
    packed <<= bits
    packed |= np.arange(len(keys))
    packed.sort()
    return packed & ((1 << bits) - 1), packed >> bits


def numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``most``, ascending, and the place of each number among them."""
    order, keys = ordered(keys, most)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], place


def numbered_few(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for places in a list of ``size``, which need no sort."""
    seen = np.zeros(size, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def numbered_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for hashes of a text's words, most of which repeat: only the distinct ones are sorted."""
    got = pa.array(words).dictionary_encode()
    known = got.dictionary.to_numpy()
    order = np.argsort(known)
    place = np.empty(len(known), np.int32)
    place[order] = np.arange(len(known), dtype=np.int32)
    return known[order], place[got.indices.to_numpy()]


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in turn, each text ended by END; tokens per text."""
    raws = [t.encode().lower() for t in texts]
    hashes, starts = word_hashes(b"\n".join(raws))
    cut = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
    counts = np.diff(cut) + 1
    words = np.empty(len(hashes) + len(texts), np.uint64)
    inner = np.ones(len(words), bool)
    inner[np.cumsum(counts) - 1] = False
    words[inner], words[~inner] = hashes, END
    return words, counts


class Sampled:
    """What a sample tells of the words: ``hot`` ones (ascending hashes) with ``many``, over how many places what follows
    them is dealt, and ``common`` ones (ascending hashes), which are sent by their places in this list."""

    def __init__(self, hot: np.ndarray, many: np.ndarray, common: np.ndarray):
        self.hot, self.many, self.common = hot, many, common

    def splits(self, words: np.ndarray) -> np.ndarray:
        """Over how many places the restaurants behind each word are dealt."""
        if not len(self.hot):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, self.many[at], 1)

    def dealt(self, known: np.ndarray, before: np.ndarray, words: np.ndarray, parts: int) -> np.ndarray:
        """The part of each token: by the word before (its place in ``known``), and by the word too where that is hot."""
        many = self.splits(known).astype(np.uint64)
        part = part_of(known, parts)[before]
        at = np.flatnonzero((many > 1)[before])
        two = before[at]
        part[at] = part_of(joint(known[two], mixed(words[at]) % many[two]), parts)
        return part

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the common ones, or -1."""
        if not len(self.common):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[at] == words, at, -1)

    def named(self, words: np.ndarray, places: np.ndarray | None = None) -> tuple[bytes, bytes]:
        """Ascending hashes, packed: the places of common words, and the hashes of others."""
        places = self.places(words) if places is None else places
        known = places >= 0
        return squeeze(np.diff(places[known], prepend=0), "<u4"), squeeze_rising(words[~known])

    def names(self, packed: tuple[bytes, bytes]) -> np.ndarray:
        places = np.cumsum(expand(packed[0], "<u4").astype(np.int64))
        return np.sort(np.concatenate([self.common[places], expand_rising(packed[1])]))


# ---------------------------------------------------------------------------------------------------------------
# What blocks send, and what a part makes of it.
# ---------------------------------------------------------------------------------------------------------------


def block_messages(ids: list, held: list[bool], words: np.ndarray, counts: np.ndarray, parts: int, told: Sampled):
    """(part, packed) for each part that has tokens of the block."""
    n = len(words)
    first = np.cumsum(counts) - counts
    known, own = numbered_words(np.append(words, START))
    start, own = own[-1], own[:-1]
    before = np.empty(n, np.int32)
    before[1:] = own[:-1]
    before[first] = start
    code = np.repeat((np.arange(len(counts)) * 2 + np.array(held, np.int64)).astype(np.uint32), counts)
    places = told.places(known)
    order, keys = ordered(told.dealt(known, before, words, parts) * len(known) + before, parts * len(known))
    part, two = np.divmod(keys, len(known))
    three = np.stack([two, before[np.maximum(order - 1, 0)], own[order]]).astype(np.int32)
    three[1, two == start] = start
    code = code[order]
    ended = words[order] == END
    at = np.flatnonzero(np.diff(part, prepend=-1))
    place = np.zeros(len(known), np.int32)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), n], strict=True):
        mine = three[:, a:b]
        if 16 * mine.size > len(known):
            seen = np.zeros(len(known), bool)
            seen[mine] = True
            names = np.flatnonzero(seen)
        else:
            names = np.unique(mine)
        place[names] = np.arange(len(names))
        two, one, word = place[mine]
        docs = code[a:b][ended[a:b]] >> 1
        named = [ids[d] for d in docs.tolist()]
        packed = [
            *told.named(known[names], places[names]),
            squeeze(np.diff(two, prepend=0), "<u4"),
            squeeze(one, "<u4"),
            squeeze(word, "<u4"),
            squeeze(code[a:b], "<u4"),
            squeeze(np.array([0 if i is None else i for i in named], np.int64), "<i8"),
            squeeze(np.array([i is None for i in named], np.uint8), "<u1"),
            squeeze(counts[docs], "<u4"),
        ]
        yield int(part[a]), b"".join(len(x).to_bytes(4, "little") + x for x in packed)


def opened(packed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(packed):
        n = int.from_bytes(packed[at : at + 4], "little")
        out.append(packed[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class Dishes:
    """What all blocks send to a part, added up.

    words: the hashes of its dishes, ascending, and counts: their tokens in training. befores: the hashes of the words before.
    Dishes of one word before: b_two (place in befores), b_word (place in words). Contexts of two words: u_hash, u_two.
    Dishes of these: t_u, t_b (places in the former) and customers. token: each token's dish, in the blocks' order.
    """

    def __init__(self, rows: list[tuple], told: Sampled):
        rows = sorted(rows, key=lambda r: r[0])
        messages = [opened(r[1]) for r in rows]
        names = [told.names((m[0], m[1])) for m in messages]
        known, place = np.unique(np.concatenate(names), return_inverse=True)
        size, place = len(known), place.astype(np.int32)
        first = np.cumsum([0] + [len(x) for x in names])
        del names
        codes = [expand(m[5], "<u4") for m in messages]
        train = np.concatenate(codes) & 1 == 0
        self.blocks = [(r[0], c >> 1, m[6], m[7], m[8]) for r, c, m in zip(rows, codes, messages, strict=True)]

        def column(k: int) -> np.ndarray:
            found = (expand(m[k], "<u4").astype(np.int64) for m in messages)
            return np.concatenate([place[f + (np.cumsum(x) if k == 2 else x)] for f, x in zip(first, found, strict=False)])

        # a context's number by (word before, the one before that), then a dish's by (context, word)
        pair = column(2).astype(np.int64)
        pair *= size
        pair += column(3)
        pairs, context = numbered(pair, size**2)
        pair = context.astype(np.int64)
        pair *= size
        pair += column(4)
        del place, messages, codes, context
        dish, self.token = numbered(pair, len(pairs) * size)
        n_dishes = len(dish)
        del pair
        self.t_u, word = np.divmod(dish, size)
        del dish
        two, one = np.divmod(pairs, size)
        key, self.t_b = numbered(two[self.t_u] * size + word, size**2)
        del word
        b_two, b_word = np.divmod(key, size)
        dishes, self.b_word = numbered_few(b_word, size)
        befores, self.b_two = numbered_few(b_two, size)
        self.words, self.befores = known[dishes], known[befores]
        u_hash = joint(known[one], known[two])
        order = np.argsort(u_hash)  # contexts stand by their hashes, as the parts that sum them are ranges of hashes
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.u_hash, self.t_u = u_hash[order], rank[self.t_u]
        self.u_two = np.searchsorted(befores, two)[order]
        self.customers = np.bincount(self.token[train], minlength=n_dishes)
        self.counts = np.bincount(self.b_word[self.t_b], self.customers, minlength=len(dishes)).astype(np.int64)


class Seats:
    """The part of a part's state that seating needs: only dishes with two customers or more can have more than one
    table, so all others stand as fixed amounts."""

    def __init__(self, d: Dishes):
        once, often = d.customers == 1, d.customers > 1
        fixed = np.bincount(d.t_b[once], minlength=len(d.b_two))
        has = np.bincount(d.t_b[often], minlength=len(d.b_two)) > 0
        b_free = (fixed > 1) | has
        self.b_place, self.u_place = np.flatnonzero(b_free), np.unique(d.t_u[often])
        single = (fixed == 1) & ~b_free
        t = np.flatnonzero(often)
        self.t_u = np.searchsorted(self.u_place, d.t_u[t])
        self.t_b = (np.cumsum(b_free) - 1)[d.t_b[t]]
        self.customers = d.customers[t]
        self.u_fixed = np.bincount(d.t_u[once], minlength=len(d.u_hash))[self.u_place]
        self.u_hash = d.u_hash[self.u_place]
        self.b_two, self.b_word, self.b_fixed = d.b_two[b_free], d.b_word[b_free], fixed[b_free]
        self.two_fixed = np.bincount(d.b_two[single], minlength=len(d.befores))
        self.word_fixed = np.bincount(d.b_word[single], minlength=len(d.words))
        self.befores, self.words, self.counts = d.befores, d.words, d.counts
        self.keys()

    KINDS = {
        "t_u": "<u4", "t_b": "<u4", "customers": "<u4", "u_fixed": "<u4", "u_hash": "<u8", "u_place": "<u4", "b_two": "<u4", "b_word": "<u4", "b_fixed": "<u4",
        "two_fixed": "<u4", "word_fixed": "<u4", "befores": "named", "words": "named", "counts": "<u4",
    }

    def keys(self) -> None:
        self.t_key = joint(self.u_hash[self.t_u], self.words[self.b_word[self.t_b]])
        self.b_key = joint(self.befores[self.b_two], self.words[self.b_word])

    def packed(self, told: Sampled) -> dict:
        return {k: told.named(getattr(self, k)) if kind == "named" else squeeze(getattr(self, k), kind) for k, kind in self.KINDS.items()}

    @classmethod
    def of(cls, packed: dict, told: Sampled) -> Seats:
        out = cls.__new__(cls)
        for k, kind in cls.KINDS.items():
            got = told.names(packed[k]) if kind == "named" else expand(packed[k], kind)
            setattr(out, k, got.astype(np.int64) if kind == "<u4" else got)
        out.keys()
        return out


# ---------------------------------------------------------------------------------------------------------------
# Seating.
# ---------------------------------------------------------------------------------------------------------------


def drawn(keys: np.ndarray, sweep: int, k: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from the dish, the sweep and the customer."""
    salt = mixed(np.array([(sweep << 32) + k], np.uint64) * MULT)[0]
    return (mixed(keys ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(keys: np.ndarray, sweep: int, customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after its customers are seated anew; ``pull``: (strength + discount x tables) x parent's
    probability, the weight of a new table; dishes without customers have none."""
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    k = 1
    while len(live):
        step = 1 if k < 64 else k // 10
        m = np.minimum(step, customers[live] - k)
        new = pull[live] / (pull[live] + np.maximum(k - discount * tables[live], 1e-9))
        tables[live] += np.floor(m * new + drawn(keys[live], sweep, k)).astype(np.int64)
        k += step
        live = live[customers[live] > k]
    return np.minimum(tables, customers)


def discount_of(ones: float, twos: float) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Model:
    """Sums over all parts: n (tokens), v (types), discounts of the three levels, the root's customers and tables."""

    def __init__(self, n: float, v: float, discounts: tuple[float, float, float], customers: float, tables: float):
        self.n, self.v, self.discounts, self.customers, self.tables = n, v, discounts, customers, tables

    def base(self) -> float:
        """The weight of a new table of the root, for any word."""
        return (STRENGTHS[0] + self.discounts[0] * self.tables) / (self.v + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(customers - self.discounts[0] * tables, 0) + self.base()) / (STRENGTHS[0] + self.customers)


def below(level: int, model: Model, customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probabilities of dishes of a level from their own and their restaurant's customers and tables."""
    d, strength = model.discounts[level], STRENGTHS[level]
    return (np.maximum(customers - d * tables, 0) + (strength + d * all_tables) * parent) / (strength + all_customers)


def reseated(s: Seats, model: Model, sweep: int, tables: np.ndarray, b_tables: np.ndarray, root: np.ndarray, of_u: np.ndarray, of_two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the dishes of two words and of one after one more sweep, given the root's probabilities of the words and
    the restaurants' totals: tables (of_u), tables and customers (of_two)."""
    parent = root[s.b_word]
    b_customers = s.b_fixed + np.bincount(s.t_b, tables, minlength=len(s.b_fixed)).astype(np.int64)
    told = below(1, model, b_customers, b_tables, of_two[1][s.b_two], of_two[0][s.b_two], parent)
    tables = seat(s.t_key, sweep, s.customers, (STRENGTHS[2] + model.discounts[2] * of_u[s.t_u]) * told[s.t_b], model.discounts[2])
    b_customers = s.b_fixed + np.bincount(s.t_b, tables, minlength=len(s.b_fixed)).astype(np.int64)
    pull = (STRENGTHS[1] + model.discounts[1] * of_two[0][s.b_two]) * parent
    return tables, seat(s.b_key, sweep, b_customers, pull, model.discounts[1])


class Totals:
    """A part's own sums in a state: by word (root customers), by word before (tables, customers), by kept context
    (tables), and the dishes of one word with one and two customers."""

    def __init__(self, s: Seats, tables: np.ndarray, b_tables: np.ndarray):
        b_customers = s.b_fixed + np.bincount(s.t_b, tables, minlength=len(s.b_fixed)).astype(np.int64)
        self.word = s.word_fixed + np.bincount(s.b_word, b_tables, minlength=len(s.words)).astype(np.int64)
        self.two = s.two_fixed + np.bincount(s.b_two, b_tables, minlength=len(s.befores)).astype(np.int64)
        self.two_customers = s.two_fixed + np.bincount(s.b_two, b_customers, minlength=len(s.befores)).astype(np.int64)
        self.u = s.u_fixed + np.bincount(s.t_u, tables, minlength=len(s.u_fixed)).astype(np.int64)
        self.ones, self.twos = s.two_fixed.sum() + (b_customers == 1).sum(), (b_customers == 2).sum()


def dish_scores(d: Dishes, s: Seats, model: Model, tables: np.ndarray, b_tables: np.ndarray, root: np.ndarray, of_u: tuple[np.ndarray, np.ndarray], of_two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability of every dish of two words in a state; of_u: tables and customers of every context."""
    b_all = np.bincount(d.t_b[d.customers == 1], minlength=len(d.b_two))
    one = (b_all > 0).astype(np.int64)
    b_all[s.b_place] = s.b_fixed + np.bincount(s.t_b, tables, minlength=len(s.b_fixed)).astype(np.int64)
    one[s.b_place] = b_tables
    parent = below(1, model, b_all, one, of_two[1][d.b_two], of_two[0][d.b_two], root[d.b_word])
    t_all = (d.customers > 0).astype(np.int64)
    t_all[d.customers > 1] = tables
    return below(2, model, d.customers, t_all, of_u[1][d.t_u], of_u[0][d.t_u], parent[d.t_b])


def context_sums(d: Dishes, s: Seats, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers of every context of a part."""
    t_all = (d.customers > 0).astype(np.int64)
    t_all[d.customers > 1] = tables
    return np.bincount(d.t_u, t_all, minlength=len(d.u_hash)).astype(np.int64), np.bincount(d.t_u, d.customers, minlength=len(d.u_hash)).astype(np.int64)


# ---------------------------------------------------------------------------------------------------------------
# The cluster: state stays in its part from sweep to sweep, totals are dealt.
# ---------------------------------------------------------------------------------------------------------------


def give_back() -> None:
    """Lets the system have the memory that a worker has freed: workers stay for the tasks to come. What a worker has
    imported is set aside the first time, so that Python's collector doesn't look through it after each task."""
    import ctypes
    import gc

    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def gathered(items, wanted: tuple[str, ...]) -> dict[int, dict[str, list]]:
    """(part, (tag, values)) items of a partition that have a wanted tag, by part and tag."""
    out: dict[int, dict[str, list]] = {}
    for part, (tag, *values) in items:
        if tag in wanted:
            out.setdefault(part, {}).setdefault(tag, []).append(values)
    return out


def spread(lists: list[np.ndarray], owners: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(owner, the span of each ascending list of hashes that belongs to it)."""
    cuts = [np.searchsorted(part_of(x, owners), np.arange(owners + 1)) for x in lists]
    return [(q, [(c[q], c[q + 1]) for c in cuts]) for q in range(owners) if any(c[q] < c[q + 1] for c in cuts)]


def sampled(asked, parts: int, told_words: Sampled):
    """From (part, ("asked", block, packed)): the model, and an RDD of (block, sums of texts of it), each block in one partition.

    RDDs, as only totals are dealt anew. All that a step gives goes by one shuffle, to its own part or to others, and a step
    reads nothing but shuffles: each task has one Python worker. Where a step reads what other functions gave, or a union of
    that and of shuffles, there is a worker for these too, and all workers stay and take turns.
    """

    owners = math.ceil(parts / OWNED)

    def step(rdds, f, *wanted, deal=int):
        joined = rdds[0]
        for r in rdds[1:]:
            joined = joined.union(r)

        def run(items):
            found = gathered(items, wanted)
            while found:
                part, tags = found.popitem()
                yield from f(part, tags)
                del tags
                give_back()

        return joined.mapPartitions(run).partitionBy(parts, deal)

    def shared(s_befores, u_two, u_hash):
        """Places of the befores and of the contexts that are dealt over parts."""
        many = told_words.splits(s_befores) > 1
        return np.flatnonzero(many), np.flatnonzero(many[u_two])

    def begin(part, tags):
        d = Dishes(tags.pop("asked"), told_words)
        s = Seats(d)
        twos, us = shared(d.befores, d.u_two, d.u_hash)
        t = np.ones(len(s.customers), np.int64)
        tables, customers = context_sums(d, s, t)
        fixed = tables[us].copy()  # a kept context's tables change; all others stand
        at = np.searchsorted(s.u_place, us)
        inside = (at < len(s.u_place)) & (s.u_place[np.minimum(at, max(0, len(s.u_place) - 1))] == us) if len(s.u_place) else np.zeros(len(us), bool)
        # at, one more than the place among kept contexts, or 0
        extra = {"twos": squeeze(twos, "<u4"), "us": squeeze_rising(d.u_hash[us]), "us_fixed": squeeze(fixed, "<u4"), "us_customers": squeeze(customers[us], "<u4"), "us_kept": squeeze(np.where(inside, at + 1, 0), "<u4")}
        levels = np.array([(d.customers == 1).sum(), (d.customers == 2).sum()], float)
        lists = [s.words, d.u_hash[us], s.befores[twos]]
        del d, t, tables, customers
        packed = s.packed(told_words) | extra
        yield part, ("base", packed, levels)
        for q, spans in spread(lists, owners):
            kinds = (told_words.named, squeeze_rising, told_words.named)
            yield q, ("names", part, [f(x[a:b]) for f, x, (a, b) in zip(kinds, lists, spans, strict=True)])
        yield from stated(part, packed, levels, s, np.ones(len(s.customers), np.int64), np.ones(len(s.b_fixed), np.int64), 0, True)

    def sweep_away():
        """The shuffle files of sweeps that nothing refers to any more go when the driver's garbage does."""
        gc.collect()
        asked.ctx._jvm.System.gc()

    def house(part, tags):
        guests = sorted(tags["names"], key=lambda g: g[0])
        found, places = [], []
        for kind in range(3):
            lists = [expand_rising(g[1][kind]) if kind == 1 else told_words.names(g[1][kind]) for g in guests]
            own, at = np.unique(np.concatenate(lists), return_inverse=True)
            cut = np.cumsum([0] + [len(x) for x in lists])
            found.append((len(own), squeeze_rising(own) if kind == 0 else b""))
            places.append([at[cut[k] : cut[k + 1]] for k in range(len(guests))])
        yield part, ("house", found, [(g[0], together([p[k] for p in places])) for k, g in enumerate(guests)])

    def message(part, lists, sent):
        """``sent``: (first, second) sums for the words, the shared contexts, the shared befores."""
        for q, spans in spread(lists, owners):
            yield q, ("sums", part, together([x[a:b] for pair, (a, b) in zip(sent, spans, strict=True) for x in pair]))

    def sent_of(packed, s, totals, with_counts):
        twos = expand(packed["twos"], "<u4")
        fixed, at = (expand(packed[k], "<u4").astype(np.int64) for k in ("us_fixed", "us_kept"))
        u = np.where(at > 0, np.append(0, totals.u)[at], fixed)
        counts = s.counts if with_counts else np.zeros(len(s.counts), np.int64)
        return [(totals.word, counts), (u, expand(packed["us_customers"], "<u4")), (totals.two[twos], totals.two_customers[twos])]

    def totalled(part, tags, sweep, model):
        """Sums of all guests' sums, which the guests get; the root's dishes are seated; the root's and the part's sums."""
        level = sum((x[0] for x in tags.get("level", [])), np.zeros(4))
        if "house" not in tags:
            yield part, ("root", np.append(np.zeros(6), level))
            return
        found, guests = tags["house"][0]
        messages = dict(tags["sums"])
        guests = [(p, apart(places)) for p, places in guests]
        all_sums = [np.zeros((2, size), np.int64) for size, _ in found]
        for p, places in guests:
            told = apart(messages[p])
            for kind, at in enumerate(places):
                for k in range(2):
                    all_sums[kind][k][at] += told[2 * kind + k]
        customers, counts = all_sums[0]
        if model is None:
            tables = (customers > 0).astype(np.int64)
        else:
            tables = seat(expand_rising(found[0][1]), sweep, customers, np.full(len(customers), model.base()), model.discounts[0])
        for p, at in guests:
            yield p, (f"totals{sweep}", part, together([customers[at[0]], tables[at[0]], counts[at[0]], *(all_sums[k][j][at[k]] for k in (1, 2) for j in (0, 1))]))
        root = [customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum(), counts.sum(), (counts > 0).sum()]
        yield part, ("root", np.append(np.array(root, float), level))

    def whole(messages):
        """A part's totals in the order of its lists from what the owners sent, one message each."""
        told = [apart(packed) for _, packed in sorted(messages, key=lambda m: m[0])]
        return [np.concatenate([lists[k] for lists in told]).astype(np.int64) for k in range(7)]

    def stated(part, packed, levels, s, tables, b_tables, sweep, with_counts):
        totals = Totals(s, tables, b_tables)
        yield part, (f"state{sweep}", squeeze(tables, "<u4"), squeeze(b_tables, "<u4"))
        yield part, ("level", np.append([totals.ones, totals.twos], levels))
        lists = [s.words, expand_rising(packed["us"]), s.befores[expand(packed["twos"], "<u4")]]
        yield from message(part, lists, sent_of(packed, s, totals, with_counts))

    def opened_totals(packed, s, tags_totals, tables, b_tables):
        """Root customers and tables, counts, of_u over kept contexts, of_two, and the shared contexts' totals."""
        root, root_tables, counts, us, us_customers, two, two_customers = whole(tags_totals)
        totals = Totals(s, tables, b_tables)
        at = expand(packed["us_kept"], "<u4").astype(np.int64)
        totals.u[at[at > 0] - 1] = us[at > 0]
        twos = expand(packed["twos"], "<u4")
        totals.two[twos], totals.two_customers[twos] = two, two_customers
        return root, root_tables, counts, totals, us, us_customers

    base = step([asked], begin, "asked")
    houses = step([base], house, "names")

    def exchange(out, sweep, model):
        """The root's and the parts' sums after a state, and an RDD of the totals told to the parts."""
        told = step([houses, out], lambda part, tags: totalled(part, tags, sweep, model), "house", "sums", "level")
        return told.filter(lambda kv: kv[1][0] == "root").map(lambda kv: kv[1][1]).reduce(np.add), told

    def model_of(sums, n, v):
        return Model(n, v, (discount_of(sums[2], sums[3]), discount_of(sums[6], sums[7]), discount_of(sums[8], sums[9])), sums[0], sums[1])

    sums, told = exchange(base, 0, None)
    n, v = sums[4], sums[5]
    model = model_of(sums, n, v)
    held, samples = [], []
    for sweep in range(1, BURN + SAMPLES + 1):

        def again(part, tags, sweep=sweep, model=model):
            packed, levels = tags["base"][0]
            s = Seats.of(packed, told_words)
            tables, b_tables = (expand(x, "<u4").astype(np.int64) for x in tags[f"state{sweep - 1}"][0])
            root, root_tables, _, totals, _, _ = opened_totals(packed, s, tags[f"totals{sweep - 1}"], tables, b_tables)
            tables, b_tables = reseated(s, model, sweep, tables, b_tables, model.root(root, root_tables), totals.u, (totals.two, totals.two_customers))
            yield from stated(part, packed, levels, s, tables, b_tables, sweep, sweep > BURN)

        out = step([base, *held, told], again, "base", f"state{sweep - 1}", f"totals{sweep - 1}")
        held = [out]
        sums, told = exchange(out, sweep, model)
        model = model_of(sums, n, v)
        if sweep > BURN:
            samples.append((sweep, model, out, told))
        sweep_away()

    models = [(sweep, m) for sweep, m, _, _ in samples]

    def answer(part, tags):
        d = Dishes(tags.pop("asked"), told_words)
        s = Seats(d)
        packed = tags["base"][0][0]
        _, shared_us = shared(d.befores, d.u_two, d.u_hash)
        mean, counts = np.zeros(len(d.t_u)), None
        for sweep, model in models:
            tables, b_tables = (expand(x, "<u4").astype(np.int64) for x in tags[f"state{sweep}"][0])
            root, root_tables, counts, totals, us, us_customers = opened_totals(packed, s, tags[f"totals{sweep}"], tables, b_tables)
            of_u = context_sums(d, s, tables)
            of_u[0][shared_us], of_u[1][shared_us] = us, us_customers
            mean += dish_scores(d, s, model, tables, b_tables, model.root(root, root_tables), of_u, (totals.two, totals.two_customers))
        fixed = np.rint(np.log10(mean / len(models)) * ONE).astype(np.int64)[d.token]
        word = d.b_word[d.t_b][d.token]
        plain, known = np.log10((counts + 1) / (n + v + 1))[word], (counts > 0)[word]
        first = 0
        for block, docs, *ends in d.blocks:
            mine = slice(first, first + len(docs))
            first += len(docs)
            order, texts = ordered(docs, int(docs.max()) + 1)
            cut = np.flatnonzero(np.diff(texts, prepend=-1))
            found = texts[cut]
            sums = [np.add.reduceat(x[mine][order].astype(kind), cut) for x, kind in ((fixed, np.int64), (plain, np.float64), (known, np.int64))]
            last = docs[d.words[word[mine]] == END]
            yield block, ("texts", squeeze(found, "<u4"), squeeze(sums[0], "<i8"), squeeze(sums[1], "<f8"), squeeze(sums[2], "<u4"), squeeze(last, "<u4"), *ends)

    wanted = [f"{kind}{sweep}" for sweep, *_ in samples for kind in ("state", "totals")]
    dealt = [rdd for _, _, *rdds in samples for rdd in rdds]
    return model, step([asked, base, *dealt], answer, "asked", "base", *wanted, deal=lambda block: int(mixed(np.array([block], np.uint64))[0]))


def added(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of lists, ascending, and the sums of their counts."""
    words, place = np.unique(np.concatenate([w for w, _ in lists]), return_inverse=True)
    return words, np.bincount(place, np.concatenate([n for _, n in lists]), minlength=len(words)).astype(np.int64)


def sampled_words(rows: DataFrame, chars: int, parts: int) -> Sampled:
    """From a bounded sample: as hot, words whose share of the tokens would fill more than HOT_PARTS parts (at most
    MOST_HOT); as common, the MOST_COMMON most frequent ones. With one part there is nothing to deal or to send."""
    none = np.zeros(0, np.uint64)
    if parts == 1:
        return Sampled(none, np.zeros(0, np.int64), none)
    share = min(1.0, SAMPLE_CHARS / max(1, chars))
    drawn_rows = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003))

    def count(found):
        lists, texts, size = [], [], 0

        def counted():
            words, n = np.unique(tokenize(texts)[0], return_counts=True)
            lists.append((words, n))

        for row in found:
            texts.append(row.text)
            size += len(row.text) + 1
            if size >= HASHED_AT_ONCE:
                counted()
                texts, size = [], 0
        if texts:
            counted()
        if lists:
            words, n = added(lists)
            words[words == END] = START
            part = part_of(words, SAMPLE_PARTS)
            for q in range(SAMPLE_PARTS):
                yield q, (words[part == q], n[part == q])

    def most(found):
        lists = [pair for _, pair in found]
        if lists:
            words, n = added(lists)
            order = np.lexsort((words, -n))[:MOST_COMMON]
            yield n.sum(), words[order], n[order]

    # as RDDs: the workers are then those of the steps to come, and no others stay beside them
    counts = drawn_rows.select("text").rdd.mapPartitions(count).partitionBy(SAMPLE_PARTS, int).mapPartitions(most).collect()
    none_found = [(0, none, np.zeros(0, np.int64))]
    totals, words, n = zip(*(counts or none_found), strict=True)
    tokens, words, n = sum(totals), np.concatenate(words), np.concatenate(n)
    order = np.lexsort((words, -n))[:MOST_COMMON]
    words, n = words[order], n[order].astype(np.float64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    hot = n > max(HOT_PARTS / parts, 1 / MOST_HOT) * tokens
    return Sampled(words[hot], np.maximum(2, np.ceil(n[hot] / max(1, tokens) * parts)).astype(np.int64), words)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id) mod held_out[0] is not held_out[1]. A null text is the empty text: its end alone.
    Repeated rows each count. With nothing to learn from, V and N are 0 and every token is the unknown word.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", (bucket_of("doc_id", held_out[0]) == held_out[1]).alias("held_out"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not chars:
        return spark.createDataFrame([], out_schema)
    parts = max(math.ceil(chars / PART_CHARS), min(shuffle_partitions(spark), chars // LEAST_CHARS))
    told = sampled_words(rows, chars, parts)

    def cut(task, found):
        block = task << 32
        ids, held, texts, size, pending = [], [], [], 0, 0
        words, counts = [], []

        def hashed():
            nonlocal texts, pending
            if texts:
                w, c = tokenize(texts)
                words.append(w)
                counts.append(c)
            texts, pending = [], 0

        def out():
            for part, packed in block_messages(ids, held, np.concatenate(words), np.concatenate(counts), parts, told):
                yield part, ("asked", block, packed)

        for doc_id, text, out_of in found:
            ids.append(doc_id)
            held.append(out_of)
            texts.append(text)
            pending += len(text) + 1
            size += len(text) + 1
            if pending >= HASHED_AT_ONCE:
                hashed()
            if size >= BLOCK_CHARS:
                hashed()
                yield from out()
                block += 1
                ids, held, size, words, counts = [], [], 0, [], []
        hashed()
        if ids:
            yield from out()
        del words, counts
        give_back()

    asked = rows.rdd.mapPartitionsWithIndex(cut).partitionBy(parts, int)
    model, answers = sampled(asked, parts, told)
    kinds = {"docs": "<u4", "score": "<i8", "base": "<f8", "known": "<u4", "ended": "<u4", "ids": "<i8", "nulls": "<u1", "counts": "<u4"}

    def add(replies):
        got = [{k: expand(x, kind) for (k, kind), x in zip(kinds.items(), reply, strict=True)} for reply in replies]
        n = sum(len(r["ended"]) for r in got)
        score, known, n_tokens, ids, nulls = (np.zeros(n, np.int64) for _ in range(5))
        base = np.zeros(n)
        for r in sorted(got, key=lambda r: tuple(r["docs"][:1]) + tuple(r["base"][:1])):
            score[r["docs"]] += r["score"]
            base[r["docs"]] += r["base"]
            known[r["docs"]] += r["known"]
            ids[r["ended"]], nulls[r["ended"]], n_tokens[r["ended"]] = r["ids"], r["nulls"], r["counts"]
        doc_ids = np.where(nulls, None, ids.astype(object))
        return zip(*(x.tolist() for x in (doc_ids, n_tokens, known, base, score / ONE)), strict=True)

    def texts(items):
        found = gathered(items, ("texts",))
        while found:
            yield from add(found.popitem()[1]["texts"])
        give_back()

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    scored = kept_table(spark.createDataFrame(answers.mapPartitions(texts), schema, verifySchema=False), "lm-scores")
    held = bucket_of("doc_id", held_out[0]) == held_out[1]
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, *by: str) -> DataFrame:
    """From score_texts' rows, per group: texts, tokens, the model's perplexity and the counts' alone."""
    tokens = F.sum("n_tokens")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        tokens.alias("tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
    )
