"""Token ids, packing, BPE automaton and audio: exact round trips against the libraries."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfold.llm import dac, media, packing
from tallyfold.llm.bpe import AutomatonTokenizer, bpe_round_trip, compile_automaton
from tallyfold.llm.common import ChunkEncoder, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", "  ", "Hello WORLD's it'll <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "naïve café é ﬁ 12345 ½²", "a" * 3000 + "b", "日本語 🙂‍\U0001f525 \x1c\x85x", "don't 'S",
    "<|", "word. word, x.!?", "İ K ΣΑΣ ß", "lorem ipsum " * 9000, " x y",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def automaton():
    return AutomatonTokenizer(compile_automaton(tokenizer_path()))


@pytest.fixture(scope="module")
def chunked():
    return ChunkEncoder(tokenizer_path())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns({"start": F.lit("c"), "part": F.lit(1), "media": F.lit(2), "sig": F.lit(3)})


def odd_rows():
    return [*enumerate(ODD), (3, ODD[3]), (None, "null id"), (40, ODD[3])]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def same_as_library(library, automaton, chunked, text):
    ids = ids_of(library, text)
    got, decoded = automaton.encode([text])[0]
    assert got.decode() == " ".join(map(str, ids))
    assert decoded.decode() == library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(chunked.encode(text), "<u2").tolist() == ids


def test_odd_texts(library, automaton, chunked):
    for text in ODD:
        same_as_library(library, automaton, chunked, text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!?'<|>sStTdDlLeErRvVmM0129éÉßñaAoOnNiIhH"), st.characters(min_codepoint=32, max_codepoint=0x24F)), max_size=60))
def test_any_text(library, automaton, chunked, text):
    same_as_library(library, automaton, chunked, text)


def test_caches_roll_over(library, monkeypatch):
    from tallyfold.llm import bpe, common

    monkeypatch.setattr(common, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    small, auto = ChunkEncoder(tokenizer_path()), AutomatonTokenizer(compile_automaton(tokenizer_path()))
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice(["the", "of.", "zebra,", "Über", "x1"]) for _ in range(6))
        same_as_library(library, auto, small, text)


def test_words_and_stops_go_straight_to_the_model(library):
    """Only what is neither letters nor stops pays for the library's whole chain, and a word does once whatever stops follow."""
    encoder, whole, asked = ChunkEncoder(tokenizer_path()), [], []
    ids, word = encoder.ids, encoder.word
    encoder.ids = lambda text: whole.append(text) or ids(text)
    encoder.word = lambda w: asked.append(w.decode()) or word(w)
    text = "Élan, élan*** word.&&& Word word$$$ fin!! straße### ÀÖØÞ (x) it's a1 <b> *** ..."
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids_of(library, text)
    assert sorted(whole) == ["", "(x)", "<b>", "a1", "it's"]
    assert sorted(asked) == sorted(set(asked)) and asked.count("word") == 1 and "word$$$" not in asked


def test_blocks_of_texts(library, monkeypatch):
    from tallyfold.llm import common

    odd = [*(t or "" for t in ODD), "A <|endoftext|> B.", "a|> B|> <|endoftext|>. <|ENDOFTEXT|>", "a\x0bb\x0cc\x1cd\x1fe\x85f\xa0g\u2028h. \u0301i", "", " ", "One, two.' three''.", "x,.\n,.x y_z- ~^`"] * 2
    for bytes_at_once in (1, 40, 1 << 20):
        monkeypatch.setattr(common, "BLOCK_BYTES", bytes_at_once)
        for end in (None, 2):
            got = list(ChunkEncoder(tokenizer_path()).encode_all(pa.array(odd), end))
            assert [g.tolist() for g in got] == [ids_of(library, t) + [end] * (end is not None) for t in odd]
    assert list(ChunkEncoder(tokenizer_path()).encode_all(pa.array([], pa.string()), 2)) == []
    sliced = pa.array(["no", *odd, "no"]).slice(1, len(odd))
    assert [g.tolist() for g in ChunkEncoder(tokenizer_path()).encode_all(sliced)] == [ids_of(library, t) for t in odd]


def test_bpe_operator(spark, library):
    got = bpe_round_trip(frame(spark, odd_rows()), texts=True).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        text = dict(odd_rows())[r["doc_id"]] or ""
        ids = ids_of(library, text)
        assert r["n_tokens"] == len(ids) and r["ids"] == " ".join(map(str, ids))
        assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_round_trip(frame(spark, [])).collect() == []


# ------------------------------------------------------------------------------------------------ token ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**31 - 1)), max_size=2000), st.randoms(use_true_random=False))
def test_segment(values, rng):
    ids = np.array(values, np.uint32)
    segment = dac.Segment(dac.encode_segment(ids))
    places = [rng.randrange(len(values)) for _ in range(50)] if values else []
    assert segment.ids(np.array(places, np.int64)).tolist() == [values[p] for p in places]
    assert segment.ids(np.arange(len(values))).tolist() == values


@pytest.mark.parametrize("width", range(1, 32))
def test_pack(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 203, np.uint32)
    for n in (0, 1, 7, 8, 203):
        bits = "".join(format(v, f"0{width}b")[::-1] for v in values[:n].tolist())
        packed = dac.pack(values[:n], width)
        assert packed == bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8)) + bytes(4)
        assert dac.unpack(np.frombuffer(packed, np.uint8), width, np.arange(n)).tolist() == values[:n].tolist()


def test_reads_in_slices(monkeypatch):
    monkeypatch.setattr(dac, "READ_IDS", 7)
    ids = np.random.default_rng(5).integers(0, 49_408, 1300, np.uint32)
    places = np.random.default_rng(6).permutation(1300)
    assert dac.Segment(dac.encode_segment(ids)).ids(places).tolist() == ids[places].tolist()


def test_widths_are_best():
    rng = np.random.default_rng(4)
    ids = (2 ** rng.uniform(0, 12, 4000)).astype(np.uint32)

    def size(widths):
        total, shift = 0, 0
        for k, w in enumerate(widths):
            count = len(ids) if k == 0 else int((ids >> shift != 0).sum())
            total += count * (w + (k + 1 < len(widths)))
            shift += w
        return total

    bits = int(ids.max()).bit_length()
    options = [[bits], *([a, bits - a] for a in range(1, bits)), *([a, b, bits - a - b] for a in range(1, bits) for b in range(1, bits - a))]
    assert size(dac.best_widths(ids, 3)) == min(map(size, options))


def test_token_ids(spark, library, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 500)
    rows = odd_rows()
    got = dac.token_ids_round_trip(frame(spark, rows)).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for (i, t), r in zip(want, got, strict=True):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_ids_empty(spark):
    assert dac.token_ids_round_trip(frame(spark, [])).collect() == []


# ------------------------------------------------------------------------------------------------ packing


def check_pieces(pieces, sizes, window):
    by_doc, by_sequence = {}, {}
    for d, start, n, s, offset in pieces:
        assert n > 0
        by_doc.setdefault(d, []).append((start, n))
        by_sequence.setdefault(s, []).append((offset, n))
    for d, size in sizes.items():
        at = 0
        for start, n in sorted(by_doc.get(d, [])):
            assert start == at
            at += n
        assert at == size
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 150), max_size=30), st.integers(0, 5))
def test_pack_shard(sizes, seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 40, n).astype(np.uint16) for n in sizes]
    check_pieces(packing.pack_shard(docs, 32, 4), dict(enumerate(sizes)), 32)


def test_index_against_brute_force():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint16) for _ in range(50)]
    index = packing.ShardIndex(docs)
    mean = np.mean([len(d) for d in docs])

    def weight(term, d):
        tf, df = int((docs[d] == term).sum()), sum(int(term in x) for x in docs)
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) if tf else 0.0

    unused = np.ones(len(docs), bool)
    unused[[0, 3]] = False
    for doc in (0, 7):
        terms = sorted(set(docs[doc].tolist()), key=lambda t: (-weight(t, doc), t))[:12]
        want = {d: sum(weight(t, d) for t in terms) for d in range(len(docs)) if unused[d]}
        best = sorted(want.values(), reverse=True)[:10]
        got = index.neighbours(doc, unused, 10)
        assert all(unused[got]) and np.allclose([want[d] for d in got.tolist()], best, rtol=1e-4)


def test_packing_asks_with_all_terms():
    """The true neighbour shares only light terms with the seed; and all-term scores against brute force while documents go."""
    seed = np.concatenate([np.repeat(np.arange(12), 9), [50]]).astype(np.uint16)
    docs = [seed, np.full(20, 70, np.uint16), np.full(20, 50, np.uint16)]
    mates = {}
    for d, _, _, s, _ in packing.pack_shard(docs, len(seed) + 20):
        mates.setdefault(s, []).append(d)
    assert mates[0] == [0, 2]

    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 60, rng.integers(1, 120)).astype(np.uint16) for _ in range(40)]
    index, unused, mean = packing.ShardIndex(docs), np.ones(40, bool), np.mean([len(d) for d in docs])
    df = {t: sum(int(t in x) for x in docs) for t in range(60)}

    def score(terms, d):
        tf = {t: int((docs[d] == t).sum()) for t in terms}
        return sum(math.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t, n in tf.items())

    for doc in range(36):
        unused[doc] = False
        want = {d: score(set(docs[doc].tolist()), d) for d in range(40) if unused[d]}
        got = index.neighbours(doc, unused, 5, None)
        best = sorted((x for x in want.values() if x > 0), reverse=True)[:5]
        assert all(unused[got]) and np.allclose([want[d] for d in got.tolist()], best, rtol=1e-4)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(1)
    topics = [np.arange(100 * k, 100 * k + 100) for k in range(4)]
    docs = [rng.choice(topics[k % 4], 16).astype(np.uint16) for k in range(64)]
    pieces = packing.pack_shard(docs, 64, 12)
    mates = {}
    for d, _, _, s, _ in pieces:
        mates.setdefault(s, set()).add(d % 4)
    assert sum(len(m) for m in mates.values()) < 2 * len(mates)


def test_many_short_documents_take_bounded_time():
    """A full shard of documents of one token: seconds, so a million of them, in shards of SHARD_DOCS, well under a minute."""
    import time

    docs = [np.array([1 + k % 3], np.uint16) for k in range(packing.SHARD_DOCS)]
    began = time.process_time()
    pieces = packing.pack_shard(docs)
    assert time.process_time() - began < 8
    check_pieces(pieces, dict.fromkeys(range(len(docs)), 1), packing.WINDOW)


def test_shards_are_bounded_by_documents(spark, library, monkeypatch):
    rows = [(k, ["a", "", None, "b c"][k % 4]) for k in range(90)]
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    got = packing.pack_documents(frame(spark, rows)).collect()
    made = {i: len(ids_of(library, t)) + 1 for i, t in rows}
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], made, 2048)
    assert len({r["sequence_id"] for r in got}) >= 6


def test_packing(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    rows = [r for r in odd_rows() if r[0] not in (3, 40)] + [(3, ODD[3]), (40, ODD[3])]
    got = packing.pack_documents(frame(spark, rows)).collect()
    want = {i: np.array([*ids_of(library, t), 1], "<u4") for i, t in rows}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(x) for i, x in want.items()}, 2048)
    twice = packing.pack_documents(frame(spark, [(1, "a b"), (1, "a b")])).collect()
    assert sum(r["length"] for r in twice) == 6
    assert packing.pack_documents(frame(spark, [])).collect() == []


# ------------------------------------------------------------------------------------------------ audio


def test_media(spark):
    rows = odd_rows()
    got = media.audio_features(media.store_media(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    features = {}
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        raw = text.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(payload) + 44)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert features.setdefault(text, r["feature"]) == r["feature"]
        table = media.read_stream(r["tensors"])
        assert table.schema.field("log_mel").type.shape == [media.WINDOW, media.MELS]
        ends = table.column("end_ms").to_pylist()
        assert table.column("start_ms").to_pylist() == [0, *[media.WINDOW * 10 * (k + 1) for k in range(len(ends) - 1)]]
        assert all(s["start_ms"] < s["end_ms"] <= ends[-1] for s in r["spans"])
    assert media.audio_features(media.store_media(frame(spark, []))).collect() == []


def test_wav_is_readable():
    import io
    import wave

    payload = bytes(range(192))
    with wave.open(io.BytesIO(media.to_wav(payload))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getframerate()) == (1, 1, media.RATE) and w.readframes(192) == payload
    assert media.from_wav(media.to_wav(payload)) == payload


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1)])
def test_resample_against_zero_stuffing(up, down):
    rng = np.random.default_rng(6)
    x = rng.normal(size=101).astype(np.float32)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    h = media.low_pass(up, down)
    full = np.convolve(stuffed, h)
    delay = (media.TAPS // 2) * up
    want = np.array([full[delay + m * down] if delay + m * down < len(full) else 0.0 for m in range(-(-len(x) * up // down))])
    assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_tone_lands_in_its_band():
    t = np.arange(media.RATE) / media.RATE
    mel = media.log_mel(media.resample(np.sin(2 * np.pi * 1000 * t)), media.mel_bank(), np.hanning(media.FRAME).astype(np.float32))
    centre = np.argmax(media.mel_bank(), axis=0) * media.RATE * media.UP / media.DOWN / media.FFT
    assert abs(centre[mel.mean(axis=0).argmax()] - 1000) < 120


def test_segments():
    energy = np.array([0, 0, 5, 3, 2.9, 0, 2.5, 0, 5, 5.0])
    assert media.segments(energy - energy.mean(), on=2, off=0.4) == [(2, 5), (8, 10)]


def test_the_end_of_a_signal_is_in_a_frame():
    bank, shape = media.mel_bank(), np.hanning(media.FRAME).astype(np.float32)
    for n in (1, 199, 200, 201, 288, 672, 1152):
        y = np.ones(n, np.float32)
        z = y.copy()
        z[-8:] = -1
        assert len(media.log_mel(y, bank, shape)) == 1 + math.ceil(max(0, n - media.FRAME) / media.HOP)
        assert n <= media.FRAME or not np.array_equal(media.log_mel(y, bank, shape), media.log_mel(z, bank, shape))


def test_media_are_stored_with_tensors(spark, monkeypatch):
    """The media are read from a table in the shared folder, and the query's tensors have a fixed shape and time spans."""
    import pyarrow.parquet as pq

    rows = [(1, "some words " * 400), (2, None), (3, "é")]
    paths = []
    monkeypatch.setattr(media, "kept_table", lambda df, name, keep=media.kept_table: paths.append(df) or keep(df, name))
    stored = media.stored_media(frame(spark, rows))
    assert len(paths) == 1 and stored.inputFiles()
    bodies = [b for f in stored.inputFiles() for b in pq.read_table(f.removeprefix("file://"))["media"].to_pylist()]
    assert sorted(bodies) == sorted(media.to_wav(media.payload_of(t or "")[0]) for _, t in rows)
    for r in media.audio_features(stored).collect():
        table = media.read_stream(r["tensors"])
        assert table.schema.field("log_mel").type.shape == [media.WINDOW, media.MELS]
        assert table["start_ms"][0].as_py() == 0 and table["end_ms"].to_pylist()[:-1] == table["start_ms"].to_pylist()[1:]
        frames = int(r["feature"].split(";")[0].split("=")[1])
        assert table["end_ms"][-1].as_py() == frames * 10 and all(s["start_ms"] < s["end_ms"] <= frames * 10 for s in r["spans"])


def test_long_words_go_through_the_same_tables():
    from tallyfold.llm import bpe

    tables = bpe.compile_automaton(bpe.tokenizer_path())
    rng = np.random.default_rng(6)
    words = [bytes(rng.choice(np.frombuffer(b"abcdeths", np.uint8), n)) for n in (1, 2, 7, 40, 200, 255)] + ["éèß日本".encode() * 12]
    assert [bpe.encode_long(tables, w) for w in words] == bpe.encode_words(tables, words)
    began = __import__("time").time()
    long = b"thequickbrownfox" * 20_000
    assert len(bpe.encode_words(tables, [long])[0]) > 20_000 and __import__("time").time() - began < 30


def test_many_segments(spark, monkeypatch):
    """Parts with several segments each: every document begins where the ones before it end."""
    monkeypatch.setattr(dac, "SEGMENT_IDS", 50)
    rows = [(k, f"some words of text {k} " * (k % 7)) for k in range(300)]
    got = sorted(dac.token_ids_round_trip(frame(spark, rows)).collect())
    assert [r["doc_id"] for r in got] == list(range(300))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
