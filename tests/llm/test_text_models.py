"""Language ID, quality, language model, n-gram join: edge cases, brute force and held-out accuracy."""

import collections
import gc
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import lm, ngram_join, quality
from tallyfold.llm.langid import Ranker, gram_counts, language_id, sample_counts
from tallyfold.llm.quality import quality_score
from tallyfold.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "123 !?", "a", "\x00\x1c", "word " * 60_000, "日本語 テキスト", "é"]


def odd_docs(spark):
    rows = [(k, t, None if k % 2 else "en", None, None) for k, t in enumerate(ODD)] + [(1, "", "en", None, 3), (None, "some text", "de", "s", 1)]
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("clash"), "held_out": F.lit(0), "node": F.lit("c"), "block": F.lit(1)})


# ------------------------------------------------------------------------------------------------ language ID


def test_gram_counts():
    codes, counts = gram_counts("Ab, ab!")
    a, b = ord("a"), ord("b")
    want = {a: 2, b: 2, a: 2, (a << 21) | b: 2, a | 0: 2, b << 21: 2, (a << 42) | (b << 21): 2, (a << 21) | b: 4}
    got = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    want = collections.Counter()
    for w in (" ab ", " ab "):
        cp = [0 if c == " " else ord(c) for c in w]
        for c in cp[1:-1]:
            want[c] += 1
        for k in range(3):
            want[(cp[k] << 21) | cp[k + 1]] += 1
        for k in range(2):
            want[(cp[k] << 42) | (cp[k + 1] << 21) | cp[k + 2]] += 1
    assert got == dict(want)


def test_rank_distance_against_brute_force():
    profiles = {"x": [5, 3, 9], "y": [3, 5, 8]}
    text = "abcabc abd"
    codes, counts = gram_counts(text)
    mine = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist(), strict=True), key=lambda p: (-p[1], p[0]))][:3]
    profiles = {"x": [mine[1], mine[0], 7], "y": [mine[0], mine[1], mine[2]]}
    lang, score = Ranker(profiles, 3).predict(text)
    far = {k: sum(min(3, abs(p.index(g) - r)) if g in p else 3 for r, g in enumerate(mine)) for k, p in profiles.items()}
    assert lang == min(sorted(far), key=far.get) == "y" and score == 1 - far["y"] / 9


def test_language_edge_cases(spark):
    got = language_id(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else "some text"
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    assert language_id(odd_docs(spark).limit(0)).collect() == []
    unlabelled = language_id(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = [r for r in QUERIES["op9_language_id"](spark, DATA).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0


# ------------------------------------------------------------------------------------------------ quality


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb!", "Über", "ab", ""]) for _ in range(rng.randrange(40))).encode() for _ in range(60)] + [b"", b" ", b"x"]
    weights, bias = quality.train([t.decode() for t in texts], [k % 2 for k in range(len(texts))])
    whole = quality.score_texts(texts, weights, bias)
    alone = np.array([quality.score_texts([t], weights, bias)[0] for t in texts])
    monkeypatch.setattr(quality, "PIECE", 64)
    assert (whole == alone).all() and (whole == quality.score_texts(texts, weights, bias)).all()


def test_features_against_brute_force():
    raw = "ab ab\tabc dé".encode()
    found = quality.features(raw)
    words = raw.split()
    assert len(found[0][0]) == len(words) and found[0][1][0] == found[0][1][1] != found[0][1][2]
    assert len(found[1][0]) == len(words) - 1
    repeat = quality.features(b"zz zz")[1][1][0]
    assert found[1][1][0] == repeat != found[1][1][1]
    padded = raw.replace(b"\t", b" ")
    for n, (_, buckets) in zip(quality.GRAMS, found[2:], strict=True):
        want = [padded[k : k + n] for k in range(len(raw) - n + 1) if b" " not in padded[k + 1 : k + n - 1]]
        assert len(buckets) == len(want) and len(set(buckets.tolist())) == len(set(want))


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_score(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = quality_score(odd_docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_score(odd_docs(spark).limit(0), labels).collect() == []


def test_quality_of_repeated_ids_and_clashing_names(spark):
    """A training id on very many rows brings one text to the driver; the added column's name must be free."""
    rows = [(1, f"text {k}", "en", None, None) for k in range(500)] + [(2, "good words", "en", None, None), (4, "bad words", "en", None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("_quality", F.lit("c"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError):
        quality.add_quality(docs, labels)
    seen = []
    keep = quality.train
    try:
        quality.train = lambda texts, y: seen.extend(texts) or keep(texts, y)
        got = quality.add_quality(docs, labels, score_col="_q").collect()
    finally:
        quality.train = keep
    assert len(got) == 502 and {r["_quality"] for r in got} == {"c"} and len(seen) == len(set(seen)) <= 3


def test_language_training_shuffles_no_text(spark):
    """Whatever size Spark takes the tables for: the sample is a filter over the scan, then grams."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    plan = sample_counts(rows.unionByName(rows).unionByName(rows), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_language_query_against_brute_force(spark):
    """Profiles and scores of the registered query's operator, from whole texts in plain dictionaries."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]

    def grams(text):
        found = collections.Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            cp = [0, *map(ord, word), 0]
            found.update(cp[1:-1])
            found.update((a << 21) | b for a, b in zip(cp, cp[1:], strict=False))
            found.update((a << 42) | (b << 21) | c for a, b, c in zip(cp, cp[1:], cp[2:], strict=False))
        return found

    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400]]
    total = collections.defaultdict(collections.Counter)
    for i, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            total[lang].update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(top(c))} for lang, c in total.items()}
    want = {}
    for i, text, _ in docs:
        mine = top(grams(text))
        far = {lang: sum(min(400, abs(p[g] - r)) if g in p else 400 for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[i] = (best, 1 - far[best] / (400 * len(mine))) if mine else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op9_language_id"](spark, DATA).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_language_with_many_languages(spark):
    rows = [(k, f"{chr(97 + k % 20) * 3} {chr(97 + k % 20)}{chr(98 + k % 20)} words", f"l{k % 20}", None, None) for k in range(400)]
    got = language_id(spark.createDataFrame(rows, DOC).withColumn("_lang_pred", F.lit(1))).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 20}" for r in got) > 380


def test_quality_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_quality_classifier"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in got) >= 0.9 * len(got) > 0


# ------------------------------------------------------------------------------------------------ language model


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check_counts(rows, got):
    train = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    left = collections.Counter()
    for i, t in rows:
        words = tokens(t)
        left[i, len(words), sum(train[w] > 0 for w in words), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), 6)] += 1
    for r in got:
        left[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)] -= 1
    assert not any(left.values()), [k for k, c in left.items() if c][:3]


def test_model_counts_and_edge_cases(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).select("doc_id", "text").collect()]
    got = lm.score_texts(odd_docs(spark)).collect()
    check_counts(rows, got)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_texts(odd_docs(spark).limit(0)).collect() == []


@pytest.mark.parametrize("block,part,shuffles", [(20_000, 100_000, 3), (60_000, 20_000, 11)])
def test_scores_do_not_depend_on_the_layout(spark, monkeypatch, block, part, shuffles):
    """Other blocks, parts (with restaurants dealt over parts), order of rows and shuffle counts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    whole = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_CHARS", block)
    monkeypatch.setattr(lm, "PART_CHARS", part)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        if part < 100_000:
            monkeypatch.setattr(lm, "HOT_PARTS", 0.5)
            chars = sum(len(t or "") for _, t in rows)
            assert len(lm.sampled_words(docs.select("doc_id", "text"), chars, chars // part).hot) > 0
        got = lm.score_texts(docs.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check_counts(rows, got)
    assert {r["doc_id"]: r["score"] for r in got} == {i: r["score"] for i, r in whole.items()}
    assert all(abs(r["base_score"] - whole[r["doc_id"]]["base_score"]) < 1e-8 for r in got)


def test_each_task_has_one_worker(spark, monkeypatch):
    """No stage has Python functions on both sides of a union, and no part of the plan has workers of another kind (Arrow):
    all these would stay beside the workers at work, with the memory they hold."""
    made, real = [], lm.sampled
    monkeypatch.setattr(lm, "sampled", lambda *given: made.append(real(*given)) or made[-1])
    monkeypatch.setattr(lm, "PART_CHARS", 100_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(type(docs), "mapInArrow", None)
    scored = lm.score_texts(docs)
    assert "InArrow" not in scored._jdf.queryExecution().toString()
    seen, stages = set(), [made[0][1]._jrdd.rdd()]
    while stages:
        workers, todo = set(), [stages.pop()]
        while todo:
            rdd = todo.pop()
            if rdd.getClass().getSimpleName() == "PythonRDD":
                workers.add(rdd.id())
            for k in range(rdd.dependencies().size()):
                before = rdd.dependencies().apply(k)
                if before.getClass().getSimpleName() != "ShuffleDependency":
                    todo.append(before.rdd())
                elif before.rdd().id() not in seen:
                    seen.add(before.rdd().id())
                    stages.append(before.rdd())
        assert len(workers) <= 1, rdd.toDebugString()
    assert len(seen) > 2 * (lm.BURN + lm.SAMPLES)


def plain_model(rows):
    """The model with one dish at a time in plain dictionaries: each row's score, and the probabilities after a context."""

    def joint(a, b):
        return int(lm.joint(np.array([a], np.uint64), np.array([b], np.uint64))[0])

    def seat(key, sweep, c, pull, d):
        tables, k = min(1, c), 1
        while 0 < k < c:
            step = 1 if k < 64 else k // 10
            new = pull / (pull + max(k - d * tables, 1e-9))
            tables += math.floor(min(step, c - k) * new + lm.drawn(np.array([key], np.uint64), sweep, k)[0])
            k += step
        return min(tables, c)

    def by(dishes, at):
        out = collections.Counter()
        for key, n in dishes.items():
            out[at(key)] += n
        return out

    def discount(counts):
        return lm.discount_of(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))

    texts, seen, counts = [], collections.Counter(), collections.Counter()
    for i, t in rows:
        words = lm.tokenize([t or ""])[0].tolist()
        padded = [int(lm.START)] * 2 + words
        texts.append([(padded[k], padded[k + 1], w) for k, w in enumerate(words)])
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            seen.update(texts[-1])
            counts.update(words)
    s0, s1, s2 = lm.STRENGTHS
    d2 = discount(seen)
    tables = dict.fromkeys(seen, 1)
    mid = by(tables, lambda k: k[1:])
    mid_tables = dict.fromkeys(mid, 1)
    root = by(mid_tables, lambda k: k[1])
    root_tables = dict.fromkeys(root, 1)
    samples = []
    for sweep in range(lm.BURN + lm.SAMPLES + 1):
        if sweep:
            told = {k: p2(*k) for k in mid}  # noqa: F821  of the state before
            pulls = {k: (s1 + d1 * two_tables[k[0]]) * p1(k[1]) for k in mid}  # noqa: F821
            tables = {k: seat(joint(joint(k[0], k[1]), k[2]), sweep, c, (s2 + d2 * u_tables[k[:2]]) * told[k[1:]], d2) for k, c in seen.items()}  # noqa: F821
            mid = by(tables, lambda k: k[1:])
            mid_tables = {k: seat(joint(*k), sweep, c, pulls[k], d1) for k, c in mid.items()}  # noqa: F821
            root = by(mid_tables, lambda k: k[1])
            root_tables = {w: seat(w, sweep, c, base, d0) for w, c in root.items()}  # noqa: F821
        d0, d1 = discount(root), discount(mid)
        base = (s0 + d0 * sum(root_tables.values())) / (len(counts) + 1)
        u_tables, u_customers = by(tables, lambda k: k[:2]), by(seen, lambda k: k[:2])
        two_tables, two_customers, all_root = by(mid_tables, lambda k: k[0]), by(mid, lambda k: k[0]), sum(root.values())

        def p1(w, root=root, root_tables=root_tables, base=base, d0=d0, all_root=all_root):
            return (max(root[w] - d0 * root_tables.get(w, 0), 0) + base) / (s0 + all_root)

        def p2(b, w, p1=p1, mid=mid, mid_tables=mid_tables, d1=d1, two_tables=two_tables, two_customers=two_customers):
            return (max(mid[b, w] - d1 * mid_tables.get((b, w), 0), 0) + (s1 + d1 * two_tables[b]) * p1(w)) / (s1 + two_customers[b])

        def p3(a, b, w, p2=p2, tables=tables, u_tables=u_tables):
            return (max(seen[a, b, w] - d2 * tables.get((a, b, w), 0), 0) + (s2 + d2 * u_tables[a, b]) * p2(b, w)) / (s2 + u_customers[a, b])

        if sweep > lm.BURN:
            samples.append(p3)

    def p(a, b, w):
        return sum(f(a, b, w) for f in samples) / len(samples)

    return [sum(math.log10(p(*k)) for k in t) for t in texts], p, list(counts), {k[:2] for t in texts for k in t}


def small_rows():
    rng = random.Random(4)
    words = [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(60)]
    return rows + [(100, "same again and again " * 80), (101, None), (102, ""), (None, "w1 w2 w3"), (103, rows[3][1]), (103, rows[3][1])]


def test_scores_against_plain_dictionaries(spark, monkeypatch):
    """Every score of the operator, in one part and in many, is that of a model with one dish at a time."""
    rows = small_rows()
    want = collections.Counter((i, round(x, 4)) for (i, _), x in zip(rows, plain_model(rows)[0], strict=True))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1 << 20, 300):
        monkeypatch.setattr(lm, "PART_CHARS", part)
        monkeypatch.setattr(lm, "BLOCK_CHARS", 4 * part)
        assert collections.Counter((r["doc_id"], round(r["score"], 4)) for r in lm.score_texts(frame).collect()) == want


def test_probabilities_sum_to_one():
    """Over the known words and the unknown one, after every context, in the model that the operator's scores equal."""
    _, p, known, contexts = plain_model(small_rows()[:25])
    for a, b in [*contexts, (5, 6)]:
        assert abs(sum(p(a, b, w) for w in [*known, 12345]) - 1) < 1e-9


def test_held_out_perplexity(spark):
    got = {r["held_out"]: r for r in lm.perplexity(QUERIES["op1_pitman_yor"](spark, DATA), "held_out").collect()}
    assert 1 < got[True]["perplexity"] < got[True]["base_perplexity"] and got[False]["perplexity"] < got[False]["base_perplexity"]


def test_repeated_documents_stand_out(spark):
    """Texts that occur twice in training are more probable per token than nearly all that occur once."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    times = collections.Counter(r["text"] for r in docs.collect())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = [r for r in QUERIES["op1_pitman_yor"](spark, DATA).collect() if not r["held_out"] and r["n_tokens"] > 30]
    once = sorted(r["score"] / r["n_tokens"] for r in got if times[text[r["doc_id"]]] == 1)
    twice = [r["score"] / r["n_tokens"] for r in got if times[text[r["doc_id"]]] == 2]
    assert len(twice) > 5 and sum(x > once[int(0.7 * len(once))] for x in twice) >= 0.9 * len(twice)


def test_seating():
    """Tables of a dish follow the Chinese-restaurant rule: their mean against the exact expectation."""
    c, pull, d = 12, 2.0, 0.5
    keys = np.arange(20_000, dtype=np.uint64)
    got = lm.seat(keys, 1, np.full(20_000, c), np.full(20_000, pull), d).mean()
    p = {1: 1.0}
    for k in range(1, c):
        new = collections.defaultdict(float)
        for t, w in p.items():
            q = pull / (pull + k - d * t)
            new[t + 1] += w * q
            new[t] += w * (1 - q)
        p = new
    assert abs(got - sum(t * w for t, w in p.items())) < 0.05
    assert lm.seat(keys[:3], 1, np.array([0, 1, 100_000]), np.full(3, pull), d).tolist()[:2] == [0, 1]


# ------------------------------------------------------------------------------------------------ n-gram join


def brute(rows):
    nodes = {}
    for i, t in rows:
        nodes.setdefault(tuple((t or "").lower().encode().split()), []).append(i)
    keys = list(nodes)
    sets = [{k[i : i + 5] for i in range(len(k) - 4)} for k in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least, want = {}, {}
    for k, key in enumerate(keys):
        known = [i for i in nodes[key] if i is not None]
        least[find(k)] = min([*known, *([least[find(k)]] if least.get(find(k)) is not None else [])], default=None)
    for k, key in enumerate(keys):
        for i in nodes[key]:
            want[i] = (least[find(k)], links[k], len(nodes[key]))
    return want


@pytest.mark.parametrize("block", [512, 4])
def test_join_against_brute_force(spark, block):
    """Near copies of a text, some linked only through others, with small blocks that families span."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(160)]
    rows = []
    for k in range(30):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"v{rng.randrange(3000)}" for _ in range(50))) for k in range(20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One  two"), (205, "a b c d e"), (206, "a b c d e f"), (3, rows[3][1]), (207, rows[3][1].upper()), (None, "null id here now yes"), (208, "long " * 40_000)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns({"node": F.lit(1), "root": F.lit("c"), "key": F.lit(2)})
    got = ngram_join.ngram_join(frame, block=block).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in got} == want


def test_join_ships_one_of_repeated_rows(spark, monkeypatch):
    """However often a row is there, its text goes to be compared once; links and copies are as ever."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(5, text)] * 200 + [(6, text)] * 3 + [(7, text + " more")] * 50 + [(None, text + " more")] + [(8, "another text that stands quite by itself here")]
    shipped = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda dealt, *a: (shipped.append(dealt.count()), verified(dealt, *a))[1])
    got = ngram_join.ngram_join(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(4)).collect()
    assert shipped == [2]
    assert {tuple(r) for r in got} == {(5, 5, 1, 203), (6, 5, 1, 203), (7, 5, 1, 51), (None, 5, 1, 51), (8, 8, 0, 1)} and len(got) == len(rows)


def test_join_empty(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], DOC)).collect() == []


def test_bands():
    n = ngram_join.bands_for()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** n >= ngram_join.RECALL > 1 - (1 - 0.8**ngram_join.ROWS) ** (n - 1)


def test_registered_join_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in QUERIES["op10_ngram_join"](spark, DATA).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [1 << 20, 1 << 62])
def test_numbers_are_sorted_with_their_places(most):
    """As np.unique and a stable sort give them, where a number and its place fit into 63 bits and where they don't."""
    rng = np.random.default_rng(5)
    for keys in (rng.integers(0, 1 << 20, 5000), rng.integers(0, 50, 5000).astype(np.uint32), np.zeros(0, np.int64), np.array([7])):
        order, rising = lm.ordered(keys, most)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and rising.tolist() == sorted(keys.tolist())
        for found, place in (lm.numbered(keys, most), lm.numbered_few(keys, 1 << 20), lm.numbered_words(keys.astype(np.uint64))):
            assert found.tolist() == sorted(set(keys.tolist())) and found[place].tolist() == keys.tolist()


def test_owners_share_all_totals_and_are_fewer_than_parts():
    """Each hash has one owner, owners stand in the order of hashes, and messages don't go from every part to every part."""
    assert lm.OWNED > 1
    lists = [np.unique(np.random.default_rng(k).integers(0, 1 << 64, 500 * k, np.uint64, endpoint=False)) for k in range(3)]
    dealt = lm.spread(lists, 7)
    assert [q for q, _ in dealt] == list(range(7))
    for k, x in enumerate(lists):
        assert np.concatenate([x[a:b] for a, b in (spans[k] for _, spans in dealt)]).tolist() == x.tolist()


def test_sums_travel_as_one_piece():
    lists = [np.arange(5), np.zeros(0, np.int64), np.array([(1 << 32) - 1], np.uint32), np.arange(3) * 1000]
    sizes, packed = lm.together(lists)
    assert isinstance(packed, bytes) and [x.tolist() for x in lm.apart((sizes, packed))] == [x.tolist() for x in lists]
    assert [x.tolist() for x in lm.apart(lm.together([np.zeros(0, np.int64)] * 2))] == [[], []]


def test_collecting_after_a_task_passes_over_imports():
    """A worker gives back its memory after each of hundreds of small tasks; its imports are looked through once."""
    gc.unfreeze()
    try:
        lm.give_back()
        assert gc.get_freeze_count() > 1000
        with_imports = gc.get_freeze_count()
        lm.give_back()
        assert gc.get_freeze_count() <= with_imports
    finally:
        gc.unfreeze()
