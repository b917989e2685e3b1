"""The pipeline's stages on a small fixture against what each must keep."""

import corpus_pipeline as cp
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9001, None, "en", "s1", 0), (9002, "", "en", "s1", 0), (9003, "12 34 !!", "en", "s1", 8), (9004, "LOUD!! WORDS!! AND!! MORE!! LOUD!! ONES!!", None, None, None)]
    first = docs.select("text").where("doc_id = 1").first()[0]
    odd += [(9005, first, "en", "s2", 1), (9006, first, "en", "s2", 1)]
    out = [docs.unionByName(spark.createDataFrame(odd, docs.schema))]
    for name, stage in cp.STAGES:
        out.append(cp.kept_table(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_rows(spark, stages):
    for df in stages[1:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))


def test_language_stage(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {9001, 9002, 9003}


def test_quality_stage(spark, stages):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = set(ids(stages[1])) - set(ids(stages[2]))
    good = [i for i, q in truth.items() if q == 1 and i in ids(stages[1])]
    assert sum(i in gone for i in good) <= 0.02 * len(good)
    assert all(truth.get(i, 0) == 0 for i in gone if i in truth)


def test_line_and_near_duplicate_stages(stages):
    texts = {r["doc_id"]: r for r in stages[3].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    shingle = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, r["text"].lower().split()) for i, r in texts.items())}
    kept = ids(stages[4])
    for a in kept:
        for b in kept:
            both = len(shingle[a] & shingle[b]) if a < b else 0
            assert not both or both < 0.8 * len(shingle[a] | shingle[b])
    for i in set(texts) - set(kept):
        assert any(i != j and (texts[i]["text"].split() == texts[j]["text"].split() or len(shingle[i] & shingle[j]) >= 0.8 * len(shingle[i] | shingle[j])) for j in texts)
    assert len({1, 9005, 9006} & set(kept)) == 1


def test_packing_stage(stages):
    assert set(ids(stages[5])) == set(ids(stages[4]))


def test_run_equals_stages(spark, stages):
    """The same documents, each with the same tokens, all of them packed."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = cp.kept_table(stage(spark, docs, DATA), f"test-run-{name}")
    got = cp.run(spark, DATA)
    packed = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").sum("length").collect())
    assert got.columns == stages[5].columns and packed(got) == packed(docs) and got.count() > 0
    assert all(tokens == length for _, tokens, length in packed(got))


def test_repeated_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(5)
    kept = cp.near_duplicate_stage(spark, docs.union(docs), DATA)
    assert len(ids(kept)) == len(set(ids(kept)))


def test_near_duplicates_under_repeated_ids(spark):
    """One id with two texts, each of which other rows have too: of each class one row is left."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(3, a), (3, b), (5, a), (5, b), (3, b), (None, a), (None, "none but this one here"), (7, None), (8, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicate_stage(spark, docs, DATA).collect()), key=repr)
    assert got == sorted([(3, a), (3, b), (None, "none but this one here"), (7, None)], key=repr)


NAMES = ("_lang_pred", "_lang_score", "_quality", "_n_lines", "_n_removed", "_kept", "_of_id", "_of_lines", "_keep_id", "_keep_place", "node", "place", "raw", "sig", "score")


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_long_and_clashing_input(spark, name, stage):
    """No rows at all; a very long text, nulls in every column, and columns of the very names that the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert stage(spark, spark.createDataFrame([], schema), DATA).collect() == []
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = [(None, None, None, None, None), (9100, "word " * 80_000, None, None, None), (9101, None, "en", "s", 1), (9100, "word " * 80_000, "en", "s", 1)]
    from pyspark.sql import functions as F

    frame = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({n: F.lit("mine") for n in NAMES})
    got = stage(spark, frame, DATA)
    rows = got.collect()
    if name == "packing":
        assert sum(r["length"] for r in rows if r["doc_id"] == 9100) == sum({r["doc_tokens"] for r in rows if r["doc_id"] == 9100}) * 2
    else:
        assert got.columns == frame.columns and all(r[n] == "mine" for r in rows for n in NAMES)


def test_workers_give_up_encoders(spark):
    """A worker that has encoded words holds none of them while it serves a stage that encodes nothing."""
    import sys

    import pyarrow as pa

    from tallyfold.llm.common import append_columns, chunk_encoder, tokenizer_path

    path = tokenizer_path()

    def encodes(batches):
        chunk_encoder(path).encode("some words")
        yield from batches

    def make():
        held = len(sys.__dict__.get("_tallyfold_encoders", {}))
        return lambda batch: [pa.array([held] * batch.num_rows, pa.int64())]

    one = spark.range(0, 1, 1, 1)
    assert one.mapInArrow(encodes, "id long").count() == 1
    assert [r["held"] for r in append_columns(one, "held long", make).collect()] == [0]
