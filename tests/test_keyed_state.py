"""The keyed state against a dictionary: what is read, what is rewritten, and that no filter hides a key."""

import random

import pytest

from tallyfold.operators.keyed_state import KeyedState, Manifest

SCHEMA = "kind string, id string, v long, value string"


@pytest.fixture
def state(spark):
    return KeyedState(spark, ["kind", "id"], "v", SCHEMA, file_rows=100)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return {(r["kind"], r["id"]): (r["v"], r["value"]) for r in df.collect()}


def test_equals_a_dictionary(spark, state, tmp_path):
    rng = random.Random(3)
    want, manifest = {}, Manifest()
    for v in range(7):
        ids = rng.sample(range(2000), rng.choice([900, 40, 300, 1]))
        rows = [(rng.choice("ab"), f"{i:05d}", v, f"{v}-{i}") for i in ids]
        rows = list({r[:2]: r for r in rows}.values())
        asked = frame(spark, rows + [("c", "none", 0, ""), ("", "", 0, "")])
        assert held(state.lookup(manifest, asked)) == {k: want[k] for k in {r[:2] for r in rows} & set(want)}
        manifest = Manifest.from_json(state.append(manifest, frame(spark, rows), str(tmp_path / f"run{v}")).to_json())
        want |= {(k, i): (n, x) for k, i, n, x in rows}
        assert held(state.all(manifest)) == want
        sizes = [r.rows for r in manifest.runs]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert state.append(manifest, frame(spark, []), str(tmp_path / "none")) is manifest


def test_an_import_reads_and_writes_its_share(spark, state, tmp_path):
    """One in a hundred keys: those of a range, new ones within it, and ones spread over all of it."""
    base = [("a", f"{k:06d}", 1, "x") for k in range(0, 20_000, 2)]
    manifest = state.append(Manifest(), frame(spark, base), str(tmp_path / "base"))
    files = manifest.files()
    assert len(files) >= 80 and sum(f.rows for f in files) == len(base)
    near = frame(spark, [("a", f"{k:06d}", 2, "y") for k in range(4000, 4200, 2)])
    assert len(state.touched(manifest, near)) <= 4
    unknown = frame(spark, [("a", f"{k:06d}", 2, "y") for k in range(4001, 4201, 2)])
    assert sum(f.rows for f in state.touched(manifest, unknown)) <= 400  # by range two or three files; most of it by filter
    assert held(state.lookup(manifest, unknown)) == {}
    assert state.touched(manifest, frame(spark, [("b", "000100", 2, "y"), ("A", "1", 2, "y")])) == []
    after = state.append(manifest, near, str(tmp_path / "next"))
    assert after.runs[0].path == manifest.runs[0].path and after.runs[1].rows == 100  # the base is not rewritten
    assert held(state.lookup(after, near)) == {("a", f"{k:06d}"): (2, "y") for k in range(4000, 4200, 2)}


def test_filters_hide_no_key_and_most_others(spark, state, tmp_path):
    rows = [("k", f"id {k * 7919}", 1, "") for k in range(5000)]
    manifest = state.append(Manifest(), frame(spark, rows), str(tmp_path / "r"))
    for r in random.Random(1).sample(rows, 4):
        assert len(state.touched(manifest, frame(spark, [r]))) == 1
    others = [("k", f"id {k * 7919 + 1}", 1, "") for k in range(0, 5000, 500)]
    assert len(state.touched(manifest, frame(spark, others))) <= 2
