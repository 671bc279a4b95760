"""Sharding, whitening and conversation repair against SQL and direct definitions."""

import hashlib
import heapq
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_compare import compare
from tillroll.llm import conversations, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_sharding_and_repair_match_oracle(spark):
    res = compare(spark, SF, ["op12_sharding", "op13_conversation_repair"], verbose=False)
    assert all(v["ok"] for v in res.values()), res


# --- sharding ----------------------------------------------------------------

def documents(spark, rows):
    """(doc_id, text) with columns that the result has, and one of the operator's own."""
    return spark.createDataFrame([(i, t, 7, "s", 1, 2) for i, t in rows],
                                 "doc_id long, text string, size int, shard string, _key int, _row int")


def slots_hold(found, shards):
    for s in range(shards):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_shards_of_hot_text_and_hot_row(spark):
    rng = random.Random(3)
    rows = [(i, "same text over and over") for i in range(2000)] + [(1, "one row")] * 2000
    rows += [(i, "x" * rng.randint(0, 60)) for i in range(2000)] + [(None, None)] * 50 + [(None, "")] * 50
    out = sharding.shard(documents(spark, rows), 10, ranges_per_shard=4, range_rows=150)
    assert out.columns == ["doc_id", "text", "_key", "_row", "size", "shard", "slot", "part"]
    found = out.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in found) == sorted((i or -1, t or "") for i, t in rows)
    assert all(r.size == len((r.text or "").encode()) + 16 for r in found)
    slots_hold(found, 10)
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)
    # No range holds much more than its rows, though two thirds of the rows have two texts.
    parts = [r.part for r in found]
    assert max(map(parts.count, set(parts))) <= 2 * 150


def test_shards_of_empty_tables_and_one_large_row(spark):
    assert sharding.shard(documents(spark, []), 5).collect() == []
    found = sharding.shard(documents(spark, [(1, "é" * 50_000), (2, "a"), (3, None)]), 4).collect()
    assert {r.doc_id: r.size for r in found} == {1: 100_016, 2: 17, 3: 16}
    slots_hold(found, 4)


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 6
    assert back.select(*docs.columns).exceptAll(docs).isEmpty()


def test_sharding_runs_without_python(spark):
    plan = queries()["op12_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- whitening ---------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, whitened double")


def test_whitening_against_eigenvalues(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(400, 9)) * [5, 3, 2, 1, 1, 1, .5, .3, .1]) @ rng.normal(size=(9, 9)) + 40
    rows = [*base.tolist(), *base[:1].tolist() * 300, None, [1.0] * 8 + [None], [float("nan")] * 9, [float("inf")] + [0.0] * 8]
    model = whitening.fit(vectors(spark, rows), components=None)
    x = np.unique(np.floor(256 * base), axis=0)
    v = np.cov(x.T, bias=True)
    values, columns = np.linalg.eigh(v)
    assert model.n == len(x) and model.sums == tuple(x.sum(0).astype(int))
    assert np.allclose(model.eigenvalues, values[::-1], rtol=1e-9)
    assert np.allclose(np.abs((model.components * columns.T[::-1]).sum(1)), 1, atol=1e-9)
    assert model.trace == pytest.approx(np.trace(v), rel=1e-12) and model.identity_error < 1e-9
    out = whitening.whiten(vectors(spark, rows), model)
    found = out.collect()
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"] and len(found) == 700
    for r in found[::97]:
        own = [int(t) for t in np.floor(256 * np.array(r.embedding))]
        assert int(r.deviation) == sum((model.n * a - s) ** 2 for a, s in zip(own, model.sums))
        direct = model.components @ (own - x.mean(0)) / np.sqrt(model.eigenvalues)
        assert np.allclose(r.whitened, direct, atol=1e-6)


def test_whitening_keeps_small_eigenvalues_to_full_relative_accuracy():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    scales = 10.0 ** -np.arange(0, 12, 1)
    factor = whitening.pivoted_cholesky(np.diag(scales))
    assert factor.shape == (12, 12)
    values, _ = whitening.one_sided_jacobi(q @ np.diag(np.sqrt(scales)))
    assert np.allclose(values, scales, rtol=1e-7)
    v = (q * scales) @ q.T
    low = whitening.pivoted_cholesky((v + v.T) / 2)
    assert np.abs(low @ low.T - v).max() < 1e-12


def test_whitening_of_few_wide_and_odd_vectors(spark):
    none = whitening.fit(vectors(spark, [None, [None]]))
    assert none.n == 0 and whitening.whiten(vectors(spark, [None, [None]]), none).collect() == []
    one = whitening.fit(vectors(spark, [[1.0, 2.0]] * 3))
    assert one.n == 1 and [r.whitened for r in whitening.whiten(vectors(spark, [[1.0, 2.0]] * 3), one).collect()] == [[]] * 3
    # Two directions only; one row of another length, which no model of two entries projects.
    rows = [[0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1.0, 0.0, 1.0], [5.0]]
    model = whitening.fit(vectors(spark, rows))
    assert model.dimension == 3 and len(model.eigenvalues) == 2 and model.identity_error < 1e-9
    assert sorted(r.vec_id for r in whitening.whiten(vectors(spark, rows), model).collect()) == [0, 1, 2, 3]
    # Entries of more than 20 bits, and beyond 63.
    big = [[1e12, 3.0], [-1e12, 7.0], [5e11, -2.0], [1e300, 0.0]]
    model = whitening.fit(vectors(spark, big))
    x = [[int(256e12), 768], [-int(256e12), 1792], [int(128e12), -512], [2**63 - 1, 0]]
    assert model.sums == tuple(map(sum, zip(*x)))
    for r in whitening.whiten(vectors(spark, big), model).collect():
        exact = sum((4 * a - s) ** 2 for a, s in zip(x[r.vec_id], model.sums))
        assert (int(r.deviation) == exact) if exact < 10**38 else r.deviation is None


def test_whitening_query_has_four_components_a_row(spark):
    found = queries()["op11_whitening"](spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    assert len(rows) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert {r.component for r in rows} == {1, 2, 3, 4} and all(r.identity_error < 1e-9 for r in rows)


# --- conversation repair -----------------------------------------------------

def cheapest(letters):
    """Least (cost, edits) by trying paths in that order."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, edits, i, node = heapq.heappop(heap)
        if (i, node) in done:
            continue
        done.add((i, node))
        if i == len(letters) and node in (0, 3):
            return cost, edits
        following = 3 if node == 2 else 2
        heapq.heappush(heap, (cost + 2, edits + "I", i, following))
        if i < len(letters):
            letter, more = letters[i], int(letters[i].isupper())
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, node))
            if letter != "d":
                heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, following))
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(letter.lower(), {}).get(node)
                if kept is not None:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, kept))


def test_auction_against_all_paths():
    rng = random.Random(5)
    for _ in range(1500):
        letters = "".join(rng.choice("suaoSUAOduauaua") for _ in range(rng.randint(0, 45)))
        assert conversations.best_edits(letters) == cheapest(letters), letters
    for letters in ("", "d" * 40, "u" * 33, "a" * 33, "s" * 20, "o" * 20, "sua" * 15, "ua" * 30, "U" * 17 + "A" * 17):
        assert conversations.best_edits(letters) == cheapest(letters), letters


def test_prices_stay_feasible_and_expose_a_tight_path():
    prices, traces = conversations.solve("suauuaadua")
    assert prices[0] == cheapest("suauuaadua")[0]
    # The costs between nodes of a run add up over any cut of it.
    for cut in range(1, 9):
        ends, _ = conversations.solve("suauuaadua"[cut:])
        assert conversations.solve("suauuaadua"[:cut], ends)[0] == prices


def report_of(rows):
    """The digest of one conversation's (turn, role, text) by its definition."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, out = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        initial, shown = (role[:1] if role[:1] in ("s", "u", "a") else "o"), text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        letters += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    out["illegal"] = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    out["cost"], out["audit"] = cheapest(letters)
    node, lines, left = 0, [], iter(rows)
    for edit in out["audit"]:
        following = 3 if node == 2 else 2
        name = {2: "user", 3: "assistant"}[following]
        if edit == "I":
            lines.append(f"{name}:")
            node = following
            continue
        _, role, text = next(left)
        if edit == "R":
            lines.append(f"{name}:{text}")
            node = following
        elif edit == "K":
            lines.append(f"{role}:{text}")
            node = {"s": 1, "u": 2, "a": 3}[role[0]]
    out["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    turns = {t for t, _, _ in rows if t is not None}
    out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return out


def talk(spark, rows):
    return spark.createDataFrame([(*r, "z", 9) for r in rows], "conv_id long, turn long, role string, text string, edit string, segment int")


def random_talk(seed, conv, n):
    rng = random.Random(seed)
    texts = ["All good.", "Why?", "cut off", "", " \t\n", "Stop!", None, "x " * 30 + "."]
    rows = []
    for i in range(n):
        if rng.random() < 0.2:
            turn = rng.choice([None, *range(n)]) if rng.random() < 0.3 else i
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
        else:
            rows.append((conv, i, ("user", "assistant")[i % 2], f"Line {i}{rng.choice(['.', '', '?'])}"))
    return rows


def fixture():
    rows = [r for c, n in ((1, 1), (2, 3), (3, 9), (4, 60), (5, 200), (None, 25)) for r in random_talk(c or 0, c, n)]
    rows += [(6, 0, "user", "Hi."), (6, 0, "user", "Hi."), (6, 1, "assistant", "Yes.")] * 20  # repeated rows
    rows += [(7, None, "user", "No turn."), (7, None, None, None), (8, 5, "user", "y" * 200_000 + "."), (8, 9, "assistant", "Fine.")]
    return rows


@pytest.mark.parametrize("bits", [2, 4, 12])
def test_repair_against_definition(spark, bits):
    """Segments of four and sixteen places cut all longer conversations."""
    rows = fixture()
    _, found, report = conversations.repair(talk(spark, rows), segment_bits=bits)
    got = {r.conv_id: r.asDict() for r in report.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = report_of([r[1:] for r in rows if r[0] == conv])
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == want, conv
    if bits == 2:
        assert found.where("conv_id = 5").count() > 20


def test_repaired_rows_keep_to_the_pattern(spark):
    rows, found, report = conversations.repair(talk(spark, fixture()), segment_bits=3)
    whole = conversations.repaired_rows(rows, found, 3, whole=True).collect()
    parted = conversations.repaired_rows(rows, found, 3).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parted))
    for conv in {r.conv_id for r in whole}:
        roles = "".join(r.role[0] for r in whole if r.conv_id == conv)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)
        text = "\n".join(f"{r.role}:{r.text}" for r in whole if r.conv_id == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == report.where(F.col("conv_id").eqNullSafe(F.lit(conv))).first().repaired_sha256


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    none = talk(spark, []).where("false")
    _, _, report = conversations.repair(none)
    assert report.collect() == [] and conversations.completed(report, none).collect() == []
    ids = talk(spark, [(1, 0, "user", "Hi."), (None, 0, "user", "Hi.")])
    done = conversations.completed(report, ids).collect()
    assert {r.conv_id for r in done} == {1, None}
    assert all((r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) for r in done)
