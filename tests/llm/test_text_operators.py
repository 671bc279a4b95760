"""The text operators against brute force, on small fixtures and the smallest tables."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from oracle_compare import compare
from tillroll.llm import (decontaminate, fingerprint, jaccard_join, language, license_scan, packing, passages, quality,
                          token_count, url_reputation)
from tillroll.llm.components import connected_components
from tillroll.llm.queries import URL_RULES, vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

_RNG = random.Random(7)
WORDS = ["".join(_RNG.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """(doc_id, text, ...) with nulls, and columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, id long, token string, n long")


EDGE = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (4, "one"), (None, "two words"), (5, prose(1, 30_000)), (6, prose(2, 80)), (7, prose(2, 80))]

OPERATORS = {
    "fingerprint": lambda d: fingerprint.fingerprint_neighbours(d),
    "license": lambda d: license_scan.scan_licenses(d),
    "jaccard": lambda d: jaccard_join.similar_components(d),
    "tokens": lambda d: token_count.count_tokens(d, vocabulary("piece_bpe_32k.model")),
    "quality": lambda d: quality.rate(d, quality.fit(d, d.sparkSession.createDataFrame([], "doc_id long, grade int"), 3)),
    "language": lambda d: language.identify(d, language.learn(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row_on_odd_tables(spark, name):
    rows = OPERATORS[name](table(spark, EDGE)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in EDGE), key=str)
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_packing_and_pairs_on_odd_tables(spark):
    d = table(spark, EDGE)
    ids = {r.doc_id for r in packing.pack(d, vocabulary("word_bpe_49k.json"), 1).collect()}
    assert ids == {i for i, _ in EDGE}
    assert packing.pack(table(spark, []), vocabulary("word_bpe_49k.json"), 1).count() == 0
    found = passages.repeated_passages(d).collect()
    assert [(r.doc_id, r.first_id, r.n_words) for r in found] == [(7, 6, 80)]
    assert passages.repeated_passages(table(spark, [])).count() == 0
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "item_id long, text string")
    assert decontaminate.leaks(d, items).count() == 0
    assert decontaminate.leaks(table(spark, []), items.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = {i: i for i in range(60)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in links if a != b for i in (a, b)}


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = prose(100 + g, 120).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows) * 3, " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    rows += [(500, "a b"), (501, "A  b"), (502, "a"), (503, None), (504, "a b c")]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(table(spark, rows)).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_compact_windows_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, width = int(rng.integers(1, 100)), int(rng.integers(1, 10))
        values, row = rng.integers(0, 50, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        h = [(int(x) >> 20, i) for i, x in enumerate(passages.seeded(values, 5) | np.uint64(1 << 63))]
        expected = set()
        for i in range(n):
            a = b = i
            while a > 0 and row[a - 1] == row[i] and h[a - 1] > h[i]:
                a -= 1
            while b < n - 1 and row[b + 1] == row[i] and h[b + 1] > h[i]:
                b += 1
            if b - a + 1 >= width:
                expected.add((a, i, b))
        got = passages.compact_windows(values, row, width, 5)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == expected


def test_ranges_of_many_texts_against_definition():
    """Ranges that windows of several functions cover, of all texts at once."""
    rng = np.random.default_rng(2)
    for _ in range(100):
        row, windows, row_out, out = [], [], [], []
        expected = {"covered": [], "uncovered": [], "unrepeated": []}
        for r in range(int(rng.integers(1, 5))):
            own = [(int(a), int(a + n), int(f)) for a, n, f in zip(rng.integers(0, 60, 40), rng.integers(0, 30, 40), rng.integers(0, 8, 40))]
            known = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, r), rng.integers(0, 20, r))]
            row, windows = row + [r] * len(own), windows + own
            row_out, out = row_out + [r] * len(known), out + known

            def ranges(inside, r=r):
                edges = [i for i in range(101) if inside(i) != inside(i - 1)]
                return [(r, a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]

            def functions(i, last, own=own):
                return len({f for a, b, f in own if a <= i and last <= b})

            def free(i, last, known=known):
                return not any(a <= i and last <= b for a, b in known)

            expected["covered"] += ranges(lambda i: functions(i, i) >= passages.AGREE)
            expected["uncovered"] += [x for x in ranges(lambda i: functions(i, i) >= passages.AGREE and free(i, i)) if x[2] - x[1] + 1 >= 6]
            expected["unrepeated"] += ranges(lambda i: functions(i, i + 5) == passages.HASHES and free(i, i + 5))
        row, windows = np.array(row), np.array(windows)
        row_out, out = np.array(row_out, np.int64), np.array(out, np.int64).reshape(-1, 2)
        got = {"covered": passages.covered(row, windows, passages.AGREE), "uncovered": passages.uncovered(row, windows, row_out, out, 6),
               "unrepeated": passages.unrepeated(row, windows, row_out, out, 6)}
        assert {k: list(zip(*(x.tolist() for x in v), strict=True)) for k, v in got.items()} == expected


def test_windows_join_the_first_text_in_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice([None, *range(20)]), i) for i in range(300)]
    rows = [r for r in rows if r[1] is not None]
    met = passages._met(spark.createDataFrame(rows, "key long, id long, w long"))
    expected = {}
    for key, i, w in rows:
        first = min(j for k, j, _ in rows if k == key)
        if first < i:
            expected.setdefault((i, first), []).append(w)
    assert {(r.id, r.first): sorted(r.windows) for r in met.collect()} == expected
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan


def test_windows_of_a_line_over_and_over_are_one_a_function():
    texts = [" ".join(["over"] * 400), f"{prose(1, 60)} {prose(2, 9)} " + " ".join([prose(3, 12)] * 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(texts)], ["id", "text"])
    for _, key, ids, left, _, right, outer in passages._windows(batch, 40):
        seven = ids == 7
        assert seven.sum() > 300 and (outer[seven] < 0).sum() == 1
        windows = list(zip(ids.tolist(), key.tolist(), left.tolist(), right.tolist(), strict=True))
        kept = [w for w, o in zip(windows, outer.tolist(), strict=True) if o < 0]
        for i, k, a, b in windows:
            assert any((i, k) == (j, m) and c <= a and b <= d for j, m, c, d in kept)


def test_a_text_in_several_pairs_is_compared_as_alone():
    texts = [prose(21, 90), f"{prose(22, 30)} é {prose(21, 90)}", prose(23, 120), ""]
    own, other = [0, 1, 1, 2, 1, 3], [1, 0, 2, 1, 0, 0]
    window = passages.packed(np.zeros(3, np.int64), np.full(3, 84), np.arange(3))

    def compare(a, b):
        return passages._compare(pa.array([texts[i] for i in a]), pa.array([texts[i] for i in b]), pa.array([window] * len(a)), 46, 0.8).to_pylist()

    got = compare(own, other)
    assert got == [compare([a], [b])[0] for a, b in zip(own, other, strict=True)]
    assert [len(x) for x in got] == [1, 1, 0, 0, 1, 0]
    at = got[1][0]
    assert texts[1][at["start"]:at["end"]] == " ".join(texts[0].split()[:at["n_words"]]) and at["n_words"] >= 50


def test_repeated_passages_leave_the_first(spark):
    shared = prose(50, 70)
    changed = shared.split()
    changed[30] = "changed"
    rows = [(i, f"{prose(60 + i, 90)}\n{shared if i != 3 else ' '.join(changed)}\n{prose(160 + i, 40)}") for i in range(1, 5)]
    rows.append((9, prose(999, 200)))
    docs = table(spark, rows)
    found = passages.repeated_passages(docs)
    assert sorted((r.doc_id, r.first_id) for r in found.collect()) == [(2, 1), (3, 1), (4, 1)]
    left = {r.doc_id: r.text for r in passages.without_repeats(docs, found).collect()}
    assert left[1] == rows[0][1] and left[9] == rows[4][1]
    for i in (2, 3, 4):
        assert left[i].split() == (prose(60 + i, 90) + " " + prose(160 + i, 40)).split()
    assert passages.without_repeats(docs, found).columns == docs.columns


def test_exact_repeats_beside_a_part_of_the_passage(spark):
    rows = []
    for g in range(40):
        passage = prose(3000 + g, 55)
        part = " ".join(passage.split()[:40])
        for j, body in enumerate((part, passage, passage)):
            rows.append((3 * g + j, f"{prose(4000 + 3 * g + j, 30)} é {body} {prose(5000 + 3 * g + j, 30)}"))
    found = passages.repeated_passages(table(spark, rows)).collect()
    texts = dict(rows)
    for g in range(40):
        spans = [range(r.start, r.end) for r in found if r.doc_id == 3 * g + 2]
        at = texts[3 * g + 2].index(prose(3000 + g, 55))
        assert set(range(at, at + len(prose(3000 + g, 55)))) <= set().union(*spans)
    assert {(r.doc_id, r.first_id) for r in found} == {(3 * g + 2, 3 * g + 1) for g in range(40)}


def test_near_repeats_beside_a_part_of_the_passage(spark):
    """Third texts with one word changed, where the first text has 44 words of 60."""
    rows, groups = [], 60
    for g in range(groups):
        passage = prose(6000 + g, 60)
        changed = passage.split()
        changed[25 + g % 10] = "changed"
        for j, body in enumerate((" ".join(passage.split()[:44]), passage, " ".join(changed))):
            rows.append((3 * g + j, f"{prose(7000 + 3 * g + j, 30)} {body} {prose(8000 + 3 * g + j, 30)}"))
    found = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.first_id) for r in found} <= {(3 * g + 2, 3 * g + 1) for g in range(groups)}
    assert len({r.doc_id for r in found}) >= 0.95 * groups


def test_run_hashes_against_definition():
    values = np.array([random.Random(i % 60).getrandbits(64) for i in range(200)], np.uint64)
    for length in (1, 6, 46, 201):
        runs = [tuple(values[i:i + length].tolist()) for i in range(200 - length + 1)]
        h = passages.run_hashes(values, length).tolist()
        assert len(h) == len(runs) and len(set(h)) == len(set(runs)) == len(set(zip(h, runs, strict=True)))


def test_leaks_verbatim_template_and_slots(spark):
    question = ("Here Anna has 12 kg apples and Boris eats 3 of them then Anna buys 12 more pears while Boris "
                "sells 5 plums so how many kg does Anna keep")
    other = question.replace("Anna", "Maria").replace("12", "45").replace(" 5 ", " 7,500 ")
    torn = question.replace("has 12", "has 45").replace("then Anna", "then Maria").replace("buys 12", "buys 99").replace("while Boris", "while Igor").replace("so how many", "but how much")
    rows = [(1, prose(1, 60) + ". " + question), (2, prose(2, 60) + ". " + question.upper() + " " + prose(5, 20)),
            (3, prose(3, 60) + ". " + other), (4, prose(4, 60) + ". " + torn), (5, prose(6, 200)), (6, None)]
    items = spark.createDataFrame([(10, question), (11, "too short"), (12, prose(77, 40))], "item_id long, text string")
    found = decontaminate.leaks(table(spark, rows), items).collect()
    by = {(r.doc_id, r.form): r for r in found}
    assert {i for i, _ in by} == {1, 2, 3} and {r.item_id for r in found} == {10}
    assert by[1, "verbatim"].covered == by[1, "verbatim"].item_tokens
    assert "12 -> 45" in by[3, "template"].slots and "anna -> maria" in by[3, "template"].slots
    assert (3, "verbatim") not in by
    kept = decontaminate.without_leaks(table(spark, rows), decontaminate.leaks(table(spark, rows), items))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6]


def test_leaks_with_slots_that_contradict_each_other(spark):
    """A name replaced by one name in the first run and by another in the second."""
    item = "Anna walks slowly along the very long river with her old dog every single morning and then Anna reads the whole paper before work starts"
    torn = item.replace("with her old", "with his young").replace("Anna walks", "Maria walks").replace("then Anna", "then Boris")
    kept = item.replace("with her old", "with his young").replace("Anna", "Maria")
    rows = [(1, "Once " + torn + " " + prose(1, 30)), (2, "Once " + kept + " " + prose(2, 30))]
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.leaks(table(spark, rows), items).collect() if r.form == "template"}
    # The second text fills the slot alike in both runs, the first does not.
    assert found[2].slots == "anna -> maria" and found[2].covered > found[2].longest_run
    assert 1 not in found or (found[1].covered == found[1].longest_run and "; " not in found[1].slots)


def test_leaks_of_slot_heavy_and_very_short_items(spark):
    heavy = "12 kg 7 km 3 apples 5 kg 9 km 2 apples 8 kg 14 km 6 apples"
    other = "10 kg 21 km 30 apples 51 kg 90 km 22 apples 80 kg 41 km 60 apples"
    rows = [(1, prose(1, 40) + ". " + other), (2, "Not  SURE, yet"), (3, "Not sure, yet " + prose(2, 10)), (4, "yes"), (5, "No."), (6, None), (7, "")]
    items = spark.createDataFrame([(10, heavy), (11, "not sure yet"), (12, "Yes!"), (13, ""), (14, None)], "item_id long, text string")
    found = decontaminate.leaks(table(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id, r.form) for r in found} == {(1, 10, "template"), (2, 11, "verbatim"), (4, 12, "verbatim")}


def test_template_windows_against_definition():
    """Hashes of all windows, both forms and all readings, against windows made one by one."""
    text = "Tom has 5 kg. Sara gave Ben 3 more and then Rex ate 2 of the 17 red plums. Ann left"
    data = np.frombuffer(text.encode(), np.uint8)
    row, start, end, h, slot, either = decontaminate.canonical(data, np.array([0, len(data)]))
    for k in (5, 7, 8):
        ok = np.ones(len(h) - k + 1, bool)
        got = sorted((form, int(at), int(v)) for form, places, values, _ in decontaminate._forms(h, slot, either, ok, k) for at, v in zip(places, values))
        want = []
        for i in range(len(ok)):
            want.append(("verbatim", i, int(decontaminate._hashes(h[None, i:i + k])[0])))
            maybe = [j for j in range(i, i + k) if either[j]]
            for n in range(1 << len(maybe)):
                s = slot.copy()
                for b, j in enumerate(maybe):
                    s[j] = decontaminate.NAME if n >> b & 1 else s[j]
                own = s[i:i + k]
                least = decontaminate.LITERALS if k == decontaminate.WINDOW else min(decontaminate.SHORT_LITERALS, k - 1)
                if least <= (own == 0).sum() < k:
                    values = decontaminate._typed(h[i:i + k], own)
                    want.append(("template", i, int(decontaminate.seeded(decontaminate._hashes(values[None]), 12)[0])))
        assert got == sorted(want)


def test_leaks_of_numbers_and_names_verbatim(spark):
    sums = "12 15 27 9 8 17 100 250 350 41 42 83 7 6 13 90"
    short = "5 kg 10 kg 15 kg"
    rows = [(1, prose(1, 40) + ". " + sums), (2, prose(2, 40) + ". " + short + " " + prose(3, 10)), (3, prose(4, 60) + " 12 15 27 9 8 17 100 1")]
    items = spark.createDataFrame([(10, sums), (11, short)], "item_id long, text string")
    found = decontaminate.leaks(table(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id, r.form, r.covered) for r in found} == {(1, 10, "verbatim", 16), (2, 11, "verbatim", 6)}


def test_leaks_with_names_at_sentence_starts(spark):
    question = "Tom has 5 apples. Sara gives him 3 more. Tom eats 2 of them. How many apples does Tom have left?"
    other = question.replace("Tom", "Élise").replace("Sara", "Zoé").replace("5", "8").replace("3", "6")
    torn = other.replace("Élise eats", "Paul eats").replace("does Élise", "does Anton")
    rows = [(1, prose(1, 40) + ". " + other), (2, prose(2, 40) + ". " + torn), (3, prose(3, 80)),
            (4, prose(4, 40) + ", " + other.replace("Zoé", "then Zoé").replace("then ", "", 1))]
    items = spark.createDataFrame([(10, question)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.leaks(table(spark, rows), items).collect()}
    assert sorted(found) == [1, 4] and found[1].covered == found[1].item_tokens == 21
    assert "tom -> Élise" in found[1].slots and "sara -> zoé" in found[1].slots


def test_fingerprints_against_definition(spark):
    texts = {1: "abcdefgh", 4: None, 7: "añb" * 50, 9: "añb" * 50, 12: "x", 20: prose(1, 300)}
    order = sorted(texts)
    rows = {r.doc_id: r for r in fingerprint.fingerprint_neighbours(table(spark, texts.items()).repartition(3)).collect()}
    for i, doc in enumerate(order):
        own, nxt = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(own) // 4
        edited = own[:len(own) - cut] + nxt[:cut]
        r = rows[doc]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        plain = fingerprint.fingerprint(fingerprint.prefix_array(fingerprint.code_points(edited)))
        assert r.edited_fingerprint == plain
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[7].fingerprint == rows[9].fingerprint and rows[7].near_next == 1.0
    assert rows[20].near_edited > 0.6


def test_spans_and_extensions():
    rng = random.Random(4)
    s, t = ("".join(rng.choice("ab") for _ in range(200)) for _ in range(2))
    a, b = (fingerprint.prefix_array(fingerprint.code_points(x)) for x in (s, t))
    for _ in range(300):
        i, j, n = rng.randrange(200), rng.randrange(200), rng.randrange(12)
        inside = i + n <= 200 and j + n <= 200
        assert fingerprint.same_span(a, i, b, j, n) == (inside and s[i:i + n] == t[j:j + n] or n == 0)
        longest = 0
        while i + longest < 200 and j + longest < 200 and s[i + longest] == t[j + longest]:
            longest += 1
        assert fingerprint.common_extension(a, i, b, j) == longest


def test_url_parts_and_odd_pages(spark):
    urls = ["http://A.Example.org/es/x?q#f", "https://com/de/", "//x", None, "x://h", "ftp://u.net:80?p", "http://notorg/", "http://b.org"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, good int")
    rows = {r.page_id: r for r in url_reputation.judge_urls(pages, URL_RULES).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("com", "/de/", "com/de/"), ("", "", None), ("", "", None),
        ("h", "", None), ("u.net:80", "", None), ("notorg", "/", None), ("b.org", "", None)]
    assert rows[0].verdict == rows[1].verdict == "block"
    assert url_reputation.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_reputation_blocks_a_bad_host(spark):
    seen = spark.createDataFrame([("bad.shop.net", 0, 60), ("good.shop.net", 60, 0), ("new.shop.net", 0, 1), ("a.co.uk", 9, 1)],
                                 "host string, good long, bad long")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.shop.net", "good.shop.net", "x.shop.net", "q.a.co.uk"])],
                                  "page_id long, url string")
    verdicts = [r.verdict for r in url_reputation.judge_urls(pages, [], seen).orderBy("page_id").collect()]
    assert verdicts == ["block", "allow", "allow", "allow"]


def test_sql_queries_match_oracle(spark):
    res = compare(spark, SF, ["op3_url_filter", "op4_license_scan"], verbose=False)
    assert all(r["ok"] for r in res.values()), res


def test_license_near_and_far(spark):
    rows = [(1, "text\nReleased under  the MIT licence (MIT License).\nend"), (2, "LICENSED under the apache license; version 2.0"),
            (3, "the MIT License"), (4, None)]
    got = {r.doc_id: (r.license, r.dice) for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got[2] == ("Apache-2.0", 1.0) and got[3] == (None, None) and got[4] == (None, None)


def license_by_definition(text, threshold=0.8):
    """Every unit and every window against every template, without bounds."""
    def split_words(t):
        return license_scan.template_words(t)

    def grams(words):
        return {f"{a} {b}" for a, b in zip(words, words[1:])}

    text = text or ""
    whole = split_words(text)
    units = [grams(split_words(u)) for u in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]]
    hits = []
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            own, k = grams(split_words(t)), len(split_words(t))
            pieces = units + [grams(whole[i:i + k]) for i in range(len(whole) - 1) if " ".join(whole[i:i + 2]) in own]
            best = max((2 * len(own & p) / (len(own) + len(p)) for p in pieces), default=0)
            if best >= threshold:
                hits.append((-best, name))
    best = min(hits, default=(None, None))
    return best[1], None if best[0] is None else round(-best[0], 6), len(hits)


def test_licenses_against_definition(spark):
    rng = random.Random(11)
    listed = [(name, t) for name, texts in license_scan.TEMPLATES.items() for t in texts]
    rows, names = list(EDGE), {}
    for i, (name, t) in enumerate(listed):
        words = t.split()
        changed = [w if rng.random() > 0.04 else "other" for w in words]
        broken = "".join(w + rng.choice([" ", " ", "\n"]) for w in words)
        rows += [(100 + 4 * i, t), (101 + 4 * i, f"{prose(i, 40)} {t} {prose(i + 500, 40)}"),
                 (102 + 4 * i, f"{prose(i, 9)}\n\n{' '.join(changed)}\n{prose(i, 7)}"), (103 + 4 * i, broken)]
        names |= {100 + 4 * i: name, 101 + 4 * i: name, 103 + 4 * i: name}
    rows += [(1000, " ".join([listed[0][1]] * 30)), (1001, "of the " * 5000)]
    found = sorted((r.doc_id or -1, r.license, r.dice, r.n_matches) for r in license_scan.scan_licenses(table(spark, rows)).collect())
    assert found == sorted((i or -1, *license_by_definition(t)) for i, t in rows)
    by_id = {r[0]: r for r in found}
    assert {i: by_id[i][1] for i in names} == names


def test_gnu_versions_and_long_lines(spark):
    v2 = license_scan.TEMPLATES["GPL-2.0"][2]
    rows = [(1, v2), (2, f"/* foo.c: {v2} */ int main"), (3, f"{prose(1, 8)} released under the MIT license. {prose(2, 8)}")]
    got = {r.doc_id: r.license for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: "GPL-2.0", 2: "GPL-2.0", 3: "MIT"}


def test_count_only_viterbi_against_all_segmentations():
    automaton, unknown, byte_pieces = token_count._vocabulary(vocabulary("piece_bpe_32k.model"))

    def all_ways(part):
        if not part:
            return [(0.0, 0, ())]
        out = []
        for n in range(1, len(part) + 1):
            piece = part[:n]
            if piece in automaton:
                step = [(automaton.get(piece)[1], 1)]
            elif n == 1:
                step = [(unknown, len(piece.encode()))]
            else:
                continue
            out += [(s + v, c + k, (n, *rest)) for s, k in step for v, c, rest in all_ways(part[n:])]
        return out

    for part in ("▁the", "▁ab☃c", "▁hello", "▁▁x", "日本", "▁aaaa", "<0x41>"):
        ways = all_ways(part)
        score = max(w[0] for w in ways)
        got = token_count.best_segmentation(part, automaton, unknown, byte_pieces)
        assert got[0] == score and got[1] in {w[1] for w in ways if w[0] == score}


def test_ordinal_regression_separates_grades():
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 3, 600)
    f = np.concatenate([np.unique([g * 10 + rng.integers(0, 2), 100 + rng.integers(0, 30)]) for g in grade]).astype(np.int32)
    off = np.arange(0, 2 * len(grade) + 1, 2)
    known, w, t = quality.fit_ordinal(f, off, grade, 3)
    assert (np.diff(t) > 0).all()
    at = np.searchsorted(known, f) % len(known)
    score = np.where(known[at] == f, w[at], 0).reshape(-1, 2).sum(axis=1)
    assert ((score[:, None] > t).sum(axis=1) == grade).mean() > 0.97


def test_quality_on_held_out_rows(spark):
    from pyspark.sql import functions as F
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    grades = quality.grades_of_labels(labels)
    even = F.expr("doc_id % 2 = 0")
    rated = quality.rate(docs.where(~even), quality.fit(docs, grades.where(even), 3)).join(grades, "doc_id")
    n = {(r.grade, r.selected): r["count"] for r in rated.groupBy("grade", "selected").count().collect()}
    assert n[2, True] > 0.97 * (n[2, True] + n.get((2, False), 0))
    assert n[0, False] > 0.97 * (n[0, False] + n.get((0, True), 0))
    assert n[1, False] > 0.5 * (n[1, False] + n.get((1, True), 0))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(10_000, None), (10_001, "it's <|endoftext|> İ ñandú!!'s"), (10_002, prose(3, 9000))], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs.repartition(20), path, 1).collect()
    encoder = Tokenizer.from_file(path)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = np.array([*encoder.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert max(lengths) <= 2048 and padding < 0.02 * sum(lengths)


def test_ids_of_every_vocabulary(spark):
    from tokenizers import Tokenizer
    texts = ["Plain words, it's 5 o'clock!! And\tmore\n\nlines", "", None, "ñandú İstanbul ½ ² Ⅷ\u00a0x\u2028y", "e\u0301 a <|endoftext|> b <|ENDOFTEXT|>",
             " " * 50, "x" * 30_000 + " end", prose(1, 5000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary(name)
        encoder, known = Tokenizer.from_file(path), packing._Ids(path)
        assert known.by_parts == (name == "word_bpe_49k.json")
        for _ in range(2):  # learned, then known
            got = [x.tolist() for x in known.of(pa.array(texts))]
            assert got == [encoder.encode(t or "", add_special_tokens=False).ids for t in texts]
        known.forget()
        assert [x.tolist() for x in known.of(pa.array(texts[::-1]))] == got[::-1]


def test_und_is_for_texts_without_letters(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ² 3", "Ⅷ", "①", "12 !", "a", "ʰ", "字", ""])], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs.where("doc_id = 4"))).collect()}
    assert {i for i, (lang, _) in found.items() if lang == "und"} == {0, 1, 2, 3, 7}
    assert all(score == 0 for lang, score in found.values() if lang == "und")


def test_quality_without_ratings_keeps_every_text(spark):
    docs = table(spark, EDGE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.grades_of_labels(labels), grades=3)
    assert all(r.selected and r.tail > 0.99 for r in quality.rate(docs, model).collect())


def test_code_lengths_against_direct_ppm():
    train = ["abracadabra", "A cab; a bar", "Это кабан и барабан", "", "x"]
    data, off = language.utf8(pa.array(train))
    g, n = np.unique(language.groups(data, off), return_counts=True)
    follow = {}
    for t in train:
        s = [language.START] * language.ORDER + language.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist()
        for i in range(language.ORDER, len(s)):
            for k in range(language.ORDER + 1):
                follow.setdefault(tuple(s[i - k:i]), Counter())[s[i]] += 1

    def bits(context, symbol):
        shorter = lambda: bits(context[1:], symbol) if context else 8.0
        if context not in follow:
            return shorter()
        c = follow[context]
        total, d = sum(c.values()), len(c)
        return -np.log2(c[symbol] / (total + d)) if symbol in c else -np.log2(d / (total + d)) + shorter()

    probes = ["abracadabra", "zzz cab", "барабан, кабак", "日本語 and ελληνικά", ""]
    data, off = language.utf8(pa.array(probes))
    got = language.code_lengths(data, off, [language.context_tree(g, n)])[:, 0] / language.UNIT
    for probe, found in zip(probes, got, strict=True):
        s = [language.START] * language.ORDER + language.FOLD[np.frombuffer(probe.encode(), np.uint8)].tolist()
        direct = sum(bits(tuple(s[i - language.ORDER:i]), s[i]) for i in range(language.ORDER, len(s)))
        assert abs(found - direct) < 1e-4


def test_languages_of_one_script(spark):
    """Pairs of languages in the same letters, six scripts in all, told apart by short held-out texts."""
    rng = random.Random(5)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת",
               "กขคงจชซญดตถทนบปผพฟมยรลวสหอ", "".join(chr(0x4E00 + i) for i in range(400))]
    train, held_out = [], []
    for name, letters in [(f"{i}{pair}", s) for i, s in enumerate(scripts) for pair in "ab"]:
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(300)]
        texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)] + [" ".join(rng.choice(words) for _ in range(6)) for _ in range(20)]
        train += [(name, t) for t in texts[:30]]
        held_out += [(name, t) for t in texts[30:]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(train + held_out)], "doc_id long, lang string, text string")
    model = language.learn(docs.where(F.col("doc_id") < len(train)))
    found = {r.doc_id: r.lang_pred for r in language.identify(docs.drop("lang"), model).collect()}
    right = [found[len(train) + i] == name for i, (name, _) in enumerate(held_out)]
    assert sum(right) / len(right) >= 0.99


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = entry.queries()["op10_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert {r.lang_pred for r in language.identify(table(spark, [(1, None), (2, "12 3!")]), language.learn(table(spark, [(1, "abc")]))).collect()} == {"und"}


def test_near_duplicate_stage_against_all_pairs(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(None, prose(1, 30)), (None, prose(1, 30)), (90, ""), (90, ""), (90, None), (91, prose(2, 40)), (91, prose(2, 40)), (91, prose(3, 40))]
    for g in range(12):
        base = prose(700 + g, 100).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((rng.choice((g, g, 20 + g)), " ".join(w)))
    sets = [frozenset(zip(*(w[j:] for j in range(5)), strict=False)) for w in ((t or "").split() for _, t in rows)]
    near = [[bool(a) and len(a & b) * 100 >= 80 * len(a | b) for b in sets] for a in sets]

    def groups(members, linked):
        out = []
        for m in members:
            met = [g for g in out if any(linked(m, x) for x in g)]
            out = [g for g in out if g not in met] + [sum(met, [m])]
        return out

    with_id = [i for i, (d, _) in enumerate(rows) if d is not None]
    stay = {rows[i][0] for g in groups(with_id, lambda i, j: near[i][j] or rows[i][0] == rows[j][0]) for i in [min(g, key=lambda x: rows[x][0])]}
    expected = {None: 2}
    for d in stay:
        expected[d] = len(groups([i for i in with_id if rows[i][0] == d], lambda i, j: near[i][j] or rows[i][1] == rows[j][1]))
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    assert {d: sum(r.doc_id == d for r in got) for d in {r.doc_id for r in got}} == expected
    assert expected[90] == expected[91] == 2 and {(r.doc_id, r.text) for r in got} <= set(rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_saved_steps_leave_no_shuffle_files(spark):
    """What a kept step was made from is gone when it is kept."""
    import glob
    import time

    from tillroll.llm.runtime import prepare, saved

    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    files = lambda: set(glob.glob(f"{root}/**/shuffle_*", recursive=True))
    prepare(spark)
    before = files()
    kept = saved(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 99).alias("m")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == kept.count() == 99
