"""op8's work grows with its lines: bands move in packs, signatures are made in blocks, unlike lines are sifted together."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trawl.llm import groups, line_dedup
from trawl.llm.common import Stored


def lines_of(rng, n, near):
    out = ["".join(rng.choice("abcdefghij klmnop") for _ in range(200)).strip() for _ in range(n)]
    for k in range(near):
        out.append(out[k] + "xy" * (k % 4))
    return [line_dedup.normalized(x) for x in out]


@pytest.mark.parametrize("k", [None, 40])
def test_unlike_lines_are_sifted_together(monkeypatch, k):
    lines = lines_of(random.Random(1), 150, 30)
    random.Random(2).shuffle(lines)
    calls, exact = [], line_dedup.common_count
    monkeypatch.setattr(line_dedup, "common_count", lambda a, b: calls.append(1) or exact(a, b))
    found = line_dedup.comparison(8, 0.8)([lines, []], np.arange(len(lines)), k)
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    asked = [(a, b) for a in range(len(lines)) for b in range(a) if k is None or b < k <= a]
    want = {(a, b) for a, b in asked if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert set(found) <= want and {a for a, _ in found} == {a for a, _ in want}
    assert len(calls) < 6 * len(lines) < len(asked)


def test_cells_get_the_sets_of_their_lines(monkeypatch):
    monkeypatch.setattr(line_dedup, "AHEAD", 700)
    lines = [*lines_of(random.Random(3), 20, 5), "short", "", "é日" * 9, "aaaaaaaaa"] * 2
    column = pa.array(["not of the lot", *lines]).slice(1)
    cell = line_dedup.prepared(8)([column])
    for i, j in ((0, 2), (2, 9), (9, 10), (12, 15), (15, 22), (24, len(lines))):
        texts, sets = cell(i, j)
        assert texts == lines[i:j]
        assert not sets or [x.tolist() for x in sets] == [line_dedup.shingles(x, 8).tolist() for x in texts]
    assert cell(0, len(lines))[1] == []


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    lines = [*lines_of(random.Random(4), 50, 10), "", "seven..", "eight...", "日本語テキストの行です", "x" * 3000]
    want = line_dedup.signatures(lines, 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 300)
    assert np.array_equal(line_dedup.signatures(lines, 8), want)
    for line, row in zip(lines, want):
        if len(line) >= 8:
            least = defaultdict(lambda: 1 << 32)
            for h in line_dedup.shingles(line, 8).tolist():
                least[h >> 58] = min(least[h >> 58], h >> 26 & 0xFFFFFFFF)
            assert all(int(row[p]) == v for p, v in least.items())


def test_normalized_is_lower_case_with_single_spaces():
    rng = random.Random(5)
    for _ in range(3000):
        line = "".join(rng.choice(["a", "É", "ß", "Σ", "İ", " ", "\t", "\x1f", "\x85", "\xa0", " ", chr(rng.randrange(0x500))]) for _ in range(rng.randrange(12)))
        assert line_dedup.normalized(line) == " ".join(line.lower().split())


@pytest.mark.parametrize("options", [{}, {"buckets": 2, "packed": 40, "most": 6}, {"buckets": 1, "packed": 1, "most": 1}])
def test_groups_of_packed_bands(spark, options):
    rng = random.Random(6)
    rows = [(name, [rng.choice([1, 2, 10 + name % 9, 1000 + name % 40, rng.randrange(10**6)]) for _ in range(rng.choice([1, 4]))]) for name in range(120) for _ in range(2)]
    rows += [(500, None), (501, [7]), (502, [7]), (503, [-7]), (503, [-7]), (-9, [-5]), (-8, [-5])]
    found = groups.candidate_groups(spark.createDataFrame(rows, "name long, keys array<long>"), Stored(spark), **options)
    got = defaultdict(set)
    for r in found.collect():
        assert r["name"] not in got[r["grp"], r["n"]]
        got[r["grp"], r["n"]].add(r["name"])
    want = defaultdict(set)
    for name, keys in rows:
        for band in keys or []:
            want[band].add(name)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}
    assert all(len(x) == n for (_, n), x in got.items())
    assert groups.candidate_groups(spark.createDataFrame(rows[:0], "name long, keys array<long>"), Stored(spark)).count() == 0
