"""Near copies around a text that is nobody's least pivot."""

import random

import brute

import numpy as np
import pytest

from quern.llm import _bytes, banding, lines, neardup


def test_copies_of_a_text_in_their_midst(spark):
    """Two copies, each with another change, are below 0.8; the text they were made from, whose id is in the middle, links all."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(24)]
    data = [(i, " ".join(base[: (p := 1 + i % 22)] + [f"x{rng.randrange(10**9)}"] + base[p + 1 :])) for i in range(400) if i != 200]
    data.append((200, " ".join(base)))
    found = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(5), width=2).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert found == sorted(brute.op4(data))
    assert sum(kept for *_, kept in found) < 5


@pytest.mark.parametrize("limit", [6_000, 20_000, 60_000])
def test_links_where_no_block_has_room_for_a_group(spark, monkeypatch, limit):
    """Texts that meet in many bands and are mostly unlike; near copies of some of them. Blocks hold about 7, 25 and 75 of 200 texts; with 75 all pairs of blocks are cheap."""
    monkeypatch.setattr(banding, "LIMIT", limit)
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(40)], []
    for i in range(150):
        t = base[:]
        for j in rng.sample(range(40), 4):
            t[j] = f"x{rng.randrange(10**9)}"
        texts += [t] if i % 3 else [t, [*t, "more"]]
    data = list(zip(rng.sample(range(10_000), len(texts)), map(" ".join, texts)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = sorted(map(tuple, neardup.near_duplicates(df, width=2).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert found == sorted(brute.op4(data))
    told = [(i, f"{t}\n{t} {i}\nown line {i * 7919}") for i, t in data[:60]]
    found = sorted(map(tuple, lines.dedup_lines(spark.createDataFrame(told, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()))
    assert found == sorted(brute.op10(told))


@pytest.mark.parametrize("n", [2, 5, 40, 400])
@pytest.mark.parametrize("sides", [1, 2])
def test_closure_of_a_block(n, sides):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for i in range(n):
        own = base[rng.random(300) < rng.choice([0.3, 0.9, 0.99])] if i % 4 else rng.integers(0, 2**63, rng.integers(1, 40)).astype(np.uint64)
        sets.append(np.unique(own) if i % 7 or not i else sets[i - 1])
    cut = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    label, side = rng.permutation(n // 2 + 1).repeat(2)[:n] * 10, rng.integers(0, sides, n)
    a, b = banding._closure(np.concatenate(sets), cut, label, side, 80)
    links = list(zip(label.tolist(), label.tolist()))
    several = len(set(side.tolist())) > 1
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both and (side[i] != side[j] or not several):
                links.append((int(label[i]), int(label[j])))
    names = sorted(set(label.tolist()))
    assert brute.components(names, list(zip(a.tolist(), b.tolist()))) == brute.components(names, links)
    assert len(a) < len(names)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
@pytest.mark.parametrize("low, high", [(0, 4), (0, 2**64 - 1), (2**63, 2**63 + 300)])
def test_order_of_numbers(n, low, high):
    """Equal ones, and some that only their lowest bits tell apart."""
    key = np.random.default_rng(n).integers(low, high, n, np.uint64, endpoint=True)
    order = _bytes.order(key)
    assert sorted(order.tolist()) == list(range(n))
    assert key[order].tolist() == sorted(key.tolist())


@pytest.mark.parametrize("alone", [True, False])
def test_stars_of_keys(alone):
    rng = np.random.default_rng(5)
    key, id = rng.integers(0, 300, 900).astype(np.uint64) << np.uint64(40), rng.integers(-5, 5, 900)
    key[:100] = rng.integers(2**63, 2**64, 100, np.uint64)  # each once
    pairs = sorted(set(zip(key.tolist(), id.tolist())))
    several = {k for k in key.tolist() if key.tolist().count(k) > 1}
    found = list(zip(*(x.tolist() for x in banding._stars(key, id, alone))))
    assert found == [(k, i, min(j for x, j in pairs if x == k)) for k, i in pairs if alone or k in several]
