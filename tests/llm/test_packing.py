import time
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from spindle.llm import op1_packing as op
from spindle.llm.queries import packing

from .edges import documents, empty

END = 2


def pieces_by_hand(rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, END], dtype="<u4")
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        bounds = [0, *range(head or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())


def best_fit_by_hand(lengths):
    """How many sequences best-fit decreasing needs."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else -1
        insort(rooms, (1024 if room < 0 else room) - n)
    return len(rooms)


def held(rows):
    """Sequences are gapless and no longer than allowed; returns how many."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = packing(spark, small).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(pieces_by_hand(docs))
    assert held(got) <= best_fit_by_hand(r.length for r in got)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = documents(spark, extra=extra)
    got = op.pack_documents(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(pieces_by_hand([(r.doc_id, r.text) for r in docs.collect()]))
    held(got)


def test_empty(spark):
    assert op.pack_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1024: 3}, {600: 7, 424: 7}, {513: 9}, {700: 1000, 300: 1000, 24: 1000}, {341: 6000, 342: 3000, 1: 10}])
def test_plan_places_all(histogram):
    fillings = op.plan(histogram)
    total = Counter()
    for filling, k in fillings:
        assert sum(n * c for n, c in filling.items()) <= 1024
        for n, c in filling.items():
            total[n] += c * k
    assert total == Counter(histogram)


def test_plan_reaches_the_bound():
    assert sum(k for _, k in op.plan({700: 1000, 300: 1000, 24: 1000})) == 1000


def test_plan_near_the_bound_on_many_lengths():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 1024)
    sequences = sum(k for _, k in op.plan(Counter(lengths.tolist())))
    assert sequences <= 1.002 * -(-int(lengths.sum()) // 1024)


def test_what_rounding_leaves_does_not_grow_with_the_corpus(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = Counter(np.clip(rng.lognormal(6, 1, 30_000).astype(int), 1, 1024).tolist())
    rest, filled = [], op.best_fit
    monkeypatch.setattr(op, "best_fit", lambda demand, capacity: rest.append(int(demand.sum())) or filled(demand, capacity))
    for scale in (1, 10**6):
        total = sum(n * k * scale for n, k in lengths.items())
        assert sum(k for _, k in op.plan({n: k * scale for n, k in lengths.items()})) <= 1.002 * total / 1024
    assert max(rest) < 5000


def lognormal(n, seed=5):
    return Counter(np.clip(np.random.default_rng(seed).lognormal(6, 1, n).astype(int), 1, 1024).tolist())


def demand_of(histogram):
    demand = np.zeros(1025, dtype=np.int64)
    for n, k in histogram.items():
        demand[n] = k
    return demand


def test_weights_make_the_difference():
    """Without weights the fractional solution wastes ten times as much, and the plan is worse."""
    histogram = lognormal(50_000)
    demand = demand_of(histogram)
    demand[1024] = 0
    (on, bound), (off, _) = (op.fractional(demand, 1024, 3, decay) for decay in (1.0, 0.0))
    wasted = [sum(often for _, often in found) - bound for found in (on, off)]
    assert 0 <= 10 * wasted[0] < wasted[1]
    assert op.solved(histogram, schedules=((3, 1.0),)).sequences < op.solved(histogram, schedules=((3, 0.0),)).sequences


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_program_runs_for_small_tables_too(small, sf, monkeypatch):
    encode = op._encoder("byte_bpe_50k.json")
    texts = pq.read_table(f"{small.replace('sf0.001', sf)}/documents.parquet", columns=["text"])["text"].to_pylist()
    histogram = Counter(n for t in texts for _, n in op.cut(len(encode(t or "")) + 1, 1024))
    chosen, filled = [], op.best_fit
    monkeypatch.setattr(op, "best_fit", lambda demand, capacity: chosen.append(int(demand.sum())) or filled(demand, capacity))
    plan = op.solved(histogram)
    assert plan.bound >= -(-sum(n * k for n, k in histogram.items()) // 1024)
    assert plan.sequences <= min(plan.bound + 2, best_fit_by_hand(histogram.elements()))
    assert min(chosen) < 0.5 * sum(k for n, k in histogram.items() if n < 1024)  # most pieces come from the program


def test_the_bound_holds_and_the_plan_is_quick():
    rng = np.random.default_rng(7)
    for _ in range(20):  # against the fewest sequences that any order of first fit finds
        lengths = rng.integers(200, 800, 9).tolist()
        fewest = 9
        for _ in range(200):
            rooms = []
            for n in rng.permutation(lengths).tolist():
                at = next((i for i, room in enumerate(rooms) if room >= n), None)
                if at is None:
                    rooms.append(1024 - n)
                else:
                    rooms[at] -= n
            fewest = min(fewest, len(rooms))
        plan = op.solved(Counter(lengths))
        assert plan.bound <= fewest and plan.sequences <= fewest + 1
    began = time.process_time()
    op.plan(lognormal(200_000))
    assert time.process_time() - began < 20


def test_encoder_matches_the_library_on_odd_texts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = op._encoder("byte_bpe_50k.json")
    for text in ["", " ", "\n\n  x", "a" * 3000, "é é", "<|endoftext|>x<|endoftext|>", "１２ ½ ٣", "​　\x00\x1c ok", "don't WE'LL", "𝒳 emoji 👩‍👩‍👧"]:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
