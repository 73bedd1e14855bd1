import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import op7_quality, op8_toxicity
from spindle.llm.queries import quality, toxicity

from .edges import documents, empty


def test_quality_on_held_out_rows(spark, small):
    place = small.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in quality(spark, place).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(labels[d], r.predicted) for d, r in got.items() if d in labels and r.held_out]
    right = {y: np.mean([p == y for t, p in test if t == y]) for y in (0, 1)}
    assert right[0] > 0.8 and right[1] > 0.97, right


def test_quality_never_learns_from_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    statistics = op7_quality.with_statistics(docs)
    out = op7_quality.held_out(F.col("doc_id"))
    a = op7_quality.train(statistics, labels.where(~out))
    b = op7_quality.train(statistics, labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).where(~out))
    assert np.allclose(a.means, b.means)


def test_discriminant_matches_the_densities():
    rng = np.random.default_rng(2)
    d = op7_quality.D
    x = [rng.normal(k, 1 + k, (500, d)) @ (np.eye(d) + 0.1) for k in (0, 1)]
    n = np.array([500.0, 500.0])
    model = op7_quality.solve(n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = 0.9 * sum(own) / 2 + 0.1 * np.diag(np.diag(sum(own) / 2))
    for k in (0, 1):
        c = 0.8 * own[k] + 0.2 * pooled + op7_quality.FLOOR * np.eye(d)
        z = x[0][:20] - x[k].mean(0)
        plain = np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)
        assert np.allclose(model.log_density(x[0][:20], k), plain)
    assert (model.score(x[1]) > 0.5).mean() > 0.95


@pytest.mark.parametrize("extra", [False, True])
def test_quality_edges(spark, extra):
    docs = documents(spark, extra=extra)
    statistics = op7_quality.with_statistics(docs)
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, 0), (4, 1, 1), (5, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = op7_quality.score(statistics, op7_quality.train(statistics, known)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    model = op7_quality.train(op7_quality.with_statistics(empty(spark)), labels)
    assert op7_quality.score(op7_quality.with_statistics(empty(spark)), model).collect() == []


def test_toxicity_on_rows_it_did_not_see(spark, small):
    place = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    chain = op8_toxicity.train(docs, labels.where(~out))
    got = op8_toxicity.score(docs.select("doc_id", "text"), chain).select("row.doc_id", "predicted").join(labels.where(out), "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01, (np.mean(toxic), np.mean(clean))


def test_toxicity_query(spark, small):
    got = toxicity(spark, small).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.doc_id in labels]) > 0.95


@pytest.mark.parametrize("extra", [False, True])
def test_toxicity_edges(spark, extra):
    docs = documents(spark, extra=extra)
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 0), (4, 1), (4, 1), (5, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("toxic = 1"), labels.limit(0)):
        got = op8_toxicity.score(docs, op8_toxicity.train(docs, known)).collect()
        assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 for r in got)
    chain = op8_toxicity.train(empty(spark), labels)
    assert chain.constant == 0 and op8_toxicity.score(empty(spark), chain).collect() == []


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        seed = ["insult"] if k % 6 == 0 else []
        toxic = int(bool(seed) or k % 15 == 1)
        slots = [7] * bool(seed) + [8] * (k % 15 == 1) + [int(s) for s in rng.integers(100, 200, 5)]
        slots = sorted(set(slots))
        rows.append((k, toxic, slots, [1] * len(slots), seed))
    terms = {s: i for i, s in enumerate(sorted({v for r in rows for v in r[2]}))}
    counts = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        counts[i, [terms[s] for s in r[2]]] = 1
    chain = op8_toxicity.fit_chain(np.arange(600), np.array([r[1] for r in rows]), counts, [r[4] for r in rows], terms)
    assert [len(w) for w in chain.weights] == [len(chain.terms) + k + 1 for k in range(len(op8_toxicity.CHAIN))]
    x = np.zeros((2, len(chain.terms)))
    x[1, chain.terms[7]] = np.log1p(1)
    p = chain.predict(x)
    assert p[1, 0] > 0.8 > 0.1 > p[0, 0] and p[1, -1] > 0.8 > 0.3 > p[0, -1]
    assert chain.weights[-1][len(chain.terms)] > 0  # the insult link speaks for toxicity


# --- plain versions of both queries ------------------------------------------------------


def figures_by_hand(text):
    """The statistics of op7, by going through bytes, words and lines one at a time."""
    raw, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x != ""]
    kinds = Counter()
    for b in raw:
        c = chr(b)
        kinds["upper"] += "A" <= c <= "Z"
        kinds["digit"] += "0" <= c <= "9"
        kinds["mark"] += c in "#*$%&|<>"
        kinds["bar"] += c == "|"
        kinds["stop"] += c in ".,;:"
        kinds["loud"] += c in "!?"
        kinds["letter"] += "A" <= c <= "Z" or "a" <= c <= "z" or b >= 128
    n, w, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    rest = n - sum(kinds[k] for k in ("upper", "digit", "mark", "stop", "loud", "letter"))
    pairs = [(words[i], words[i + 1]) for i in range(len(words) - 1)]
    of = lambda k, total: math.sqrt(k / total)
    return [
        math.log(1 + len(words)), math.log(1 + sum(len(x) for x in words) / w), *(of(kinds[k], n) for k in ("upper", "digit", "mark", "bar", "stop", "loud", "letter")),
        of(len(set(words)), w), of(max((words.count(x) for x in set(words)), default=0) if len(words) < 500 else Counter(words).most_common(1)[0][1], w),
        math.log(1 + len(lines)), of(len(lines) - len(set(lines)), m), math.log(1 + len(raw) / m), of(len(pairs) - len(set(pairs)), max(1, len(pairs))),
        of(sum(len(x) >= 15 for x in words), w), of(max(0, rest), n),
    ]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_against_a_plain_version(spark, small, sf):
    place = small.replace("sf0.001", sf)
    docs = {r.doc_id: figures_by_hand(r.text or "") for r in spark.read.parquet(f"{place}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    classes = [np.array([docs[d] for d in docs if labels.get(d) == k and zlib.crc32(str(d).encode()) % 3 != 1]) for k in (0, 1)]
    own = [np.cov(x.T, bias=True) for x in classes]
    share = [len(x) / sum(map(len, classes)) for x in classes]
    pooled = share[0] * own[0] + share[1] * own[1]
    pooled = (1 - op7_quality.TO_DIAGONAL) * pooled + op7_quality.TO_DIAGONAL * np.diag(np.diag(pooled))
    density = []
    for k in (0, 1):
        c = (1 - op7_quality.TO_POOLED) * own[k] + op7_quality.TO_POOLED * pooled + op7_quality.FLOOR * np.eye(op7_quality.D)
        inverse, half = np.linalg.inv(c), 0.5 * np.linalg.slogdet(c)[1]
        density.append({d: math.log(share[k]) - half - 0.5 * (x - classes[k].mean(0)) @ inverse @ (x - classes[k].mean(0)) for d, x in ((d, np.array(v)) for d, v in docs.items())})
    for r in quality(spark, place).collect():
        apart = density[1][r.doc_id] - density[0][r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, apart)))), abs=1e-6)
        assert r.predicted == (r.score >= 0.5)


def slots_by_hand(text):
    counts = defaultdict(int)
    for word in re.findall(r"\w+", text.lower()):
        for term in {zlib.crc32(t.encode()) % (1 << 20) for t in {word + "$"} | {word[:k] for k in (4, 5, 6, 7) if len(word) >= k}}:
            counts[term] += 1
    return counts


def weights_by_hand(x, y):
    """Ridge-penalised logistic weights, intercept last, by quadratic bounds of the loss: each step's
    curvature is the largest there can be, so the loss never rises."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, op8_toxicity.RIDGE), 1e-6)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) + 0.5 - y.sum()))
    if len(set(y.tolist())) == 1:
        return w
    bound = np.linalg.inv(x.T @ x / 4 + np.diag(shrink))
    for _ in range(20_000):
        move = bound @ (x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) - shrink * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def test_weights_are_those_of_least_loss():
    rng = np.random.default_rng(8)
    for k in range(4):
        x = rng.poisson(0.2, (150, 60)) * rng.choice([1.0, 3.0], 60)
        y = (x[:, :3].sum(axis=1) + rng.normal(0, 0.3, 150) > 1.2 + k).astype(float)
        assert np.allclose(op8_toxicity.logistic(x, y), weights_by_hand(x, y), atol=1e-3)


def test_toxicity_against_a_plain_version(spark, small):
    place = small.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{place}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    ids = sorted(d for d in docs if d in labels)
    slots = {d: slots_by_hand(t) for d, t in docs.items()}
    n1 = sum(labels[d] for d in ids)
    holds = {k: Counter(s for d in ids if labels[d] == k for s in slots[d]) for k in (0, 1)}
    gain = {s: k * math.log((k + 0.5) / (n1 + 1) / ((holds[0][s] + 0.5) / (len(ids) - n1 + 1))) for s, k in holds[1].items() if k >= 3}
    terms = [s for s in sorted(gain, key=lambda s: (-gain[s], s)) if gain[s] > 0][: op8_toxicity.TERMS]
    x = {d: np.log1p([slots[d].get(s, 0) for s in terms]) for d in docs}
    held = {d: {c for c, seeds in op8_toxicity.SEEDS.items() if set(re.findall(r"\w+", docs[d].lower())) & set(seeds)} for d in ids}
    targets = [[labels[d] * (c in held[d]) for d in ids] for c in op8_toxicity.SEEDS] + [[labels[d] * (not held[d]) for d in ids], [labels[d] for d in ids]]
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % 5 for d in ids])
    learn, everyone = np.array([x[d] for d in ids]), np.array([x[d] for d in docs])
    for y in (np.array(t, dtype=float) for t in targets):
        out = np.zeros(len(ids))
        for k in set(fold.tolist()):
            w = weights_by_hand(learn[fold != k], y[fold != k])
            out[fold == k] = 1 / (1 + np.exp(-(learn[fold == k] @ w[:-1] + w[-1])))
        w = weights_by_hand(learn, y)
        learn, everyone = np.column_stack([learn, out]), np.column_stack([everyone, 1 / (1 + np.exp(-(everyone @ w[:-1] + w[-1])))])
    expected = dict(zip(docs, everyone[:, -4:].tolist()))
    got = {r.doc_id: [r[f"p_{c}"] for c in op8_toxicity.CHAIN[:-1]] + [r.score] for r in toxicity(spark, place).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(a - b) for d in got for a, b in zip(got[d], expected[d])) < 5e-3
