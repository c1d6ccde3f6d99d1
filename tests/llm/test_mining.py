"""Collocations, the Merkle manifest and the passage classifier against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralens.llm import _text, collocations, merkle, passage_mil
from terralens.llm._tables import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, a string, tree string, size long, label string, row long, `__text` string"
AWKWARD = [None, "", " \t\n", "one", "İstanbul ΣΑΣ ſ 日本 🙂 \x1c x y", "a" * 5000, "tie", "tie", "x " * 3000, ".,;:!?\r\x0b\x0c"]


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    return spark.createDataFrame([(*r, "r", "a", "t", 1, "l", 2, "_") for r in rows], SCHEMA)


# --- 11 -----------------------------------------------------------------------------------------------------------


def mined(rows, max_n=3, least=10, top=2000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]  # noqa: E741
    return sorted(out)


def chatter(n=260, seed=5):
    rng = np.random.default_rng(seed)
    common = ["New York City", "due process", "of the", "Ünder-the-table deal", "a b a b"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.zipf(1.6) % 60}" for _ in range(int(rng.integers(1, 40)))]
        text = "".join(str(p) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)
        rows.append((i, text, [None, "en", "en", "en", "de", ""][i % 6], "s", 1))
    return rows


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_phrases_equal_brute_force(spark, max_n):
    rows = chatter() + [(1000 + i, t, "en", None, None) for i, t in enumerate(AWKWARD)] + [(5, "und und und " * 9, "und", None, None)]
    got = sorted(tuple(r) for r in collocations.mine(docs_of(spark, rows), max_n).collect())
    want = mined(rows, max_n)
    assert got == want and len({r[0] for r in want}) == 4 and any(r[2].count(" ") == max_n - 1 for r in want)


def test_phrases_when_the_bitmap_is_full_and_lists_are_cut(spark):
    rows = chatter(120, 6)
    docs = docs_of(spark, rows)
    scratch = Scratch(spark, "t")
    some, all_ = (sorted(tuple(r) for r in collocations.counted(docs, scratch, 3, 10, bits).collect() if scratch.drop_all_but() is None) for bits in (3, 27))
    assert some == all_
    assert sorted(tuple(r) for r in collocations.mine(docs, top=5, salts=3, cover_percent=80).collect()) == mined(rows, top=5, percent=80)


def test_large_counts_are_exact(spark):
    counts = (999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_997)
    row = spark.createDataFrame([counts], "a long, l long, r long")
    got = row.select(collocations.weak_score().alias("s")).first()["s"]
    assert got == 1_000_000 * counts[0] ** 2 // (counts[1] * counts[2])


def test_no_phrases(spark):
    assert collocations.mine(docs_of(spark, [])).collect() == []
    assert collocations.mine(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(AWKWARD[:5])])).collect() == []


# --- 12 -----------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(level, fanout):
    """All levels of a tree."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        begin = i // fanout * fanout
        out.append((i - begin, [d for j, d in enumerate(level[begin : begin + fanout], begin) if j != i]))
        i //= fanout
    return out


def manifest_of(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees, sorted_rows = [], []
    for lang in order:
        sorted_rows.append(sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))))
        trees.append(climbed([leaf_of(r) for r in sorted_rows[-1]], fanout))
    over = climbed([t[-1][0] for t in trees], fanout)
    out = []
    for k, (tree, members) in enumerate(zip(trees, sorted_rows, strict=True)):
        for i, r in enumerate(members):
            path = path_of(tree, i, fanout) + path_of(over, k, fanout)
            now = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for place, others in path:
                now = h(*others[:place], now, *others[place:])
            out.append((r[0], leaf_of(r), tree[-1][0], over[-1][0], h(*(d for _, o in path for d in o)), now, now == over[-1][0]))
    return sorted(out, key=str)


def shelves(n, langs):
    return [(i * 3 % 1000 if i % 11 else None, AWKWARD[i % len(AWKWARD)], langs[i % 7 % len(langs)], None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "fanout", "block"), [(203, ["en", None, "", "én", "en", "-", "="], 2, 8), (203, ["en", "de"], 3, 9), (64, ["en"], 2, 4096), (1, [None], 2, 4), (7, list("abcdefg"), 2, 2), (100, ["x", "y"], 7, 50)])
@pytest.mark.parametrize("few", [0, 100_000])
def test_manifest_equals_brute_force(spark, monkeypatch, n, langs, fanout, block, few):
    monkeypatch.setattr(merkle, "_FEW", few)  # whether few rows meet in one task, or shuffles do it all
    rows = shelves(n, langs)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = sorted((tuple(r) for r in merkle.checked(docs_of(spark, rows).repartition(5), fanout, tampered, block).collect()), key=str)
    assert got == manifest_of(rows, fanout)
    if n > 100:
        assert {r[-1] for r in got} == {True, False}


def test_repeated_rows_and_no_rows(spark):
    rows = [(4, "same", "en", "s", 1)] * 300 + [(None, None, None, None, None)] * 50
    got = sorted((tuple(r) for r in merkle.checked(docs_of(spark, rows).repartition(4), block=16).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in manifest_of(rows, 2)] and all(r[-1] for r in got)
    assert merkle.checked(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        merkle.checked(docs_of(spark, []), fanout=1)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_runs_that_begin_and_end_anywhere_merge_to_the_same_nodes(fanout):
    rng = np.random.default_rng(fanout)
    for n in (1, 2, 3, 26, 27, 28, 100):
        digests = [h(str(i)) for i in range(n)]
        cuts = [0, *sorted(rng.integers(0, n + 1, 6).tolist()), n]
        open_, records = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            run = merkle.Range("t", n, fanout)
            for i in range(a, b):
                run.add(0, i, digests[i])
            run.close()
            open_ += [d[:3] for d in run.done if d[3]]
            records += [d[:3] for d in run.done if not d[3]]
        last = merkle.Range("t", n, fanout)
        for level, i, d in open_:  # in order of their leaves
            last.add(level, i, d)
        last.close()
        assert not any(d[3] for d in last.done)
        records += [d[:3] for d in last.done]
        want = climbed(digests, fanout)
        assert sorted(records) == sorted((level, i, d) for level, row in enumerate(want) if level or n == 1 for i, d in enumerate(row))


# --- 13 -----------------------------------------------------------------------------------------------------------


def test_passages_hold_whole_texts_whatever_their_neighbours():
    texts = [t or "" for t in AWKWARD] + ["word " * n for n in (63, 64, 65, 640)]
    x, top = passage_mil.encode(*_text.buffers(pa.array(texts)))
    assert np.isfinite(x).all()
    for i, t in enumerate(texts):
        n = len(t.encode().split())
        assert top[i + 1] - top[i] == max(1, -(-n // passage_mil.WORDS))
        alone, _ = passage_mil.encode(*_text.buffers(pa.array([t])))
        assert np.allclose(alone, x[top[i] : top[i + 1]])
    a, b = (passage_mil.encode(*_text.buffers(pa.array(["w " * 6400 + last])))[0] for last in ("plain", "$$$###"))
    assert not np.allclose(a[-1], b[-1])  # the end of a long text counts


def test_gradient_is_the_loss_slope():
    rng = np.random.default_rng(0)
    m = passage_mil
    parts = tuple(rng.normal(0, 0.3, s) for s in ((m.WIDTH, m.HIDDEN), m.HIDDEN, (m.HIDDEN, m.GATE), (m.HIDDEN, m.GATE), m.GATE, m.HIDDEN, 1))
    model = m.Model(np.zeros(m.WIDTH), np.full(m.WIDTH, 0.2), parts)
    x, top, y, weight = rng.normal(0, 1, (12, m.WIDTH)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 0, 1]), np.array([0.2, 0.3, 0.4, 0.1])

    def loss():
        z = model.forward(x, top)[0]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum())

    for p, g in zip(parts, m.gradient(model, x, top, y, weight), strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        before = p[at]
        p[at] = before + 1e-5
        up = loss()
        p[at] = before - 1e-5
        slope = (up - loss()) / 2e-5
        p[at] = before
        assert abs(slope - g[at]) < 1e-6


def test_attention_finds_the_passages_that_decide():
    """Bad texts have one bad passage among many good ones; only texts are labelled."""
    rng = np.random.default_rng(2)

    def text(bad):
        parts = [" ".join(rng.choice([f"w{i}" for i in range(200)], 64)) for _ in range(int(rng.integers(4, 12)))]
        at = int(rng.integers(len(parts)))
        if bad:
            parts[at] = " ".join(f"{w}###" for w in parts[at].split())
        return " ".join(parts), at

    made = [(*text(i % 2), i % 2) for i in range(500)]
    x, top = passage_mil.encode(*_text.buffers(pa.array([t for t, *_ in made])))
    cut = top[350]
    model = passage_mil.fit(x[:cut], top[:351], np.array([1 - b for *_, b in made[:350]]))
    scores, weights = model.scores(x[cut:], top[350:] - cut)
    bad = np.array([b for *_, b in made[350:]])
    assert ((scores < 0.5) == bad).mean() > 0.97
    best = [int(weights[a - cut : b - cut].argmax()) for a, b in zip(top[350:-1], top[351:], strict=False)]
    assert np.mean([best[i] == made[350 + i][1] for i in np.flatnonzero(bad)]) > 0.9


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    got = passage_mil.op13_passage_quality(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(rows) > 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.99
    assert np.mean([r["predicted"] for r in rows if r["quality"]]) > 0.995 and np.mean([r["predicted"] for r in rows if not r["quality"]]) < 0.05
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_scores_of_awkward_rows_and_few_labels(spark):
    rows = [(None if i % 4 == 3 else i, t, None, None, None) for i, t in enumerate(AWKWARD * 3)]
    docs = docs_of(spark, rows)
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int, toxic int, lang string")
    none, one = labels((None, 1, 1, "x"), (0, None, 1, "x")), labels(*((i, 1, 0, "x") for i in range(30)))
    both = labels(*((i, i % 2, 0, "x") for i in range(30)), (2, 1, 1, "y"))
    for given in (none, one, both):
        model = passage_mil.train(docs, given)
        got = passage_mil.score(docs, model, "doc_id", "text", "rank").collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if not r["text"]}) == 1
        assert given is not none or {r["score"] for r in got} == {0.5}
    assert passage_mil.score(docs_of(spark, []), model, "doc_id").collect() == []
    with pytest.raises(ValueError):
        passage_mil.score(docs, model, "doc_id", name="doc_id")
    assert passage_mil.score(docs, model, "__text").count() == len(rows)
    # the score is the model's, passage by passage
    x, top = passage_mil.encode(*_text.buffers(pa.array([t or "" for _, t, *_ in rows])))
    want = Counter(np.round(model.scores(x, top)[0], 6).tolist())
    assert want == Counter(round(r["score"], 6) for r in got)


def test_bounds_on_training_rows(spark):
    docs = docs_of(spark, [(i % 50, f"word{i % 60} " * (64 * (1 + i % 3)), None, None, None) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    a, b = (passage_mil.train(docs, labels, max_labelled=20, max_passages=30) for _ in range(2))
    assert all((p == q).all() for p, q in zip(a.parts, b.parts, strict=True))
    assert passage_mil.train(docs, labels, max_passages=0).parts[6][0] == 0
