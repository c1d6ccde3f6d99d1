"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralens.llm import _text, chat_format, components, decontam, fm_toxicity, forced_bpe, host_rules, katz, ngram_jaccard, pii, secret_scan, sst

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, score double"
WORDS = [f"w{i}" for i in range(300)]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, 0, "k", "n", 0.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


AWKWARD = [None, "", " \t\n", "one", "İstanbul ΣΑΣ ſ 日本 🙂 \x1c x", "a" * 5000, "tie", "tie", "x " * 3000]


def words(t):
    return (t or "").encode().lower().split()


# --- shared text helpers -------------------------------------------------------------------------------------------


def test_words_and_shingles_are_told_apart_as_python_does():
    texts = [t or "" for t in AWKWARD] + ["A b\x0bc", "a B c", "ab c", "a bc"]
    h, first = _text.word_hashes(*_text.buffers(pa.array(texts)))
    lists = [tuple(h[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    for i, a in enumerate(texts):
        assert len(lists[i]) == len(words(a))
        for j, b in enumerate(texts):
            assert (lists[i] == lists[j]) == (words(a) == words(b))
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sizes = [len(s) for s in _text.shingle_sets(b)]
    want = []
    for t in texts:
        w = words(t)
        want.append(len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w))
    assert sizes == want


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]{16,}") is None and q("a.?b") is None
    assert q("AKIA[A-Z]+") == {frozenset({"aki", "kia"})}
    assert q("(foobar|quux)+x") == {frozenset({"foo", "oob", "oba", "bar"}), frozenset({"quu", "uux"})}
    assert q("abc?d") is None or q("abc?d") == {frozenset({"abc", "bcd"}), frozenset({"abd"})}


def spans_by_re(text, rules=secret_scan.RULES):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secret_spans_equal_those_of_the_expressions(spark):
    texts = [
        *AWKWARD, "password=token:abcdefghijklmnop", "🙂 API_KEY = 'abcdefghijkl' and apikey:short", "AKIAABCDEFGHIJKLMN AKIAX", "é deadbeefdeadbeef0 cafe", "ghp_" + "a" * 36,
        "-----BEGIN RSA PRIVATE KEY----- secret: " + "z" * 20, "Secret=deadbeefdeadbeefdeadbeef",
    ]
    docs = docs_of(spark, texts).unionAll(docs_of(spark, texts[-1:], [None]))
    got = secret_scan.scan(docs)
    assert set(got.columns) == {*docs.columns, "secrets"}
    for r in got.collect():
        assert [tuple(x) for x in r["secrets"]] == spans_by_re(r["text"])
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(got).collect()}
    assert clean[len(AWKWARD) + 1] == "🙂 [SECRET]' and apikey:short" and clean[0] is None
    assert secret_scan.scan(docs.limit(0)).count() == 0
    joined = secret_scan.scan(docs, broadcast_rows=-1)  # by shuffle
    assert sorted(map(str, joined.select("doc_id", "secrets").collect())) == sorted(map(str, got.select("doc_id", "secrets").collect()))


# --- 2 ------------------------------------------------------------------------------------------------------------


def classes_by_force(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, k, edits):
    base = prose(rng, n).split()
    out = []
    for _ in range(k):
        w = list(base)
        for at in rng.choice(n, edits, replace=False):
            w[at] = f"x{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    passage = prose(rng, 60)
    texts = [t for t in AWKWARD if t is not None]
    for n, k, e in ((200, 12, 3), (200, 12, 8), (60, 20, 1), (60, 50, 2), (12, 10, 1), (7, 8, 0), (5, 5, 0)):
        texts += family(rng, n, k, e)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(60)]  # a passage that many share
    short = prose(rng, 8).split()
    texts += [" ".join(short[:m]) for m in range(1, 9)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.classes(docs_of(spark, texts)).collect()}
    assert got == classes_by_force(rows)


def test_classes_of_nulls_repeats_and_nothing(spark):
    t = "a b c d e f g"
    got = ngram_jaccard.classes(docs_of(spark, [None, t, t, t, ""], [1, None, 7, 7, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 3, 7), (1, 0, 1), (7, 3, 7), (7, 3, 7), (9, 0, 9)]
    assert ngram_jaccard.classes(docs_of(spark, []).limit(0)).count() == 0
    kept = ngram_jaccard.keep_one(docs_of(spark, [t, t, None, t], [5, 3, 4, 3]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4] and kept.columns == SCHEMA.replace(",", "").split()[::2]
    with pytest.raises(ValueError):
        ngram_jaccard.classes(docs_of(spark, [t]), 50)


def test_hot_and_dense_groups_give_the_same_classes(spark):
    rng = np.random.default_rng(18)
    texts = [*family(rng, 60, 50, 3), *family(rng, 150, 40, 4), *family(rng, 12, 20, 1)]
    want = classes_by_force(list(enumerate(texts)))
    got = ngram_jaccard.classes(docs_of(spark, texts), broadcast_nodes=5, hot=1, dense=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_neighbourhoods_find_all_partners_of_small_sets():
    rng = np.random.default_rng(5)
    plan = ngram_jaccard.Plan({}, np.zeros(1 << 24, np.uint8), 1, 40, frozenset(range(40)))
    for _ in range(3000):
        n, m = sorted(rng.integers(1, 20, 2))
        base = np.unique(rng.integers(0, 2**64 - 1, 60, dtype=np.uint64))
        rng.shuffle(base)
        shared = max(0, n - int(rng.integers(0, 4)))
        a, b = np.sort(base[:n]), np.sort(np.concatenate([base[:shared], base[30 : 30 + m - shared]]))
        if ngram_jaccard.similar(a, b, 75) and not np.array_equal(a, b):
            assert len(np.intersect1d(plan.signatures(a), plan.signatures(b)))


def test_differences_to_a_centre_lose_no_link_and_keep_few_pairs(spark):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**64 - 1, 200, dtype=np.uint64))
    cost = (base & np.uint64(7)).astype(np.uint8)
    sets = []
    for k in range(400):  # near the bound, so that most are linked to the centre or to one another or just not
        gone, new = rng.random(len(base)) < rng.choice([0.02, 0.08, 0.13, 0.2]), rng.integers(0, 2**64 - 1, int(rng.integers(0, 40)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[~gone], new])))
        if k % 7 == 0:  # some share their changes
            more = rng.integers(0, 2**64 - 1, 6, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([sets[-1], more])))
            sets.append(np.unique(np.concatenate([sets[-2], more[:3]])))
    close = [ngram_jaccard.similar(s, base, 75) for s in sets]
    out = [not c for c in close]
    rows, entries = [], []
    for i, s in enumerate(sets):
        of = ngram_jaccard.changes(base, s, cost, np.zeros(len(s), np.uint8))
        index, probe = ngram_jaccard.prefixes(len(s), len(of), len(base), out[i], 75)
        rows.append((i, len(of), i + 1 if out[i] else 0, len(s), index, probe))
        entries += [(int(e), i, k) for k, e in enumerate(of[: max(index, probe)])]
    entries.sort(key=lambda e: (e[0], rows[e[1]][1], e[1]))
    docs = np.array([rows[e[1]] for e in entries], ngram_jaccard._CHANGED)
    keys, spots = np.array([e[0] for e in entries], np.uint64), np.array([e[2] for e in entries])
    found = set(map(tuple, ngram_jaccard.matched(keys, docs, spots, 75).tolist()))
    found = {tuple(sorted(p)) for p in found}
    crossing = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if out[i] or out[j]]
    want = {(i, j) for i, j in crossing if ngram_jaccard.similar(sets[i], sets[j], 75)}
    assert len(want) > 50 and want <= found and len(found) < len(want) + len(crossing) / 5


def test_stars_in_slices_give_the_same_classes(spark, monkeypatch):
    """Sets of members are shuffled a slice of the stars at a time, and what is done with is deleted."""
    rng = np.random.default_rng(21)
    texts = [x for k in range(3) for x in family(rng, 60, 12, 3 + k % 2)]
    slices, put = [], ngram_jaccard._Join.put
    monkeypatch.setattr(ngram_jaccard, "_TOGETHER", 1)
    monkeypatch.setattr(ngram_jaccard._Join, "put", lambda self, df, name, *by: (slices.append((self.step, name)), put(self, df, name, *by))[1])
    got = ngram_jaccard.classes(docs_of(spark, texts), together=0.3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_force(list(enumerate(texts)))
    assert (1, "found-1") in slices


def test_a_star_of_unlinked_documents_makes_few_pairs(spark):
    rng = np.random.default_rng(6)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(5000):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(5, 9)), replace=False):
            w[at] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    join = ngram_jaccard._Join(docs_of(spark, texts).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")), 75, 3, 1_000_000)
    pairs = join.pairs(join.signed())
    mixed = join.mixed(pairs, components.components(join.links(pairs)))
    assert mixed.count() > 4000
    join.step += 1
    assert join.pairs(join.changed(mixed)).count() < 200_000  # of 12.5 million


def group_of(rows, entries):
    """A part of packed entries: rows (node, differences, component, size, index, probe) by number, entries (key, row, spot)."""
    box = ngram_jaccard._Outbox(1, ngram_jaccard._CHANGED, 1 << 40)
    by = defaultdict(list)
    for key, row, spot in entries:
        by[row].append((spot, key))
    for row, of in by.items():
        box.add(rows[row], np.array([k for _, k in sorted(of)], np.uint64))
    return pa.Table.from_batches([box.flush()])


def test_large_groups_of_differences_are_compared_in_bounded_memory():
    import resource

    m, rng = 20_000, np.random.default_rng(7)
    rows = [(i, int(rng.integers(8, 20)), i, 150, 1, 1) for i in range(m)]  # all share their first difference, and nothing else
    group = group_of(rows, [(5, i, 0) for i in range(m)])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    kinds = Counter(ngram_jaccard._met(group, 75, 2048).column("kind").to_pylist())
    assert kinds == {ngram_jaccard._STAR: m - 1}  # a star of the next round, not pairs
    keys, docs, spots, *_ = ngram_jaccard._unpacked(group, ngram_jaccard._CHANGED)
    docs["pref"] = np.sort(rng.integers(0, 4000, m))  # few are near enough
    assert len(ngram_jaccard.matched(keys, docs, spots, 75)) < 5_000_000  # of 200 million: 44 differences apart at most
    docs["comp"] = 1  # and none of one component is a pair
    docs["pref"] = 9
    assert len(ngram_jaccard.matched(keys, docs, spots, 75)) == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000 and time.perf_counter() - began < 60


def test_matched_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(11)
    for _ in range(60):
        rows = [(i, int(rng.integers(1, 30)), int(rng.integers(0, 5)), int(rng.integers(20, 60)), int(rng.integers(0, 10)), int(rng.integers(0, 12))) for i in range(30)]
        entries = sorted({(int(rng.integers(0, 6)), int(rng.integers(0, 30))) for _ in range(120)}, key=lambda e: (e[0], rows[e[1]][1], e[1]))
        docs, spots = np.array([rows[i] for _, i in entries], ngram_jaccard._CHANGED), rng.integers(0, 12, len(entries))
        want = set()
        for i, (k, a) in enumerate(entries):
            for j in range(i + 1, len(entries)):
                (k2, b), (_, p, ca, na, index, _), (_, q, cb, nb, _, probe) = entries[j], rows[a], rows[entries[j][1]]
                most = ngram_jaccard.apart(na, nb, 75) + ngram_jaccard._SLACK
                if k == k2 and ca != cb and spots[i] < index and spots[j] < probe and 100 * min(na, nb) >= 75 * max(na, nb) and q - p <= most and 2 * spots[i] <= most - q + p and 2 * spots[j] <= most + q - p:
                    want.add((a, b))
        got = ngram_jaccard.matched(np.array([k for k, _ in entries], np.uint64), docs, spots, 75)
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_one_row_of_each_class_stays(spark):
    a, b = "a b c d e f g", "q r s t u v w x"
    ids, texts = [3, 5, 5, 7, 7, 9, 9, None, None, 8, None], [a, a, b, a, b, "", "", b, "z y x w v", "k l m n o p", None]
    rows = [(i, t, "en", "s", 0, "k", "n", 0.5) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame([*rows, rows[9], rows[0]], SCHEMA)
    kept = ngram_jaccard.keep_one(docs)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in kept.collect())
    assert got == sorted([(3, a), (5, b), (9, ""), (9, ""), (-1, "z y x w v"), (8, "k l m n o p"), (-1, "")])
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, ngram_jaccard.keep_one(docs, broadcast_rows=0).collect()))
    assert ngram_jaccard.keep_one(docs.limit(0)).count() == 0


def test_components_are_those_of_the_graph(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_template_language():
    t = chat_format.Template("{{ bos }}{% for message in messages %}{% if message.role == 'a' and not loop.first %}A{% elif 1 == 2 %}never{% else %}{{ message.text | trim | upper }}{% endif %}{% if loop.last %}!{% endif %}{% endfor %}E{{ 'x' + 'y' }}", bos="B")
    assert t.render([{"role": "a", "text": " q ", "turn": 0}, {"role": "a", "text": "r", "turn": 1}])[0] == "BQA!Exy"
    assert t.tree[2] == (chat_format.Emit(chat_format.Const("Exy")),)  # folded
    for bad in ("{{ open('x') }}", "{{ message.__class__ }}", "{{ x }}", "{% if true %}", "{% endfor %}", "{{ message.text | eval }}", "{{ }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(bad)


def test_escaping_is_reversible_and_breaks_every_control_string():
    rng = np.random.default_rng(1)
    e = chat_format.Escaper(("<s>", "</s>", "[INST]", "[/INST]", "ss", "sss"))
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "s", "<", "[", "\n", "é", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        out = e.escape(text)
        assert e.unescape(out) == text
        assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]", "ss"))


def test_conversations_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (2, 1, "assistant", "b\\"), (2, 0, "system", ""), (2, 1, "assistant", "b\\"), (None, 0, "user", "x"), (3, 0, "[/ROLE]", "</s")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        a = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(a)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(a.encode()).hexdigest()
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# --- 4 and 6 --------------------------------------------------------------------------------------------------------


def vocabulary(name):
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKENS = [*AWKWARD, "it's We'LL  \n\n x", "<|endoftext|> and <|startoftext|>", "naïve Ärger ñandú ½ ²", "12 345", "Σ"]


def test_shards_read_back(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = [None, 5, -3, 5, *range(10, 10 + len(TOKENS) - 4)]
    shards = sst.write_shards(docs_of(spark, TOKENS, ids), vocabulary("byte_bpe_50k.json"))
    got = sorted(((r["shard"], r["place"]), r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in sst.read_shards(shards).collect())
    want = [(i, (*lib.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in sorted(zip(ids, TOKENS, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    assert [g[1:] for g in got] == want
    starts = {r["shard"]: r["before"] for r in sst.shard_starts(shards).collect()}
    assert min(starts.values()) == 0
    found = sst.lookup(shards, [5, 10, 999]).collect()
    assert Counter(r["doc_id"] for r in found) == {5: 2, 10: 1}
    found = sst.lookup(shards, [None, *range(5, 4005)]).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i in ids if i is None or i >= 5)
    assert sst.lookup(shards, []).count() == 0
    with pytest.raises(ValueError):
        sst.lookup(shards, [1, 2, 3], most_ids=2)
    assert sst.write_shards(docs_of(spark, []).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_shard_format():
    w = sst.ShardWriter()
    docs = [(None, 0), *((3 * k - 1500, k % 90) for k in range(4000))]
    for i, n in docs:
        w.add(i, np.arange(n, dtype=np.uint32) * (1 if n % 2 else 1000))
    with pytest.raises(ValueError):
        w.add(-9999, np.zeros(1, np.uint32))
    s = sst.Shard(w.finish())
    assert [(i, len(x)) for i, x in s] == docs and len(s.index) > 1
    assert all(len(s.get(i)) == 1 for i, _ in docs[::97]) and s.get(1) == []
    assert sum(s.may_hold(10**9 + k) for k in range(2000)) < 60
    assert all(sst.tail_may_hold(w.tail, [i]) for i, _ in docs[::97]) and not sst.tail_may_hold(w.tail, [])
    assert sum(sst.tail_may_hold(w.tail, [10**9 + k]) for k in range(2000)) < 60
    with pytest.raises(ValueError):
        sst.Shard(b"x" * 100)


def test_vocabularies_of_another_make_are_refused():
    with pytest.raises(ValueError):
        sst.CachedEncoder(vocabulary("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        forced_bpe.ForcedBoundaryBpe(vocabulary("byte_bpe_50k.json"))


def test_forced_boundaries_give_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = forced_bpe.encode(docs_of(spark, TOKENS), path, "doc_id", "key").collect()
    for r in rows:
        want = lib.encode(TOKENS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
    encoded = forced_bpe.encode(docs_of(spark, TOKENS), path, "doc_id")
    for r in forced_bpe.decode(encoded, path, "doc_id").collect():
        assert r["decoded"] == lib.decode(lib.encode(TOKENS[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)
    coder = forced_bpe.coder(path)
    assert len(coder.cuts("abcé".encode().decode("latin-1").translate(sst.byte_letters()))) >= 1
    assert forced_bpe.encode(docs_of(spark, []).limit(0), path, "doc_id").count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------


def measures_by_force(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    inside = set()
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_rules_and_host_verdicts(spark):
    rng = np.random.default_rng(4)
    texts = [*AWKWARD, "a b c a b c\na b c a b c\n # x", "a a a a", *(prose(rng, 80) for _ in range(30))]
    got = host_rules.judge(docs_of(spark, texts), max_host_rate=2).collect()
    for r in got:
        m = measures_by_force(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and r["kept"] == (not r["base_failed"])
    junk = spark.createDataFrame([(i, "x", "bad") for i in range(60)] + [(100 + i, prose(rng, 80), "bad" if i < 3 else "good") for i in range(60)], "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r["kept"] for r in host_rules.judge(junk).collect()}
    assert not verdict[100] and verdict[110] and not verdict[0]
    assert host_rules.judge(junk.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_radius_search_finds_all_pairs():
    rng = np.random.default_rng(9)
    items = decontam.Items(list(range(40)), [prose(rng, int(rng.integers(20, 60))) for _ in range(40)])
    for c, of in items.classes.items():
        prints = np.concatenate([of["prints"][rng.integers(0, len(of["prints"]), 300)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 12)).astype(np.uint64), axis=1), rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)])
        got = set(zip(*(x.tolist() for x in items.candidates(c, prints)), strict=True))
        far = np.bitwise_count(prints[:, None] ^ of["prints"][None])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS)), strict=True))


def test_changed_runs_of_words_lose_no_leak():
    rng = np.random.default_rng(12)
    prose = lambda rng, n: " ".join(f"w{i}" for i in rng.integers(0, 20_000, n))
    texts = [prose(rng, int(n)) for n in rng.choice([30, 60, 94, 126, 229, 309], 60)]
    items = decontam.Items(list(range(len(texts))), texts)
    docs, owner = [], []
    for i, t in enumerate(texts):
        w, n = t.split(), len(t.split())
        for kind in range(3):
            run = max(1, int(n * rng.uniform(0.07, 0.125)))
            at = int(rng.integers(3, n - run - 3))
            new = prose(rng, run).split()
            body = (w[:at] + new + w[at + run :], w[:at] + new + w[at:], w[:at] + w[at + run :])[kind]
            docs.append(" ".join([prose(rng, 20), *body, prose(rng, 20)]))
            owner.append(i)
    column = pa.array(docs, pa.string())
    hashes, first = decontam._text.word_hashes(*decontam._text.buffers(column))
    want = set()
    for d, i in enumerate(owner):
        own, n = hashes[first[d] : first[d + 1]], len(items.words[i])
        if max(items.similarity(i, own[b : b + n]) for b in range(len(own))) >= 0.75:
            want.add((d, i))
    found = items.leaks(hashes, first, 0.75)
    assert len(want) > 100 and want <= set(found)


def test_edited_passages_are_found_whatever_the_edits():
    rng = np.random.default_rng(21)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 20_000, n)]
    texts = [prose(int(n)) for n in rng.integers(15, 120, 150)]
    items = decontam.Items(list(range(len(texts))), [" ".join(t) for t in texts])
    docs, passages, owner = [], [], []
    for i, t in enumerate(texts):
        for edits in (1, 2, 3, 4):
            for kind in range(3):
                w = list(t)
                for _ in range(edits):
                    at = int(rng.integers(0, len(w)))
                    w[at : at + (kind != 1)] = prose(1) if kind < 2 else []
                docs.append(" ".join([*prose(30), *w, *prose(30)]))
                passages.append(" ".join(w))
                owner.append((i, edits, kind))
    hashes, first = _text.word_hashes(*_text.buffers(pa.array(docs)))
    own, own_first = _text.word_hashes(*_text.buffers(pa.array(passages)))
    want = {(d, i) for d, (i, _, _) in enumerate(owner) if items.similarity(i, own[own_first[d] : own_first[d + 1]]) >= 0.75}
    found = items.leaks(hashes, first, 0.75)
    assert len(want) > 700 and len(want - set(found)) <= 0.01 * len(want)
    assert all(owner[d][0] == i for d, i in found)
    for (d, i), (like, at) in found.items():
        assert like >= 0.75 and 0 <= at < first[d + 1] - first[d]


def test_repeated_phrases_around_a_passage_lose_no_leak():
    """Headings, refrains and tails repeat some of the item's words before, within and after the edited passage."""
    rng = np.random.default_rng(23)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 20_000, n)]
    texts = [prose(int(n)) for n in rng.integers(12, 50, 40)]
    for t in texts[::3]:
        t[-6:] = t[:6]  # the item's own first words return at its end
    items = decontam.Items(list(range(len(texts))), [" ".join(t) for t in texts])
    docs, owner = [], []
    for i, t in enumerate(texts):
        for kind in range(4):
            w = list(t)
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(1, len(w)))
                w[at : at + int(rng.integers(0, 2))] = prose(1) if rng.random() < 0.6 else []
            n = int(rng.integers(6, 10))
            body = ([*t[:n], *w], [*w, *t[-n:]], [*t[:n], *prose(3), *w, *t[2 : 2 + n]], [*w[: len(w) // 2], *t[:n], *w[len(w) // 2 :]])[kind]
            docs.append(" ".join([*prose(25), *body, *prose(25)]))
            owner.append(i)
    hashes, first = _text.word_hashes(*_text.buffers(pa.array(docs)))
    found, want = items.leaks(hashes, first, 0.75), set()
    for d, i in enumerate(owner):
        own = hashes[first[d] : first[d + 1]]
        n = len(items.words[i])
        if max(items.similarity(i, own[b : b + size]) for b in range(15, len(own) - 15) for size in range(max(5, 3 * n // 4), 4 * n // 3 + 2)) >= 0.75:
            want.add((d, i))
    assert len(want) > 70 and want <= set(found)
    for (d, i), (like, _) in found.items():
        assert i == owner[d] and like >= 0.75


def test_best_window_is_the_best_of_all():
    rng = np.random.default_rng(24)
    for _ in range(40):
        words = rng.integers(1, 9, int(rng.integers(6, 40))).astype(np.uint64)
        item = decontam.Items([0, 1], [" ".join(map(str, rng.integers(1, 9, 9))), "other words"])
        item.sets[0] = np.unique(_text.shingles(words[3:15], np.array([0, len(words[3:15])]), 5)[0])
        of = _text.shingles(words, np.array([0, len(words)]), 5)[0]
        weight = dict(zip(of.tolist(), item.weight(of).tolist(), strict=True))
        own = set(item.sets[0].tolist())
        value = lambda a, n: sum(weight[s] * (1 if s in own else -0.75) for s in set(of[a : a + n - 4].tolist()))  # noqa: B023, E731
        best = max(value(a, n) for a in range(len(words) - 4) for n in range(5, len(words) - a + 1))
        if best > 0:
            assert abs(value(*item.best_window(0, words, 0.75)) - best) < 1e-9


def test_items_of_any_type_weigh_alike_in_groups(spark):
    rng = np.random.default_rng(22)
    shared = prose(rng, 30)
    items = [f"{shared} {prose(rng, 12)}" for _ in range(30)]
    bench = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    docs = docs_of(spark, [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for t in items] + [f"{prose(rng, 9)} {shared} {prose(rng, 9)}"])
    rows = [sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontam.find_leaks(docs, bench, most_items=m).collect()) for m in (1000, 7)]
    assert rows[0] == rows[1] and {(i, f"q{i}") for i in range(30)} <= {(d, i) for d, i, _ in rows[0]}


def test_leaks_near_copies_and_clean_documents(spark):
    rng = np.random.default_rng(10)
    items = [prose(rng, int(n)) for n in rng.integers(14, 60, 30)] + ["short one here", None, "  "]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    texts, want = list(AWKWARD), set()
    for i in range(0, 31, 2):
        w = items[i].upper().split() if i % 4 else items[i].split()
        if len(w) > 45:
            w[20] = "changed"
        want.add((len(texts), i))
        texts.append(" ".join([prose(rng, 40), *w, prose(rng, 30)]) if i % 3 else " ".join(w))
    texts += [prose(rng, 200) for _ in range(40)]
    docs = docs_of(spark, texts)
    got = decontam.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(0.75 <= r["similarity"] <= 1 + 1e-9 for r in got)
    kept = decontam.clean(docs, bench, most_items=10)  # in groups of items
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert kept.columns == docs.columns
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------------


def katz_by_force(rows):
    tokens = [(i, [*words(t), None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c1, c2 = Counter(), Counter()
    for _, t, out in tokens:
        if not out:
            c1.update(t)
            c2.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c1.values()), len(c1)
    of = lambda c: katz.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, katz.SMALL + 2)]))
    d1, d2 = of(c1), of(c2)
    cut = lambda c, d: d[c - 1] * c if c <= katz.SMALL else c - katz.TAIL
    p1 = {w: cut(c, d1) / n for w, c in c1.items()}
    unknown = 1 - sum(p1.values()) if n else 1.0
    hist, mass, seen = Counter(), defaultdict(float), defaultdict(float)
    for (h, w), c in c2.items():
        hist[h] += c
        mass[h] += cut(c, d2)
        seen[h] += p1[w]
    alpha = {h: (1 - mass[h] / hist[h]) / (1 - seen[h]) for h in hist}
    p = lambda h, w: cut(c2[h, w], d2) / hist[h] if (h, w) in c2 else alpha.get(h, 1.0) * p1.get(w, unknown)
    for h in list(alpha)[:20]:
        assert sum(p(h, w) for w in c1) + alpha[h] * unknown == pytest.approx(1)
    return [(i, out, len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True))) for i, t, out in tokens]


def test_discounts_are_good_turings():
    """By hand: r* = (r + 1) n(r + 1) / n(r), renormalised so that counts above the last discounted one stay whole."""
    n = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75, 7: 60}
    got = katz.discounts(np.array([n[r] for r in range(1, katz.SMALL + 2)]))
    last = katz.SMALL
    share = (last + 1) * n[last + 1] / n[1]
    for r in range(1, last + 1):
        better = (r + 1) * n[r + 1] / n[r]
        assert abs(got[r - 1] - (better / r - share) / (1 - share)) < 1e-12 and 0 < got[r - 1] < 1
    # what the discounts take from seen types is what Good and Turing leave for unseen ones: n(1)
    assert abs(sum(r * n[r] * (1 - got[r - 1]) for r in range(1, last + 1)) - n[1]) < 1e-9
    assert all(0 < d < 1 for d in katz.discounts(np.zeros(last + 1)))


def test_katz_scores_do_not_depend_on_arrow_batches(spark):
    docs = spark.range(0, 130_000).select(F.lit(2).alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
        got = katz.score(docs).groupBy("n_known", F.round("base_score", 3).alias("base")).count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == [(3, -1.431, 130_000)]


def test_katz_scores_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = [*AWKWARD, *(prose(rng, int(n)) for n in rng.integers(1, 60, 80))]
    ids = [*range(len(texts) - 2), 3, None]
    want = sorted(((x[0] is None, x[0] or 0, x[2]), x) for x in katz_by_force(list(zip(ids, texts, strict=True))))
    for hot_share in (0.25, -0.01):  # in the second, words of a hundred tokens and more are hot
        scored = katz.score(docs_of(spark, texts, ids), block_tokens=500, hot_share=hot_share)
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]), r) for r in scored.collect())
        assert len(got) == len(want)
        for (k, r), (l, x) in zip(got, want, strict=True):
            assert k == l and (r["held_out"], r["n_known"], r["train_tokens"]) == (x[1], x[3], x[4])
            assert r["base_score"] == pytest.approx(x[5], rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(x[6], rel=1e-9, abs=1e-9)


def test_katz_parts_of_many_units_give_the_same_scores(spark):
    """A document's sums leave a part once, not once for each unit of its words."""
    rng = np.random.default_rng(13)
    texts = [*AWKWARD, *(prose(rng, int(n)) for n in rng.integers(1, 60, 40)), "often " * 900]
    want = {x[0]: x for x in katz_by_force(list(enumerate(texts)))}
    size = sum(len((t or "").encode()) for t in texts)
    got = katz.score(docs_of(spark, texts), block_tokens=500, unit_bytes=size // (16 * spark.sparkContext.defaultParallelism)).collect()
    assert len(got) == len(want)
    for r in got:
        x = want[r["doc_id"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (x[1], x[3], x[4])
        assert r["base_score"] == pytest.approx(x[5], rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(x[6], rel=1e-9, abs=1e-9)


def ngram_model_by_force(rows, order):
    """P(w | history) of a Katz model as a function, from counts alone."""
    counts = [Counter() for _ in range(order)]
    for t in rows:
        w = [b""] * (order - 1) + words(t) + [None]
        for i in range(order - 1, len(w)):
            for k in range(order):
                counts[k][tuple(w[i - k : i + 1])] += 1
    cuts = []
    for c in counts:
        d = katz.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, katz.SMALL + 2)]))
        cuts.append(lambda n, d=d: d[n - 1] * n if n <= katz.SMALL else n - katz.TAIL)
    total = sum(counts[0].values())
    followers = defaultdict(list)
    for c in counts[1:]:
        for g in c:
            followers[g[:-1]].append(g)

    def p(gram):
        k = len(gram) - 1
        if k == 0:
            return cuts[0](counts[0][gram]) / total if gram in counts[0] else 1 - sum(cuts[0](n) for n in counts[0].values()) / total
        n = sum(counts[k][g] for g in followers[gram[:-1]])
        if gram in counts[k]:
            return cuts[k](counts[k][gram]) / n
        if not n:
            return p(gram[1:])
        left = 1 - sum(cuts[k](counts[k][g]) for g in followers[gram[:-1]]) / n
        return left / (1 - sum(p(g[1:]) for g in followers[gram[:-1]])) * p(gram[1:])

    return p


def test_stored_tables_score_other_documents(spark, tmp_path):
    rng = np.random.default_rng(14)
    few = lambda n: " ".join(rng.choice(WORDS[:12], n))
    train, other = [*AWKWARD[:5], *(few(int(n)) for n in rng.integers(1, 30, 40))], [None, "", "w1 unheard w2 w3", "W1 w2 w3", *(few(15) for _ in range(10))]
    for order in (3, 2):
        tables = katz.learn(docs_of(spark, train), order)
        tables.save(str(tmp_path / f"t{order}"))
        got = {r["doc_id"]: r for r in katz.evaluate(docs_of(spark, other), katz.Tables.load(spark, str(tmp_path / f"t{order}"))).collect()}
        p = ngram_model_by_force(train, order)
        for i, t in enumerate(other):
            w = [b""] * (order - 1) + words(t) + [None]
            want = sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w)))
            assert got[i]["n_tokens"] == len(w) - order + 1 and got[i]["score"] == pytest.approx(want, rel=1e-9, abs=1e-9)
    own = docs_of(spark, train)
    bigrams = {r["doc_id"]: r["score"] for r in katz.score(own, held_out="false").collect()}
    again = {r["doc_id"]: r["score"] for r in katz.evaluate(own, katz.learn(own, 2)).collect()}
    assert again == {i: pytest.approx(x, rel=1e-9) for i, x in bigrams.items()}
    assert katz.evaluate(own.limit(0), tables).count() == 0 and katz.learn(own.limit(0)).unknown == 1.0


def test_katz_without_training_rows_or_rows(spark):
    r = katz.score(docs_of(spark, ["a b"]), held_out="true").first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
    assert katz.score(docs_of(spark, []).limit(0)).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------------------


def test_machine_learns_words_and_their_pairs(spark):
    rng = np.random.default_rng(13)
    texts, labels = [], []
    for i in range(900):
        w = list(rng.choice(WORDS, 30))
        a, b = i % 4 in (0, 1), i % 4 in (0, 2)
        w += ["insolent"] * a + ["groupname"] * b
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(a and b))
    docs = docs_of(spark, [*texts, None, ""])
    table = spark.createDataFrame([(i, y, 9) for i, y in enumerate(labels)] + [(0, 1, 9), (None, 1, 9), (5, None, 9)], "doc_id long, toxic int, text int")
    m = fm_toxicity.train(docs, table)
    got = {r["doc_id"]: r["score"] for r in fm_toxicity.score(docs, m, "doc_id").collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i] for i in held]) > 0.97  # no single word tells
    assert got[900] == got[901] and 0 <= got[900] < 0.5
    kept = fm_toxicity.clean(docs, table)
    assert kept.columns == docs.columns and {900, 901} <= {r["doc_id"] for r in kept.collect()}
    assert fm_toxicity.score(docs.limit(0), m, "doc_id").count() == 0
    again = docs.unionAll(docs).unionAll(docs.withColumn("text", F.lit("insolent groupname again")))
    few = fm_toxicity.train(again, table, max_labelled=200)  # rows that repeat ids don't pass the bound
    assert len(few.slots) < len(m.slots)
    nothing = fm_toxicity.train(docs, table.limit(0))
    assert fm_toxicity.score(docs, nothing, "doc_id").first()["score"] == 0.5


# --- 10 -----------------------------------------------------------------------------------------------------------

_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def pii_by_force(t):
    def ok(k, s):
        d = re.sub(r"[^0-9]", "", s)
        return [True, k == 1 and all(int(x) <= 255 for x in s.split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15][k]

    return sorted((k, m.start(), m.end()) for k, p in enumerate(_PATTERNS) for m in re.finditer(p, t) if ok(k, m[0]))


def test_personal_data_equals_the_patterns():
    rng = np.random.default_rng(14)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (415) 555-0101", "+", "5", " ", "-", "x", "é", "(", "١", "12345678901234567890"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts, rng.integers(0, 8)))
        assert [s for s in pii.spans(t) if s[0] < 4] == pii_by_force(t), t


def test_long_hostile_texts_take_linear_time():
    n = 1_000_000
    for part in ("mailto:", "account ", "account" + " " * 5000, "+1(", "1.", "1 ", "a@", "@", "iban DE89 ", "http://x", "acct no. ", "1-"):
        text = (part * (n // len(part) + 1))[:n]
        began = time.process_time()
        pii.spans(text)
        assert time.process_time() - began < 8, part  # some seconds for a square, at most two or three for lines


def test_personal_data_beyond_the_patterns(spark):
    t = "see ftp://bob:pw@host/x, IBAN: DE89 3704 0044 0532 0130 00 or account no. 12345678"
    kinds = {pii.KINDS[k]: t[a:b] for k, a, b in pii.spans(t) if k > 3}
    assert kinds["login"] == "bob:pw" and kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["account"] == "12345678"
    rows = pii.find_pii(docs_of(spark, [*AWKWARD, "a@b.c"])).collect()
    assert [x["kind"] for r in rows for x in r["pii"]] == ["email"] and len(rows) == len(AWKWARD) + 1
    assert pii.find_pii(docs_of(spark, []).limit(0)).count() == 0


# --- the registered queries -------------------------------------------------------------------------------------------


def test_queries_give_the_rows_of_their_sql(spark, sf):
    import duckdb

    from terralens.llm import queries

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op2_ngram_jaccard", "op3_chat_format", "op5_host_rules", "op10_pii"):
        got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


# --- the pipeline ---------------------------------------------------------------------------------------------------


def leaks_by_force(text, items):
    """Items of which some window of the text reaches 0.75, from words alone."""
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = {i: shingled(w) for i, w in items.items() if w}
    df = Counter(s for x in sets.values() for s in x)
    weight = lambda x: sum(math.log1p(len(sets) / df.get(s, 1)) for s in x)
    w, found = words(text), set()
    own = shingled(w)
    for i, s in sets.items():
        if len(own & s) >= 0.3 * len(s):
            n = len(items[i])
            at = [k for k in range(len(w)) if tuple(w[k : k + 5]) in s or tuple(w) in s]
            for begin in at:
                for size in range(max(1, int(0.7 * n)), int(1.4 * n) + 2):
                    x = shingled(w[begin : begin + size])
                    if weight(x & s) >= 0.75 * weight(x | s) - 1e-9:
                        found.add(i)
                        break
    return found


def test_scores_are_sums_over_pairs_of_terms(spark):
    rng = np.random.default_rng(3)
    texts = ["insolent groupname w1 w2", "groupname", "insolently W1", "", *(prose(rng, 20) + " insolent" * (i % 3 == 0) + " groupname" * (i % 2) for i in range(300))]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int("insolent" in t and "groupname" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    m = fm_toxicity.train(docs, labels)
    place = {int(s): k for k, s in enumerate(m.slots)}
    got = {r["doc_id"]: r["score"] for r in fm_toxicity.score(docs, m, "doc_id").collect()}
    for i, t in enumerate(texts[:40]):
        terms = {(k, w.decode()[:cut]) for w in words(t) for k, cut in enumerate((None, 4, 6))}
        slots = set()
        for k, term in terms:
            h, _ = _text.word_hashes(*_text.buffers(pa.array([term])))
            slots.add(int(_text.mix(h + np.uint64(k))[0] >> np.uint64(64 - 18)))
        used = sorted(place[s] for s in slots if s in place)
        z = m.bias + sum(m.weight[k] for k in used) + sum(float(m.vectors[a] @ m.vectors[b]) for a in used for b in used if a < b)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_stages_on_awkward_and_on_no_rows(spark, sf):
    import corpus_pipeline as p

    texts = [*AWKWARD, "one two three four five six", "one two three four five six", 'password = "abcdefghijklmnop"', None]
    ids = [*range(len(texts) - 1), None]
    docs = docs_of(spark, texts, ids).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    kept = p.near_duplicates(spark, docs, sf)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, *(i for i in range(len(texts) - 1) if texts[i] != texts[i - 1] or not texts[i])]
    for name, stage in p.STAGES[:1] + p.STAGES[2:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == len(texts), name
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.secrets(spark, docs, sf).collect()}
    assert clean[0] == (None, None) and clean[len(texts) - 2][0] == '[SECRET]"' and clean[1] == ("", 0)
    ids_of = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"])) for r in p.encoding(spark, docs, sf).collect()}
    assert ids_of[None] == ids_of[0] == ids_of[1] == (0, b"") and ids_of[6] == ids_of[7]


def test_columns_may_be_called_as_the_operators_call_theirs(spark):
    rng = np.random.default_rng(31)
    names = ["__rules", "__text", "__toxicity", "__row", "__key", "__ROW", "key", "rules", "row"]
    texts = [prose(rng, 60), None, "token = abcdef123456789", prose(rng, 40)]
    df = docs_of(spark, texts).drop("key")
    for k, n in enumerate(x for x in names if x != "__ROW"):
        df = df.withColumn(n, F.lit(f"kept{k}"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string")
    want = {tuple(r) for r in df.drop("text").collect()}
    for out in (secret_scan.scan(df).drop("secrets"), decontam.clean(df, bench), ngram_jaccard.keep_one(df), forced_bpe.encode(df, forced_bpe.vocabulary_path(), *[c for c in df.columns if c != "text"]).drop("ids")):
        assert {tuple(r) for r in out.drop("text").select(*[c for c in df.columns if c != "text"]).collect()} == want
    assert set(fm_toxicity.clean(df, labels).columns) == set(df.columns)


def test_account_codes_far_from_their_cue():
    for n in (0, 1, 57, 60, 500):
        text = "IBAN" + " " * n + ":DE89370400440532013000 x"
        assert (5, 5 + n, 27 + n) in pii.spans(text)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    machine = fm_toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in fm_toxicity.score(docs, machine, "doc_id").filter("score >= 0.5").collect()}
    left = {i: t for i, t in left.items() if i not in toxic}
    left = {i: left[i] for i, (_, c) in classes_by_force(list(left.items())).items() if c == i}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    out = {}
    for i, t in left.items():
        if not leaks_by_force(t, items):
            spans = [(a, e) for a, _, e in spans_by_re(t)]
            at, text = 0, ""
            for a, e in spans:
                text += t[at:a] + ("[SECRET]" if a >= at else "") if a >= at else ""
                at = max(at, e)
            out[i] = text + t[at:]
    coder = forced_bpe.coder(forced_bpe.vocabulary_path())
    got = {r["doc_id"]: bytes(r["ids"]) for r in p.run(spark, sf).collect()}
    assert got == {i: coder.encode(t) for i, t in out.items()}
    assert json.dumps(sorted(got))
