"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from alphaloom.llm import chat, embedding_dedup, exact_dedup, mixing, ngram_join, packing, quality, token_counts, toxicity, warc
from alphaloom.llm.tokenizer import encoder

SPACES = r"[\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, gid long, kept boolean"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, blanks of all kinds, nulls, empties and a long one."""
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0]] * 30 + [texts[1].replace(" ", "  "), None, "", " ", "\n", None, "x", "a b", "a b"]
    for k in range(2, 12):
        w = texts[k].split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [words(rng, 30_000), "tab\there  three   spaces \n mixed \n", "<|endoftext|> plain", "née Ünïcode 日本 don't I'll 12345 a@b.org"]
    base = words(rng, 200).split()
    for k in range(40):  # a large group of near copies, all different
        w = list(base)
        w[rng.randrange(200)] = f"v{k}"
        texts.append(" ".join(w))
    return [(i, t, "en", [None, "a", "b", "c"][i % 4 if i % 3 else 1], None if t is None else len(t), 7, 8, True) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups(docs, rows, spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, first_width=4, factor=2).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(SPACES, " ", t or "")].append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_groups_with_repeated_and_null_ids(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (1, "b")], "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in got) == 2 and Counter(r["group_size"] for r in got) == {3: 3, 2: 2}


def brute_links(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return sets, links


@pytest.mark.parametrize(("block", "weight"), [(512, 1 << 20), (8, 1 << 20), (512, 700)])
def test_near_duplicates(docs, rows, spark, block, weight, monkeypatch):
    """Links equal brute force, whole or with nodes dealt by classes or by shingles, in batches of few bytes."""
    monkeypatch.setattr(ngram_join, "SHIPPED", ngram_join.SHIPPED if weight > 700 else 1)
    sets, links = brute_links(rows)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs, block=block, weight=weight).collect()}
    assert len(got) == len(rows)
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["class_id"]) == (len(links[i]), min(seen)), i
    if block == 8:
        assert ngram_join.near_duplicates(empty(spark)).count() == 0
        odd = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in odd} == {(None, None, 0), (1, 1, 1)}


def test_near_duplicates_that_repeat_an_id(spark):
    """Rows of one doc_id with other texts are documents of their own; of a class one text stays."""
    rng = random.Random(8)
    a, b = words(rng, 150), words(rng, 150)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, b + " x"), (4, words(rng, 9)), (None, a)]
    got = ngram_join.near_duplicates(spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, rep int, node string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got) == {(1, 1, 1, True): 1, (1, 1, 2, True): 1, (2, 1, 1, False): 1, (3, 1, 2, False): 2, (4, 4, 0, True): 1, (None, None, 0, True): 1}


def test_nodes_of_the_sorted_tries_are_shared_prefixes():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 3, (50, ngram_join.TREES * ngram_join.DEPTH)).astype(np.uint32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(range(50), pa.int32())], ["rep", "sig", "size"])
    (labels,) = ngram_join._labels([batch])
    labels = pa.RecordBatch.from_arrays([c for c in labels.take(pa.array(sorted(range(len(labels)), key=lambda k: labels.column(0)[k].as_py()))).columns], ["label", "rep", "size"])
    for depth in (6, 2, 1):
        want = defaultdict(set)
        for rep in range(50):
            for t in range(ngram_join.TREES):
                want[t, *sig[rep].reshape(ngram_join.TREES, -1)[t, :depth].tolist()].add(rep)
        got = defaultdict(set)
        for part in ngram_join._members(depth)([labels.slice(0, 301), labels.slice(301)]):
            for node, rep in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                got[node[0], *np.frombuffer(node[1:], ">u4").tolist()].add(rep)
        assert all(got[k] == m for k, m in want.items() if len(m) > 1)
        n, size = Counter(), Counter()
        for part in ngram_join._nodes(depth)([labels.slice(0, 301), labels.slice(301)]):
            for node, k, held in zip(*(part.column(c).to_pylist() for c in (0, 1, 2))):
                n[node[0], *np.frombuffer(node[1:], ">u4").tolist()] += k
                size[node[0], *np.frombuffer(node[1:], ">u4").tolist()] += held
        assert all(size[k] == sum(m) for k, m in want.items() if len(m) > 1)
        assert {k: v for k, v in n.items() if v > 1} == {k: len(m) for k, m in want.items() if len(m) > 1}
        shared = ngram_join.shared_prefix(sig, 3, depth)
        assert all(shared[i, j] == (sig[i].reshape(24, 6)[3, :depth] == sig[j].reshape(24, 6)[3, :depth]).all() for i in range(50) for j in range(50))


def test_prefixes_are_shortened_until_the_recall_is_met(docs, rows, spark, monkeypatch):
    """With few trees, links are missed at the deepest prefixes, and the audit or the estimate says so."""
    depths = []
    whole = ngram_join._match
    monkeypatch.setattr(ngram_join, "_match", lambda *args: depths.append(args[3]) or whole(*args))
    sets, links = brute_links(rows)
    monkeypatch.setattr(ngram_join, "estimated_recall", lambda pairs, depth: 0.5 if depth > 4 else 1.0)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(docs).collect()}
    assert depths == [6, 5, 4] and all(got[i] == len(links[i]) for i in sets)
    pairs = np.zeros(ngram_join.STEPS + 1, int)
    pairs[[160, 180, 200]] = 100, 50, 10
    want = sum(n for n in (100, 50, 10)) / sum(n / (1 - (1 - s**6) ** 24) for n, s in ((100, 0.8), (50, 0.9), (10, 1.0)))
    monkeypatch.undo()
    assert ngram_join.estimated_recall(pairs, 6) == pytest.approx(want)
    truth = {(1, 1): 3, (2, 2): 1, (3, 3): 0}
    classes = spark.createDataFrame([(10, 1, 1, 2), (20, 2, 2, 1)], "rep long, set_a long, set_b long, copies long")
    shown = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)], "doc_id long, print long, set_a long, set_b long")
    found = spark.createDataFrame([(10, 1), (10, 1)], "rep long, links long")
    assert ngram_join.measured_recall(truth, classes, shown, [found]) == 0.5


def test_token_tree_equals_encoding_anew():
    enc, rng = encoder(), random.Random(5)
    count = lambda t: len(enc.plain.encode_ordinary(t))
    text = "".join(rng.choice([" ", "  ", "\n", " \n ", "ab", "Zeta", "12", "'s", "!?", "é", "日"]) for _ in range(4000))
    tree = token_counts.TokenTree(text, count)
    assert tree.total == count(text)
    for _ in range(150):
        a = rng.randrange(len(tree.text) + 1)
        b = min(len(tree.text), a + rng.choice([0, 1, 3, 40]))
        new = rng.choice(["", " ", "x", " y  ", "\n", "long words here " * 30])
        want = tree.text[:a] + new + tree.text[b:]
        tree.edit(a, b, new)
        assert tree.text == want and tree.total == count(want)


def test_token_counts(docs, rows, spark):
    whole = encoder().whole
    n = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    got = {r["doc_id"]: r for r in token_counts.recount(docs).collect()}
    for i, t, *_ in rows:
        new = token_counts.REDACT.sub(lambda m: "<email>" if "@" in m[0] else "0", t or "")
        assert (got[i]["n_tokens"], got[i]["n_tokens_after"]) == (n(t or ""), n(new)), i
    edits = spark.createDataFrame([(59, 2, 5, "new"), (59, 3, 4, "lost"), (59, 7, 7, " in "), (59, 10**7, 10**7, "x")], "doc_id long, start long, end long, new string")
    one = token_counts.recount(docs, edits).filter("doc_id = 59").first()
    t = rows[59][1]
    assert one["n_skipped"] == 2 and one["n_tokens_after"] == n(t[:2] + "new" + t[5:7] + " in " + t[7:])
    odd = spark.createDataFrame([(59, None, 5, "a", "b"), (59, 2, None, "a", "b"), (59, 2, 4, None, "b"), (None, 0, 1, "x", "b")], "doc_id long, start long, end long, new string, text string")
    one = token_counts.recount(docs, odd).filter("doc_id = 59").first()
    assert (one["n_edits"], one["n_skipped"], one["n_tokens_after"]) == (3, 2, n(t[:2] + t[4:]))
    assert token_counts.recount(empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[100:140] = x[0] + 0.02 * rng.standard_normal((40, 16))
    x[200:210] = x[7] + 0.09 * rng.standard_normal((10, 16))
    vecs = [(i, v.tolist(), 1, 5) for i, v in enumerate(x)] + [(900, None, 1, 5), (901, [0.0] * 16, 1, 5), (902, [float("nan")] * 16, 1, 5), (903, [None] + [1.0] * 15, 1, 5), (904, x[0].tolist(), 1, 5), (905, [], 1, 5), (906, [1.0], 1, 5), (907, [1e300] * 16, 1, 5)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int, n_links long")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, k=4).collect()}
    x = np.vstack([x, x[:1], np.ones((1, 16))])
    ids = [*range(400), 904, 907]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert all(got[i]["n_links"] <= link[k].sum() for k, i in enumerate(ids)) and found >= 0.9 * link.sum()
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (900, 901, 902, 903, 905, 906))
    assert got[904]["component_id"] == 0 and not got[904]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies, exact", [(0, False), (30, False), (0, True)])
def test_embeddings_of_saturated_groups(spark, copies, exact, monkeypatch):
    """Two groups larger than any list, whose members are nearer to each other than to the other group, which they link to."""
    rng = np.random.default_rng(5)
    a, far = rng.standard_normal((2, 16))
    b = a / np.linalg.norm(a) + 0.22 * (far - a * (far @ a) / (a @ a)) / np.linalg.norm(far)
    tight = lambda c: c / np.linalg.norm(c) + 1e-3 * rng.standard_normal((40, 16))
    x = np.vstack([tight(a), tight(b), rng.standard_normal((5, 16))])
    x = np.vstack([x, np.repeat(x[:1], copies, 0), np.repeat(x[40:41], copies, 0)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link[:40, 40:80].all()
    if exact:  # the last pass alone must find what lists and trees have missed
        whole = embedding_dedup._bridges
        monkeypatch.setattr(embedding_dedup, "_bridges", lambda *args: whole(*args) if args[4] == 0 else whole(*args).limit(0))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, k=10, rounds=2).collect()}
    assert len(got) == len(x) and [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    assert all(got[i]["component_id"] == (0 if link[i].any() else i) for i in range(len(x)))


def test_embeddings_that_repeat_an_id(spark):
    """Every row is a vector: links and components follow contents, not ids."""
    a, b, far = ([1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.0, 0.0, -1.0])
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b), (4, far), (None, a)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).filter("vec_id IS NOT NULL").collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_audit_of_embeddings_weighs_vectors_with_links(spark):
    x = np.random.default_rng(6).standard_normal((2000, 16))
    x[:400:2] = x[1:400:2]  # a fifth of the vectors, in pairs
    vectors = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "vec_id long, vec binary")
    truth = dict(embedding_dedup._audit(vectors, 0.95, 32, 2000))
    assert sum(n > 0 for n in truth.values()) >= 64 and all(n == (v < 400) for v, n in truth.items())
    pairs = {v: n for v, n in truth.items() if v < 400}
    hub = {5000: 10**6}
    assert embedding_dedup._recall(truth | hub, hub) < 0.02 and embedding_dedup._recall(truth | hub, pairs | hub) == 1
    lists = spark.createDataFrame([(a, 0, 0.1) for a in range(1, 40)], "a long, b long, sim double")  # one hub
    met = [{(r["a"], r["b"]) for r in embedding_dedup._refine(lists, vectors, 3, turn).collect()} for turn in (1, 2)]
    assert met[0] != met[1]


def test_packing(docs, rows, spark):
    got = packing.pack(docs).collect()
    whole = encoder().whole
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(empty(spark)).count() == 0


def best_fit_decreasing(counts, limit):
    rooms = []
    for a in sorted(counts, reverse=True):
        for _ in range(counts[a]):
            k = bisect.bisect_left(rooms, a)
            room = rooms.pop(k) if k < len(rooms) else limit
            bisect.insort(rooms, room - a)
    return len(rooms)


def test_plan_uses_every_piece_in_no_more_sequences_than_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        limit = rng.choice([10, 64, 200])
        counts = {x: rng.choice([0, 0, 1, rng.randint(0, 9)]) for x in range(1, limit + 1)}
        plan = packing.plan_combinations(counts, limit)
        used = Counter()
        for times, need in plan:
            assert times > 0 and sum(x * k for x, k in need.items()) <= limit
            for x, k in need.items():
                used[x] += times * k
        assert used == Counter({x: n for x, n in counts.items() if n})
        plain = best_fit_decreasing(counts, limit)
        assert sum(n for n, _ in plan) <= plain == sum(n for n, _ in packing.best_fit({x: n for x, n in counts.items() if n}, limit))


def test_index_of_sums_follows_the_counts():
    rng = random.Random(2)
    index = packing.SumIndex({x: rng.randint(0, 3) for x in range(1, 31)}, 30)
    while index.c.any():
        have = {x: int(n) for x, n in enumerate(index.c) if n}
        want = Counter(x + y for x in have for y in have if x < y or (x == y and have[x] > 1))
        assert {s: int(n) for s, n in enumerate(index.pairs) if n} == dict(want)
        gap = rng.randint(1, 30)
        triples = {tuple(sorted(t)) for t in index.complements(gap)}
        assert all(sum(t) == gap and all(have.get(x, 0) for x in t) for t in triples)
        assert {(x, y) for x in have for y in have if x <= y and x + y == gap and (x < y or have[x] > 1)} == {t for t in triples if len(t) == 2}
        index.take({rng.choice(list(have)): 1}, 1)


def test_exact_complements_fill_every_sequence():
    plan = packing.plan_combinations({60: 1, 50: 3, 40: 2, 30: 2, 20: 2, 10: 5}, 100)
    assert sum(n for n, _ in plan) == 5  # 480 in sequences of 100


def test_mixing(docs, rows, spark):
    got = mixing.mix(docs, block=20).collect()
    again = mixing.mix(docs.repartition(5), block=20).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, *_ in rows}
    taken, target = Counter(), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(60, 0.02 * t) or max(size[i] for i in source if source[i] == s) > t, s
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_agrees_on_rows_without_id_and_repeated_rows(spark):
    rng = random.Random(9)
    rows = [(None if k % 2 else k % 30, words(rng, rng.randint(1, 40)) if k % 5 else "same text of all", rng.choice(["a", "b"])) for k in range(300)]
    df = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string, source string")
    taken = [sorted((tuple(r) for r in mixing.mix(df.repartition(n), block=40).collect()), key=repr) for n in (3, 7)]
    assert taken[0] == taken[1] and len(taken[0]) == 340


def test_targets_cap_and_reshare():
    got = {s: t for s, _, t in mixing.source_targets([("b", 10), (None, 100), ("a", 2), ("c", 0)])}
    assert got == {"a": 6.0, "b": 30.0, "c": 0.0, None: 76.0}


def labelled(spark, seed=4, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t, toxic, good = words(rng, 60), int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            w = t.split()
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zzq" + rng.choice(["tan", "lor", "mi"])]))
            t = " ".join(w)
        if not good:
            t = "fine line here\n" + "\n".join(" | ".join(x.upper() + "!!" for x in words(rng, 9).split()) for _ in range(6))
            toxic = 0
        docs.append((i, t, "en", "s", 1, 1, 1, True))
        labels.append((i, good, toxic))
    docs += [(n, None, "en", "s", 1, 1, 1, True), (n + 1, "", "en", "s", 1, 1, 1, True), (n + 2, "w " * 40_000, None, None, None, 1, 1, True), (n + 2, "w " * 40_000, None, None, None, 1, 1, True)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("what", "mod", "out"), [("toxic", 5, 0), ("quality", 3, 1)])
def test_classifiers(spark, what, mod, out):
    docs, labels = labelled(spark)
    score = toxicity.score_toxicity if what == "toxic" else quality.score_quality
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) for r in got)
    truth = {r["doc_id"]: r[what] for r in labels.collect() if r[what] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93
    flipped = labels.selectExpr("doc_id", *(f"if(crc32(cast(cast(doc_id as string) as binary)) % {mod} = {out}, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")))
    other = {r["doc_id"]: r["score"] for r in score(docs, flipped).collect()}
    assert all(other[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6) for r in got)  # held-out labels change nothing
    assert score(docs, labels.limit(0)).count() == docs.count() and score(docs.limit(0), labels).count() == 0


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    fire = lambda hit, miss: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < miss)
    a, b, c = fire(0.9, 0.02), fire(0.7, 0.05), fire(0.6, 0.1)
    copy = np.where(rng.random(len(y)) < 0.9, c, fire(0.6, 0.1))
    votes = a * 1 + b * 2 + c * 4 + copy * 8
    counts = np.zeros((1 << toxicity.VOTERS, 3))
    np.add.at(counts, (votes, np.where(rng.random(len(y)) < 0.05, 1 + y, 0)), 1)
    model = toxicity.LabelModel().fit(counts, steps=600)
    hit = model.accuracies()[1]
    assert abs(hit[0] - 0.9) < 0.08 and abs(hit[1] - 0.7) < 0.08 and (2, 3) in model.edges
    assert (((model.posterior()[votes]) > 0.5) == y).mean() > 0.93


def test_label_model_by_enumeration():
    """Posterior and gradient of a small model against sums over every combination and class."""
    rng = np.random.default_rng(3)
    model = toxicity.LabelModel(4)
    model.join([(0, 2), (1, 3)])
    model.prior, model.fire, model.pair = -0.7, rng.standard_normal((2, 4)), rng.standard_normal(2)

    def weight(v, y):
        return np.exp(y * model.prior + sum(model.fire[y][k] * v[k] for k in range(4)) + sum(j * v[a] * v[b] for (a, b), j in zip(model.edges, model.pair)))

    every = [[m >> k & 1 for k in range(4)] for m in range(16)]
    assert np.allclose(model.posterior(), [weight(v, 1) / (weight(v, 0) + weight(v, 1)) for v in every])
    total = sum(weight(v, y) for v in every for y in (0, 1))
    for y in (0, 1):
        own = sum(weight(v, y) for v in every)
        assert np.allclose(model.accuracies()[y], [sum(weight(v, y) * v[k] for v in every) / own for k in range(4)])
    counts = rng.integers(0, 30, (16, 3)).astype(float)

    def likelihood():
        z = sum(weight(v, y) for v in every for y in (0, 1))
        return sum(c[0] * np.log((weight(v, 0) + weight(v, 1)) / z) + c[1] * np.log(weight(v, 0) / z) + c[2] * np.log(weight(v, 1) / z) for v, c in zip(every, counts)) / counts.sum()

    before = likelihood()
    model._climb(counts, 200)
    assert total > 0 and likelihood() > before
    best = likelihood()
    for part in (model.fire, model.pair):  # no small step improves a fitted model by much
        for k in np.ndindex(part.shape):
            for step in (-0.05, 0.05):
                part[k] += step
                assert likelihood() < best + 2e-3
                part[k] -= step


def test_toxicity_against_a_plain_version(spark):
    """The whole operator again, in loops over texts in one process."""
    docs, labels = labelled(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    bad, good, sizes, seen = Counter(), Counter(), Counter(), set()
    for i, t in rows:
        if i in known and t not in seen:
            seen.add(t)
            sizes[known[i]] += 1
            for term in {x for w in re.findall(r"\w+", t.lower()) for x in [w, *(w[:n] + "^" for n in range(3, 8) if len(w) >= n)]}:
                (bad if known[i] else good)[term] += 1
    odds = {t: np.log((n + 0.5) / (sizes[1] + 1)) - np.log((good[t] + 0.5) / (sizes[0] + 1)) for t, n in bad.items() if n >= 4}
    mined = sorted((t for t in odds if odds[t] > 2), key=lambda t: (-odds[t] * np.sqrt(bad[t]), t))[:300]
    vocabulary = [*toxicity.SEEDS, *(t for t in mined if t not in toxicity.SEEDS)]
    x, votes = np.zeros((len(rows), len(vocabulary))), []
    for k, (_, t) in enumerate(rows):
        found = Counter(x for w in re.findall(r"\w+", t.lower()) for x in [w, *(w[:n] + "^" for n in range(3, 8) if len(w) >= n)])
        fires = [False] * toxicity.VOTERS
        for j, term in enumerate(vocabulary):
            x[k, j] = np.log1p(found[term])
            if found[term]:
                fires[j % 2 if j < 10 else 2 + j % 9] = True
        fires[11:] = toxicity.pattern_votes(t, re.findall(r"\w+", t), re.findall(r"\w+", t.lower()))
        votes.append(sum(f << j for j, f in enumerate(fires)))
    counts = np.zeros((1 << toxicity.VOTERS, 3))
    for (i, _), v in zip(rows, votes):
        counts[v, 1 + known[i] if i in known else 0] += 1
    posterior = toxicity.LabelModel().fit(counts).posterior()
    alike = [(tuple(x[k]), len(re.findall(r"\w+", t))) for k, (_, t) in enumerate(rows)]
    same = Counter(alike)
    w = toxicity.fit_linear(x, posterior[votes], np.array([1 / same[a] for a in alike]))
    want = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    got = defaultdict(list)
    for r in toxicity.score_toxicity(docs, labels).collect():
        got[r["doc_id"]].append(r["score"])
    assert all(got[i][0] == pytest.approx(p, abs=1e-4) for (i, _), p in zip(rows, want))


def test_patterns_vote():
    vote = lambda t: toxicity.pattern_votes(t, re.findall(r"\w+", t), re.findall(r"\w+", t.lower()))
    assert vote("") == [False] * 4 and vote("plain words, nothing else here") == [False] * 4
    assert vote("no! no!") == [True, False, False, False] and vote("STOP IT NOW please") == [False, True, False, False]
    assert vote("you and your friends") == [False, False, True, False] and vote("a b**d word") == vote("sooooo long") == [False, False, False, True]


def test_quality_against_a_plain_version(spark):
    """Scores of short documents from sums over every labelling of their lines."""
    docs, labels = labelled(spark, n=120)
    model = {"w": np.random.default_rng(1).standard_normal(quality.FEATURES + 1) * 0.4, "chain": np.array([[0.5, -0.2], [0.1, 0.3]]), "scale": np.array([2.0, 1.0, -1.0])}
    texts = ["", "one", "A|B\n\nsame line\nsame line\nEnd! 12", "x\n" * 6]
    got = quality.field_scores([t.encode() for t in texts], model)
    for t, score in zip(texts, got):
        lines = t.split("\n")
        x, length, _ = quality.line_features([t.encode()])
        u = x @ model["w"][:-1] + model["w"][-1]
        total, good = 0.0, np.zeros(len(lines))
        for m in range(1 << len(lines)):
            y = [m >> k & 1 for k in range(len(lines))]
            p = np.exp(sum(u[k] * y[k] for k in range(len(y))) + sum(model["chain"][a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        mean = sum(g * (len(line) + 1) for g, line in zip(good / total, lines)) / sum(len(line) + 1 for line in lines)
        assert score == pytest.approx(1 / (1 + np.exp(-(2 * mean + mean**8 - 1))))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    own = sorted(((*quality.line_features([rows[i].encode()])[:2], q) for i, q in known.items()), key=lambda r: (r[0].tobytes(), r[1].astype(np.int32).tobytes()))
    trained = quality.train_field(np.vstack([r[0] for r in own]), np.concatenate([r[1] for r in own]).astype(np.int32), np.array([len(r[1]) for r in own]), np.array([r[2] for r in own]))
    want = dict(zip(rows, quality.field_scores([t.encode() for t in rows.values()], trained)))
    assert all(r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-5) for r in quality.score_quality(docs, labels).collect())
    few = quality.score_quality(docs, labels, sample_mb=1, sample=10**6).collect()
    assert len(few) == docs.count()


def test_line_features():
    x, length, counts = quality.line_features([b"AB c1\n\nAB c1", b""])
    own = quality.OWN
    assert counts.tolist() == [3, 1] and length.tolist() == [5, 0, 5, 0]
    assert x[0, :4].tolist() == pytest.approx([0.4, 0.2, 0.2, 0.2]) and x[1, len(quality.CLASSES) + 1] == 1
    assert x[0, len(quality.CLASSES) + 2] == 1 and np.allclose(x[1, own : 2 * own], x[0, :own]) and np.allclose(x[1, 2 * own :], x[2, :own])
    assert not x[0, own : 2 * own].any() and not x[2, 2 * own :].any() and not x[3, own:].any()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    counts, chain = np.array([3, 1, 5]), rng.standard_normal((2, 2))
    u = rng.standard_normal(9)
    good, moves = quality.marginals(u, counts, chain)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        weight = {}
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            weight[tuple(y)] = np.exp(sum(u[at + k] * y[k] for k in range(n)) + sum(chain[a, b] for a, b in zip(y, y[1:])))
        z = sum(weight.values())
        want += [sum(w for y, w in weight.items() if y[k]) / z for k in range(n)]
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(good, want) and np.allclose(moves, pairs)


def test_chat(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "f", '{"x": 1.0}', []), (1, "b", 2, "f", '{"x": "no"}', ["a"]), (2, "c", 0, "f", '{"x": 2, "y": 1}', ["d"]), (2, "d", 1, "g", "{", []), (3, "e", 0, "f", None, ["h"]), (3, "h", 1, "f", '{"x": 3}', ["e"]), (None, None, 5, "f", "[]", None)],
        "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 1, "r"), (1, "a", 3, "again"), (2, "c", None, None), (1, "zz", 9, "lost"), (2, "d", 0, "early"), (None, None, 1, "n")], "conv_id long, call_id string, seq long, content string")
    schema = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "number", "minimum": 0}}}}
    got = chat.link_calls(calls, results, schema).collect()
    by = {(r["call_id"], r["result_turn"]): r for r in got}
    assert len(got) == 10
    assert by["a", 1]["status"] == "linked" and by["a", 1]["valid"] and by["a", 1]["json"] == '{"arguments":{"x":1},"id":"a","name":"f","result":"r"}'
    assert by["a", 3]["status"] == "duplicate_result" and by["zz", 9]["status"] == "no_call" and by["d", 0]["status"] == "early_result"
    assert not by["b", None]["valid"] and by["b", None]["status"] == "no_result"
    assert by["d", 0]["position"] < by["c", None]["position"]  # d before c, which depends on it
    assert [r["status"] for r in got if r["conv_id"] == 3] == ["cycle", "cycle"]
    assert chat.link_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_chat_of_repeats_and_odd_columns(spark):
    """Extra columns with the names of inner ones, repeated calls and results, null keys, and schemas and numbers out of the ordinary."""
    calls = [(1, "a", 0, "f", '{"x": 1}'), (1, "a", 0, "f", '{"x": 1}'), (1, "a", 4, "f", '{"x": 5}'), (2, "b", 0, "odd", '{"x": 1}'), (2, "c", 1, "f", '{"x": NaN}'), (2, "d", 2, "f", '{"x": 1e999}'), (2, "e", 3, "f", r'{"x": "\ud800"}'), (None, "n", 1, "f", "{}"), (None, "n", 1, "f", "{}"), (2, "g", 5, "f", '{"x": ' + "9" * 400 + "}"), (2, "h", 6, "f", "[" * 100_000)]
    calls = spark.createDataFrame([(*c, None, "content", 3, 4, "s") for c in calls], "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>, content string, level int, first int, status string")
    results = spark.createDataFrame([(1, "a", 1, "r", 9, "x"), (1, "a", 1, "r", 9, "x"), (None, "n", 2, "z", 9, "x"), (2, "b", None, None, 9, "x")], "conv_id long, call_id string, seq long, content string, level int, name string")
    schemas = {"f": {"type": "object", "properties": {"x": {"type": ["integer", "string"]}}}, "odd": {"type": "object", "properties": {"x": {"type": "decimal"}}}}
    got = [r for n in (1, 5) for r in [sorted((tuple(r) for r in chat.link_calls(calls.repartition(n), results.repartition(n), schemas).collect()), key=repr)]]
    assert got[0] == got[1]
    count = Counter((r[0], r[1], r[4]) for r in got[0])
    assert count == {(1, "a", "linked"): 1, (1, "a", "duplicate_call"): 2, (1, "a", "duplicate_result"): 1, (None, "n", "no_result"): 2, (None, "n", "no_call"): 1, (2, "b", "linked"): 1, **{(2, c, "no_result"): 1 for c in "cdegh"}}
    valid = {r[1]: r[5] for r in got[0] if r[0] == 2}
    assert valid == {"b": False, "c": False, "d": False, "e": True, "g": True, "h": False}
    for conv in (1, 2, None):
        own = [r[6] for r in got[0] if r[0] == conv]
        assert sorted(own) == list(range(len(own)))


def test_turns_without_role_are_results(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, None, "r"), (2, 5, None, "lost")], "conv_id long, turn int, role string, text string")
    got = {(r["call_id"], r["result_turn"], r["status"]) for r in chat.link_calls(*chat.turns_as_calls(turns), chat.REPLY).collect()}
    assert got == {("1:0", 1, "linked"), ("2:4", 5, "no_call")}


def test_warc(spark):
    rng = random.Random(8)
    records = []
    for i in range(400):
        full = rng.random() < 0.4
        url = rng.choice(["http://www.A.org/x/", "https://a.org:443/x#f", "a.org/x?utm_source=1", "a.org/x?b=2&a=1", "a.org/x?a=1&b=2&ref=z", None])
        headers = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "date": str(i)} if rng.random() < 0.8 else rng.choice([None, {"content-type": "t", "age": "3"}])
        records.append((i, url, rng.choice([None, *range(60)]), "response" if full else "revisit", headers, rng.choice(["s1", "s2", None]) if full else None, "extra"))
    df = spark.createDataFrame(records, "record_id long, url string, ts long, kind string, headers map<string,string>, payload_sha256 string, original string")
    records.append((400, "a.org/x?utm_source=1", 10**12, "revisit", None, None, "extra"))  # one time far from all others
    df = df.unionByName(spark.createDataFrame(records[-1:], df.schema))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df.repartition(3)).collect()}
    canon = {"http://www.A.org/x/": "a.org/x", "https://a.org:443/x#f": "a.org/x", "a.org/x?utm_source=1": "a.org/x", "a.org/x?b=2&a=1": "a.org/x?a=1&b=2", "a.org/x?a=1&b=2&ref=z": "a.org/x?a=1&b=2", None: None}
    assert len(got) == sum(r[3] == "revisit" for r in records)
    for i, url, ts, kind, headers, _, _ in records:
        if kind != "revisit":
            continue
        known = [r for r in records if r[3] == "response" and r[5] and r[2] is not None and ts is not None and url and r[1] and canon[r[1]] == canon[url] and r[2] < ts]
        best = max(known, key=lambda r: (r[2], r[0]), default=None)
        assert got[i]["original_id"] == (best and best[0]) and got[i]["canonical_url"] == canon[url]
        tag = lambda h: (h or {}).get("etag") and h["etag"].removeprefix("W/")
        if best is None:
            assert got[i]["status"] == "no_original"
        elif tag(headers) is None or tag(best[4]) is None:
            assert got[i]["status"] == "no_validator"
        else:
            assert got[i]["status"] == ("resolved" if tag(headers) == tag(best[4]) else "validator_mismatch")
            if got[i]["status"] == "resolved":
                merged = best[4] | {k: v for k, v in headers.items() if k in warc.PERMITTED}
                assert got[i]["headers"] == "\n".join(f"{k}: {v}" for k, v in sorted(merged.items())) and got[i]["payload_sha256"] == best[5]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def classes_of(pairs, n):
    """Components of n rows by links."""
    root = list(range(n))
    for a, b in pairs:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_pipeline_against_plain_versions(spark, docs, rows, tmp_path):
    """Every stage on its own input, with repeated ids, rows without id and equal rows; then the whole run."""
    import corpus_pipeline as cp

    rng = random.Random(5)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(3, "another text under a known id " * 3), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1] + " tail"), (None, words(rng, 50)), (None, rows[8][1]), (None, rows[8][1])]
    odd += [(None, "stupid idiot moron scum trash " + words(rng, 6))] * 2
    plain = plain.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in odd], plain.schema)).cache()
    toxic = [(500 + k, " ".join(rng.choice(["stupid", "idiot", "moron", "scum", *words(rng, 3).split()]) for _ in range(20)), "en", "b", 1) for k in range(40)]
    plain = plain.unionByName(spark.createDataFrame(toxic, plain.schema))
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows] + [(t[0], 1, 1) for t in toxic], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(cp.STAGES)
    taken = lambda df: sorted(map(tuple, df.collect()), key=repr)
    have = taken(plain)

    clean = stage["toxicity"](spark, plain, str(tmp_path))
    texts = {t for t in {r[1] for r in have} if sum(w in toxicity.SEEDS for w in re.findall(r"\w+", (t or "").lower())) >= 3}
    assert clean.columns == plain.columns and taken(clean) == [r for r in have if r[1] not in texts] and len(texts) > 30
    clean = clean.cache()
    have = taken(clean)

    once = stage["exact_dedup"](spark, clean, str(tmp_path)).cache()
    groups = defaultdict(list)
    for r in have:
        groups[re.sub(SPACES, " ", r[1] or "")].append(r)
    got = defaultdict(list)
    for r in once.collect():
        got[re.sub(SPACES, " ", r["text"] or "")].append(tuple(r))
    assert once.columns == plain.columns and got.keys() == groups.keys() and all(len(g) == 1 and g[0] in groups[t] for t, g in got.items())
    assert all(g[0][0] == min((r[0] for r in groups[t] if r[0] is not None), default=None) for t, g in got.items())

    have = taken(once)
    near = stage["ngram_jaccard_join"](spark, once, str(tmp_path)).cache()
    _, links = brute_links([(k, r[1]) for k, r in enumerate(have)])
    root = classes_of([(a, b) for a in links for b in links[a]], len(have))
    left = Counter(root[have.index(r)] for r in taken(near))
    assert near.columns == plain.columns and left == Counter(set(root))

    have = taken(near)
    mixed = stage["mix_sources"](spark, near, str(tmp_path)).cache()
    copies = Counter(taken(mixed))
    want = mixing.mix(near).collect()
    assert mixed.columns == plain.columns and sum(copies.values()) == sum(r["copies"] for r in want) and max(copies.values()) <= 3
    by_id = Counter()
    for r in want:
        by_id[r["doc_id"]] += r["copies"]
    ids = Counter(r[0] for r in copies.elements())
    assert ids == +by_id

    packed = stage["best_fit_packing"](spark, mixed, str(tmp_path))
    whole = encoder().whole
    size = sum(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in copies.elements())
    assert sum(r["length"] for r in packed.collect()) == size
    final = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in cp.run(spark, str(tmp_path)).collect()) == final


def test_pipeline_stages_remove_equal_rows_and_take_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    assert [f(spark, none, str(tmp_path)).count() for _, f in cp.STAGES] == [0] * 5
    text = words(random.Random(2), 60)
    same = spark.createDataFrame([(i, text + tail, "en", "a", 9) for i in (1, None) for tail in ("", "", " x")], none.schema)
    assert [r["doc_id"] for r in cp.drop_near_copies(spark, same, str(tmp_path)).collect()] in ([1], [None])
    assert Counter((r["doc_id"], r["text"]) for r in cp.drop_exact_copies(spark, same, str(tmp_path)).collect()) == {(1, text): 1, (1, text + " x"): 1}


def test_toxic_rows_without_id_are_rejected(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(4)
    rows = [(i, f"{words(rng, 30)} {' '.join(toxicity.SEEDS[:4]) if i % 4 == 0 else ''}", "en", "a", 9) for i in range(120)]
    rows += [(None, *rows[i][1:]) for i in range(12)] + [(None, None, "en", "a", 0)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.reject_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} - {None} == {i for i in range(120) if i % 4}
    assert Counter(r["text"] for r in kept if r["doc_id"] is None) == Counter([t for i, t, *_ in rows[:12] if i % 4] + [None])
