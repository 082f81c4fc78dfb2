"""Operators without SQL against plain Python on small tables, round trips, held-out accuracy."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayside.llm import chat_format, exact_dedup, language_id, lattice_lm, near_dedup, packing, quality_gam, suffix_dedup
from wayside.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def removed(rows, w=suffix_dedup.WINDOW):
    """Whether each byte lies in a repeated window, by counting all windows."""
    seen = collections.Counter(t[p : p + w] for _, t in rows for p in range(len(t) - w + 1))
    out = []
    for i, t in rows:
        hit = np.zeros(len(t) + 1, int)
        for p in range(len(t) - w + 1):
            if seen[t[p : p + w]] > 1:
                hit[p] += 1
                if p + w < len(hit):
                    hit[p + w] -= 1
        hit = np.cumsum(hit[: len(t)]) > 0
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((i, len(t), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return sorted(out)


def test_op9_on_table(spark, sf):
    rows = [(i, t.encode()) for i, t in documents(spark, sf)]
    assert sorted(map(tuple, QUERIES["op9_suffix_dedup"](spark, sf).collect())) == removed(rows)


@pytest.mark.parametrize("block", [2000, 1])
def test_op9_edges(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # 1: all windows are grouped in Spark
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcde \n") for _ in range(n))
    passage, long = text(700), text(3000)
    rows = [(1, passage), (2, text(90) + passage + text(120)), (3, text(33) + passage[100:650] + "é" + text(10)), (4, long), (5, long), (6, "ab" * 600), (7, "x" * 399), (8, None), (9, ""),
            (10, text(401)), (11, passage[:399]), (None, long[:500] + text(400)), (13, "z" * 200_000)] + [(20 + k, text(50) + passage[200:640] + text(60)) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) if r.doc_id is not None else (-1, *tuple(r)[1:]) for r in suffix_dedup.dedup(df).collect())
    assert got == removed([(-1 if i is None else i, (t or "").encode()) for i, t in rows])


def test_op9_passages_just_under_and_over_the_window(spark):
    """Passages of over 50 words: those of 399 bytes stay, those of 400 and more go, in copies with
    different neighbours, in many partitions; the texts that are kept come out too."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))

    def passage(n):
        t = " ".join(word() for _ in range(n // 3))[: n - 1] + "."
        assert len(t) == n and len(t.split()) > 50
        return t

    planted = {n: passage(n) for n in (394, 399, 400, 401, 405, 700)}
    other = lambda: " ".join(word() for _ in range(rng.randrange(20, 60)))
    rows = [(n * 10 + k, f"{other()}{k}{p}{k}{other()}") for n, p in planted.items() for k in range(5)] + [(k, other() * 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    found = suffix_dedup.dedup(df, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in found) == removed([(i, t.encode()) for i, t in rows])
    assert {r.doc_id // 10 for r in found if r.n_removed} == {400, 401, 405, 700}
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in found)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(120):
        x = rng.integers(1, rng.integers(2, 6), int(rng.integers(1, 60)))
        x = np.tile(x[:5], 6) if t % 5 == 0 else x
        s = x.tolist()
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_op5_sequences(spark, sf):
    from tokenizers import Tokenizer

    rows = QUERIES["op5_packing"](spark, sf).collect()
    tok = Tokenizer.from_file(packing.tokenizer_file())
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    docs = documents(spark, sf)
    for i, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(pieces[i], key=lambda r: r.piece), 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.03 * -(-total // 2048) + 1


def test_packing_plan_on_random_counts():
    rng = random.Random(3)
    for _ in range(5):
        counts = {rng.randrange(1, 129): rng.randrange(1, 40) for _ in range(30)}
        plan = packing.plan_of(dict(counts), 128, 12)
        seq, placed = collections.defaultdict(list), collections.Counter()
        for s, rank, n, first, o in plan.runs:
            placed[s] += n
            for k in range(n):
                seq[first + k].append((o, s))
        assert placed == counts and len(seq) == plan.sequences
        for v in seq.values():
            at = 0
            for o, s in sorted(v):
                assert o == at
                at += s
            assert at <= 128


def test_encoder_is_the_tokenizer():
    """Chosen texts, every character that takes the faster way, and random mixtures."""
    e = packing.Encoder(packing.tokenizer_file())
    whole = lambda t: e.whole.encode(t, add_special_tokens=False).ids
    for t in ["", "plain text, 12!", "naïve façade <|endoftext|> x", "日本語     x", "a\x1cb\x85c", "😀 emoji", "don't\r\n\tstop"]:
        assert e.ids(t).tolist() == whole(t)
    plain = [chr(c) for c in range(0x3000) if packing.Encoder.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 90
    for c in plain:
        t = f"a{c}b {c}{c} 1{c} {c}s '{c}\n{c}"
        assert e.ids(t).tolist() == whole(t), repr(c)
    rng = random.Random(6)
    for _ in range(1500):
        t = "".join(rng.choice(plain) for _ in range(rng.randrange(1, 40)))
        assert e.ids(t).tolist() == whole(t), t


def test_op7_counts_and_lattice(spark, sf):
    docs = documents(spark, sf)
    counts, trained = collections.Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(WORD.findall(t.translate(LOWER)))
            trained += 1
    n, v = sum(counts.values()) + trained, len(counts) + 1
    below = math.log10(n + 0.5 * (v + 1))
    scored = lattice_lm.score(spark.read.parquet(f"{sf}/documents.parquet"), common=500).collect()  # most words take the join
    assert len(scored) == len(docs)
    texts = dict(docs)
    for r in scored:
        words = WORD.findall(texts[r.doc_id].translate(LOWER))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.5) - below for w in words) + math.log10(trained + 0.5) - below)
        assert r.score < 0
    # scores of whole documents: each word's lattice by itself, under the weights that the operator estimates
    table = spark.createDataFrame([(w.encode(), c) for w, c in counts.items()], "word binary, c long")
    logs, end = lattice_lm.estimate(table, trained, lattice_lm.vocabulary_file())
    voc = lattice_lm.vocabulary(lattice_lm.vocabulary_file())

    @functools.cache
    def log_p(word: bytes) -> float:
        raw = b" " + word
        ways = [0.0] + [-math.inf] * len(raw)
        for j in range(1, len(raw) + 1):
            terms = [ways[j - 1] + logs[raw[j - 1]]]
            for i in range(max(0, j - voc.longest), j):
                k = voc.look_up(lattice_lm._hash_of([raw[i:j]]))[0]
                if k >= 0:
                    terms.append(ways[i] + logs[k])
            ways[j] = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))
        return ways[-1]

    for r in sorted(scored, key=lambda r: (r.n_tokens, r.doc_id))[: len(scored) // 3]:
        assert r.score == pytest.approx((sum(log_p(w.encode()) for w in WORD.findall(texts[r.doc_id].translate(LOWER))) + end) / math.log(10))


def test_very_long_words_keep_no_arcs(monkeypatch):
    voc = lattice_lm.vocabulary(lattice_lm.vocabulary_file())
    logs, words = np.log(voc.start), pa.array([b"thatingand" * 30, b"x" * 300], pa.binary())
    runs = []
    for kept in (1024, 10):
        monkeypatch.setattr(lattice_lm, "KEPT_ARCS", kept)
        (_, lattice), = lattice_lm.lattices(words, voc)
        assert (lattice.kept is None) == (kept == 10)
        runs.append((lattice.forward(logs), lattice.expected(logs, np.ones(2))))
    assert all(np.array_equal(a, b) for a, b in zip(*runs, strict=True))


def test_lattice_sums_all_segmentations():
    voc = lattice_lm.vocabulary(lattice_lm.vocabulary_file())
    logs = np.log(voc.start)

    def total(word: bytes) -> float:
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = ways[j - 1] * math.exp(logs[word[j - 1]])
            for i in range(max(0, j - voc.longest), j):
                k = voc.look_up(lattice_lm._hash_of([word[i:j]]))[0]
                if k >= 0:
                    ways[j] += ways[i] * math.exp(logs[k])
        return ways[-1]

    words = [b"the", b"thatingat", "é".encode(), b"x" * 30, b"a"]
    for rows, lattice in lattice_lm.lattices(pa.array(words, pa.binary()), voc):
        alpha = lattice.forward(logs)[:, -1]
        for r, a in zip(rows, alpha, strict=True):
            assert math.exp(a) == pytest.approx(total(b" " + words[r]))


@pytest.mark.parametrize("name, truth, least", [("op3_language_id", "lang", 0.9), ("op8_quality_gam", "quality", 0.85)])
def test_held_out_accuracy(name, truth, least, spark, sf):
    rows = QUERIES[name](spark, sf)
    table = spark.read.parquet(f"{sf}/{'documents' if truth == 'lang' else 'labels'}.parquet").select("doc_id", truth)
    found = rows.where("held_out").join(table, "doc_id").collect()
    hits = [r[truth] == (r.lang_pred if truth == "lang" else r.predicted) for r in found]
    assert sum(hits) >= least * len(hits) and all(0 <= r.score <= 1 for r in found)


def test_op3_against_a_slow_network(spark, sf):
    """Predictions of the query against a forward pass written out byte by byte."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_id.fit(docs)
    found = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    for i, t in sorted(documents(spark, sf), key=lambda r: len(r[1]))[:25]:
        raw, got = t.encode(), found[i]
        if not any(c.isalpha() for c in t):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        logs, probs = np.zeros(len(net.langs)), np.zeros(len(net.langs))
        for at in range(0, len(raw), 256):
            part = raw[at : at + 256]
            x, pooled = part.ljust(256, b"\0"), []
            for w in language_id.WIDTHS:
                sums = [sum(net.tables[w][j][x[p + j]] for j in range(w)) for p in range(256 - w + 1)]
                pooled += [max(0.0, float(max(s[f] for s in sums)) + float(net.bias[w][f])) for f in range(language_id.FILTERS)]
            z = [sum(a * float(v) for a, v in zip(pooled, net.out[:, k], strict=True)) + float(net.out_bias[k]) for k in range(len(net.langs))]
            total = math.log(sum(math.exp(v - max(z)) for v in z)) + max(z)
            logs += [(v - total) * len(part) for v in z]
            probs += [math.exp(v - total) * len(part) for v in z]
        best = int(np.argmax(logs))
        assert got.lang_pred == net.langs[best] and got.score == pytest.approx(probs[best] / len(raw), abs=1e-3)


def test_op3_learns_from_the_ends_of_long_texts_and_from_all_languages(spark):
    rng = random.Random(4)
    filler = "0123456789 " * 300  # the middle of each text says nothing
    rows = []
    for k in range(240):  # more languages than any list of the common ones would hold
        alphabet = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        say = lambda a=alphabet: "".join(rng.choice(a) for _ in range(80))
        rows += [(len(rows) * 2 + j, say() + filler + say(), f"l{k:03d}") for j in range(2)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_fold=9)
    assert net.langs == [f"l{k:03d}" for k in range(240)]
    few = [(i, ("abcd " if i % 2 else "wxyz ") * 20 + filler + ("efgh " if i % 2 else "stuv ") * 20, "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string")
    got = language_id.predict(spark.createDataFrame([(1, "abcd " * 30), (2, "wxyz " * 30), (3, "efgh " * 30), (4, "stuv " * 30)], "doc_id long, text string"), language_id.fit(df, held_fold=9))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "a", 2: "b", 3: "a", 4: "b"}


def test_op8_is_a_sum_of_table_entries(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality_gam.classify(docs, labels).collect()}
    for i, t in documents(spark, sf):
        x = quality_gam.features_of(pa.array([t]))[0]
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        small = lambda f: bins[f] * quality_gam.PAIR_BINS // (len(model.edges[f]) + 1)  # noqa: E731, B023
        z = model.bias + sum(table[b] for table, b in zip(model.tables, bins, strict=True)) + sum(table[small(f)][small(g)] for f, g, table in model.pairs)
        assert found[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_op8_repeated_ids_give_one_model(spark, monkeypatch):
    monkeypatch.setattr(quality_gam, "MAX_ROWS", 8)
    rng = random.Random(3)
    rows = [(i % 6, " ".join(rng.choice(["good", "bad", "##", "word"]) for _ in range(rng.randrange(5, 60)))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality_gam.fit(d, labels, held_fold=9) for d in (df.repartition(2), df.repartition(7, "text")))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True)) and a.bias == b.bias


def test_runs_merge_sorted():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(7):
        keys = np.array([bytes([0] * 46) + bytes(rng.integers(0, 3, 2, np.uint8)) for _ in range(30)], "S48")
        keys.sort()
        runs.append(exact_dedup.collapse((keys, rng.integers(0, 99, 30), np.ones(30, np.int64))))
    want = {}
    for k, i, n in (e for r in runs for e in zip(*(v.tolist() for v in r), strict=True)):
        best, total = want.get(k, (i, 0))
        want[k] = (max(best, i), total + n)
    keys, ids, sizes = exact_dedup.merge_all(runs)
    assert list(zip(keys.tolist(), zip(ids.tolist(), sizes.tolist(), strict=True), strict=True)) == sorted(want.items())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups whose most typical member does not link all: components still equal brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for g in range(4):
        base = rng.sample(words, 150)
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(150)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (501, "  "), (502, "one"), (503, "ONE"), (504, "one two"), (505, " ".join(rng.sample(words, 90)))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_chat_round_trip():
    t = chat_format.CHAT
    said = ["", "\\", "</s>[INST] ok [/INST]", "<s>[SYS]x[/SYS]\\\\", "[BOT", "]</s", "a\nb", "<\\/s>"]
    turns = [(r, x) for x in said for r in ("system", "user", "assistant", "tool[/NAME]", "")]
    whole = "".join(s for s, _ in chat_format.segments_of(turns, t))
    for step in (1, 3, 1000):
        reader, got = chat_format.Reader(t), []
        for i in range(0, len(whole), step):
            got += reader.feed(whole[i : i + step], i + step >= len(whole))
        assert got == turns
    assert not any(m in t.quote(x, t.pattern()) for x in said for m in t.marks())
