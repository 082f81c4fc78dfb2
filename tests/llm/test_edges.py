"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayside.llm import chat_format, common, exact_dedup, language_id, lattice_lm, mixing, near_dedup, packing, quality_gam, quality_rules, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, component_id long, score double, rank int"
ROWS = [
    (1, "a few words of text here", "en", "s1", 5, 1, "k", 1, 0.5, 1), (1, "a few words of text here", "en", "s1", 5, 1, "k", 1, 0.5, 1),
    (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "s2", 0, 0, "", 0, 0.0, 0), (4, " \t\n", "fr", "s1", 3, 1, "k", 1, 0.1, 2),
    (None, "text without an id of its own", "fr", None, 1, 1, "k", 1, 0.1, 3), (5, "word " * 30_000, "en", "s1", 1, 1, "k", 1, 0.1, 3),
    (6, "x" * 50_000, None, "s3", 1, 1, "k", 1, 0.1, 3), (7, "1234 !!! ###", "fr", "s3", 1, 1, "k", 1, 0.1, 3),
]
LABELS = [(1, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 0), (7, 0, 1), (7, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, q: mixing.mix_plan(d), "near": lambda d, q: near_dedup.near_duplicates(d), "language": lambda d, q: language_id.identify(d),
    "exact": lambda d, q: exact_dedup.exact_duplicates(d), "lm": lambda d, q: lattice_lm.score(d), "quality": quality_gam.classify,
    "suffix": lambda d, q: suffix_dedup.dedup(d), "rules": lambda d, q: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, labels):
    assert sorted(r.doc_id or -1 for r in OPERATORS[name](docs, labels).collect()) == sorted(r[0] or -1 for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_packing_edges(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2 and packing.pack(docs.limit(0)).collect() == []


def test_filters_keep_the_columns(docs, labels):
    for f in (exact_dedup.drop_duplicates, near_dedup.drop_near_duplicates, mixing.mix_documents, lambda d: quality_gam.keep_good(d, labels)):
        assert f(docs).columns == docs.columns and f(docs.limit(0)).count() == 0
    kept = exact_dedup.drop_duplicates(docs)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]


def test_language_edges(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 7)) and got[1].lang_pred in ("en", "fr")


def test_mixing_budgets(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}" if i % 5 else None) for i in range(2000)] + [(5000, "w " * 3, "tiny")]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    total = sum(len(t.split()) for _, t, _ in rows)
    taken = plan.groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert sum(r.target for r in taken) == pytest.approx(total) and all(abs(r.t - r.target) <= 1 and r.over <= 0 and r.target <= 3 * r.source_size for r in taken)


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert (got[1].n_turns, got[1].valid, got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[3].valid) == (2, False, 2, 2, 1, True)
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_pipeline_stages(spark, sf):
    """Each stage against what plain Python says about its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and seen[name][1]
    same = lambda rows: sorted(map(repr, rows))

    before, after = seen["quality"]
    model = quality_gam.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.scores(quality_gam.features_of(pa.array([r["text"] for r in before], pa.string())))
    assert same(after) == same([r for r, s in zip(before, scores, strict=True) if s >= quality_gam.THRESHOLD])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert len({r["doc_id"] for r in after} & set(good)) >= 0.97 * len(good)

    before, after = seen["exact_dedup"]
    last = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        last[r["text"]] = r
    assert same(after) == same(last.values())

    before, after = seen["near_dedup"]
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert same(after) == same([r for r in before if find(r["doc_id"]) == r["doc_id"]])

    before, after = seen["mixing"]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\t-\r]+", r["text"])) for r in before}
    sources = sorted({r["source"] for r in before}, key=lambda v: (v is None, v or ""))
    total, weight = sum(size.values()), {v: (5, 2, 1)[k % 3] for k, v in enumerate(sources)}
    held = {v: sum(size[r["doc_id"]] for r in before if r["source"] == v) for v in sources}
    target, left, open_ = {}, float(total), set(sources)
    while over := [v for v in open_ if weight[v] * left / sum(weight[u] for u in open_) > 3 * held[v]]:
        v = min(over, key=lambda v: held[v] / weight[v])
        target[v] = 3 * held[v]
        left, open_ = left - target[v], open_ - {v}
    target |= {v: weight[v] * left / sum(weight[u] for u in open_) for v in open_}
    want = []
    for v in sources:
        budget, ahead = int(target[v] + 0.5), 0
        own = sorted((r for r in before if r["source"] == v), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
        for r in own:
            n = size[r["doc_id"]]
            want += [r] * (budget // held[v] + (2 * (budget % held[v] - ahead) >= n))
            ahead += n
    assert same(after) == same(want)

    before, after = seen["packing"]
    assert same({k: v for k, v in r.items() if k in ("doc_id", "piece", "start", "length", "ids_crc32")} for r in after) == same(
        {k: v for k, v in p.items()} for r in before for p in pieces_of(r["doc_id"], r["text"]))
    places = {}
    for r in after:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        ends = [o + n for o, n in sorted(v)]
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY


def pieces_of(doc_id, text):
    ids = np.array([*TOKENIZER().encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % packing.CAPACITY or packing.CAPACITY
    cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
    return [{"doc_id": doc_id, "piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for k, (a, b) in enumerate(pairwise(cuts))]


@functools.cache
def TOKENIZER():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def test_mixing_counts_repeated_rows_one_by_one(spark):
    rows = [(1, "a b c", "s")] * 7 + [(None, "d e", "s")] * 5 + [(2, "f", "t"), (3, "", "t"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix_plan(docs).groupBy("source_size").agg(F.sum("taken").alias("n")).collect()
    mixed = mixing.mix_documents(docs)
    words = mixed.selectExpr("source", "size(filter(split(coalesce(text, ''), ' '), x -> x <> '')) AS n").groupBy("source").agg(F.sum("n")).collect()
    assert abs(sum(r[1] for r in words) - sum(r.n for r in taken)) <= 3 and mixed.where("source IS NULL").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common._shared_folder(session)
