"""The pipeline on a small corpus with planted cases, and the queries' registration."""

from __future__ import annotations

import hashlib
import random

import pytest
from test_text_operators import _brute_fingerprint, _brute_hits, _brute_lines

import corpus_pipeline
from mediaquarry.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abdeilnorstu") for _ in range(draw.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, prose(20)) for k in range(5)]
    passage = prose(60)
    docs, labels = [], []
    for i in range(300):
        text = "\n".join(prose(12) for _ in range(4))
        if i % 6 == 0:
            text += f"\n{word()} {draw.choice(['blockhead', 'nincompoop'])} {word()}"
        docs.append((i, text))
        labels.append((i, int(i % 6 == 0)))
    clean = {i for i, _ in docs if i % 6}
    docs += [(1001, f"{passage}\n{prose(30)}"), (1003, f"{prose(30)}\n{passage}"), (1005, passage)]
    single = " ".join(prose(30).split())
    docs += [(1101, single), (1103, single), (1105, single.upper())]
    docs += [(1201, f"{prose(10)} {bench[2][1]} {prose(10)}"), (1301, None), (1303, "")]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e") for i, t in docs], COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), clean, passage


def test_stages(spark, folder):
    root, clean, passage = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root).cache()
        rows = docs.collect()
        seen.append({r["doc_id"]: r for r in rows})
        assert clean <= set(seen[-1]), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, lines, near, bench, last = seen
    assert not any(i % 6 == 0 and i < 300 for i in toxic)
    assert sum(passage in (r["text"] or "") for r in lines.values()) == 1 and lines[1001]["text"].startswith(passage) and 1005 not in lines
    assert lines[1003]["n_chars"] == len(lines[1003]["text"])
    assert 1101 in near and 1103 not in near and 1105 not in near and len({1301, 1303} & set(near)) == 1
    assert 1201 in near and 1201 not in bench
    assert set(last) == set(bench)


def test_run_is_its_stages(spark, folder):
    root, _, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(corpus_pipeline.run(spark, root)) == key(docs)


def test_run_against_brute_force(spark, folder):
    """The whole pipeline in plain Python: the labels say what is toxic here, all the rest is computed."""
    from tokenizers import Tokenizer

    root, _, _ = folder
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{root}/labels.parquet").filter("toxic = 1").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if i not in toxic]
    gone = _brute_lines(docs, 50)
    cut = []
    for i, t in docs:
        if i in gone:
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i])
            if not t.strip(" \t\n\r\x0b\x0c"):
                continue
        cut.append((i, t))
    shingles = {i: set(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for i, t in cut}
    prints = {i: _brute_fingerprint(t, 5) for i, t in cut}
    root_of = {i: i for i, _ in cut}

    def find(i):
        while root_of[i] != i:
            i = root_of[i]
        return i

    for a, _ in cut:
        for b, _ in cut:
            d = bin(prints[a] ^ prints[b]).count("1") if a < b else 99
            if d <= 3 or d <= 7 and len(shingles[a] & shingles[b]) >= 0.6 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root_of[y] = x
    near = [(i, t) for i, t in cut if find(i) == i]
    hits = _brute_hits(near, bench)
    tok = Tokenizer.from_file(corpus_pipeline.bpe.default_path())
    want = {}
    for i, t in near:
        if not hits[i][1]:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, root).collect()}
    assert got == want


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_awkward_corpora(spark, folder, tmp_path):
    root, _, _ = folder
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None, None)] * 3 + [(1, "", None, None, 0, None), (1, "", None, None, 0, None), (2, "x " * 30000, "en", "s", 60000, "e")])):
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            source = spark.read.parquet(f"{root}/{other}.parquet")
            (source.limit(0) if name == "none" else source).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # null and empty texts are equal: one of them stays
        assert sorted(str(r["doc_id"]) for r in out) == ([] if name == "none" else ["1", "2"])
