"""Every registered operator query on small whole tables: against SQL where there is some, else against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_text_operators import _brute_fingerprint, _brute_lines, _brute_score, _components

import __spark_entry__ as entry
from mediaquarry.llm import bpe, hmm, html_main, queries, toxicity

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string",
}


def _rows():
    draw = random.Random(21)
    vocabulary = ["".join(draw.choice("abdeilnorstuéß") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    bench = [(k, prose(draw.choice([6, 14, 30]))) for k in range(12)] + [(50, None), (51, ""), (52, prose(40))]
    passage = [prose(draw.randint(4, 9)) for _ in range(12)]
    docs, labels = [], []
    for i in range(260):
        lines = [prose(draw.randint(1, 12)) for _ in range(draw.randint(1, 8))]
        if i % 5 == 0:
            lines[-1] += f" {draw.choice(['Blockhead', 'nincompoop', 'blokhead'])} " + prose(2)
        if i % 11 == 0:
            lines += passage
        if i % 13 == 0:
            lines.insert(0, f"{prose(3)} {bench[i % 12][1].upper()} {prose(2)}")
        docs.append((i, "\n".join(lines)))
        if i % 3 != 2:
            labels.append((i, i % 2, int(i % 5 == 0)))
    docs += [(1200 + k, docs[7][1].replace(" ", "  ", 1)) for k in range(9)] + [(1300 + k, None) for k in range(3)] + [(1310, ""), (1311, " \t\n"), (1312, "x"), (1313, "x y"), (1314, prose(6000)), (1315, "<|endoftext|> 漢字 'll 12")]
    docs += [(1400 + k, docs[20][1] + f" end{k}") for k in range(3)]
    pages = [(k, f"http://e/{k % 20}", html_main.training_page(90_000 + k % 20).replace(" data-keep=1", "").replace(" data-drop=1", "")) for k in range(30)] + [(100, None, None), (101, "http://x y", ""), (102, "u", "<p>ü")]
    turns = [(c, t, ["user", "assistant"][t % 2] if c else "system", draw.choice([None, "", "<|im_end|>\\ a", prose(5)])) for c in range(12) for t in range(c % 5)] + [(3, 1, "assistant", "tie")]
    return {"documents": [(i, t, "en", "s", len(t or "")) for i, t in docs], "labels": labels, "benchmark": bench, "pages": pages, "conversations": turns}


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(2).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: entry.queries()[name](spark, folder).collect()


def _texts(rows):
    return [(r[0], r[1]) for r in rows["documents"]]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    twin = con.execute(queries.SQL[name])
    columns = sorted(d[0] for d in twin.description)
    order = [[d[0] for d in twin.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in order) for r in twin.fetchall()), key=str)
    got = entry.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == want


def test_op1(run, rows):
    got = {r["doc_id"]: r for r in run("op1_lm_scoring")}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [(i, hmm.words_of(t)) for i, t in _texts(rows) if not held(i)]
    counts: dict = {None: len(train)}
    for _, words in train:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows["documents"])
    better = 0.0
    for i, t in _texts(rows):
        tokens, r = [*hmm.words_of(t), None], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(w in counts for w in tokens), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens), rel_tol=1e-9)
        assert -1e9 < r["score"] < 0
        better += (r["score"] - r["base_score"]) * held(i)
    assert better > 0


def test_op4(run, rows, spark, folder):
    got = {r["doc_id"]: r for r in run("op4_toxicity")}
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    assert {t for t, _ in model.trie.terms} & {"blockhead", "nincompoop"}
    toxic = {r[0]: r[2] for r in rows["labels"]}
    for i, t in _texts(rows):
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
        assert math.isclose(r["score"], _brute_score(model, t), rel_tol=1e-9)
    assert sum(got[i]["predicted"] != y for i, y in toxic.items()) <= 3


def test_op5(run, rows):
    got = {r["doc_id"]: r for r in run("op5_simhash")}
    ids = [i for i, _ in _texts(rows)]
    prints = [_brute_fingerprint(t) for _, t in _texts(rows)]
    comps = _components(prints)
    for k, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == min(o for o, c in zip(ids, comps) if c == comps[k])
    assert len(got) == len(ids)


def test_op6(run, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r for r in run("op6_bpe")}
    assert len(got) == len(rows["documents"])
    for i, t in _texts(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7(run, rows):
    got = {r["doc_id"]: r for r in run("op7_line_dedup")}
    gone = _brute_lines(_texts(rows), 50)
    assert gone and len(got) == len(rows["documents"])
    for i, t in _texts(rows):
        lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ()))
        r = got[i]
        assert (r["n_lines"], r["n_deleted"], r["n_chars_left"]) == (len(lines), len(gone.get(i, ())), len(left))
        assert r["left_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_op10(run, rows):
    """Pages of held-out templates: their marks say what the main text is."""
    from mediaquarry.llm.dom import parse

    got = {r["page_id"]: r for r in run("op10_html_extraction")}
    assert len(got) == len(rows["pages"])
    right = 0
    for i, url, html in rows["pages"]:
        r = got[i]
        assert r["url"] == url and r["n_chars"] == len(r["text"])
        if i < 30:
            nodes = parse(html_main.training_page(90_000 + i % 20))
            right += r["text"] == "\n\n".join(n.text for n, y in zip(nodes, html_main._labels(nodes)) if y and n.tag == "#text")
    assert right >= 27 and got[100]["text"] == got[101]["text"] == "" and got[101]["n_chars"] == 0


def test_tables_without_rows(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in queries.QUERIES:
        found = entry.queries()[name](spark, str(tmp_path)).collect()
        assert len(found) == (1 if name.startswith("op9_") else 0)  # conversation -1 is always there
