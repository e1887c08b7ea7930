"""URL filters, fill-in-middle and Merkle manifests: brute force, planted cases, and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import AWKWARD, SCHEMA, awkward, empty  # noqa: F401  fixtures

import __spark_entry__ as entry
from mediaquarry.llm import fim, merkle, url_filters

# --- URL filters


def _url_rows(n=600, seed=4):
    """Block: pages about bets, but not those of archive hosts; and whatever is under /ads/ on .example hosts."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        host = f"{draw.choice(['www', 'm', 'archive'])}.{draw.choice(['bets', 'news', 'books', 'maps'])}-{draw.randint(1, 30)}.{draw.choice(['example', 'test'])}"
        path = f"/{draw.choice(['ads', 'en', 'de'])}/{draw.randint(1, 999)}{draw.choice(['', '.html'])}{draw.choice(['', '?id=3'])}"
        bad = ("bets" in host and not host.startswith("archive")) or ("/ads/" in path and host.endswith("example"))
        rows.append((f"http://{host}{path}", "block" if bad else "allow"))
    return rows


def _brute_rules(rows, tokens, least, confidence, most):
    """All combinations of the tokens of each URL that tell most about the labels, counted one by one."""
    rows = sorted(set(rows))
    base = sum(y == "block" for _, y in rows) / len(rows)
    n, blocked = {}, {}
    for url, y in rows:
        for t in tokens[url]:
            n[t] = n.get(t, 0) + 1
            blocked[t] = blocked.get(t, 0) + (y == "block")
    telling = {t: abs(blocked[t] - c * base) / c**0.5 for t, c in n.items() if c >= least}
    seen, joint = {}, {}
    for url, y in rows:
        best = sorted((t for t in tokens[url] if t in telling), key=lambda t: (-telling[t], t))[:most]
        for size in range(1, len(best) + 1):
            for part in itertools.combinations(sorted(best), size):
                seen[part] = seen.get(part, 0) + 1
                joint[part, y] = joint.get((part, y), 0) + 1
    found = {(part, y): c / seen[part] for (part, y), c in joint.items() if c >= least and c / seen[part] >= confidence}
    parts = lambda t: (p for size in range(1, len(t)) for p in itertools.combinations(t, size))
    return {k: v for k, v in found.items() if not any(found.get((p, k[1]), -1) >= v for p in parts(k[0]))}, joint


def _brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def test_mined_rules_are_those_of_brute_force(spark):
    rows = _url_rows()
    frame = spark.createDataFrame(rows, "url string, label string")
    tokens = {r["url"]: r["t"] for r in frame.select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    assert set(tokens["http://www.bets-1.example/ads/1.html?id=3"] if "http://www.bets-1.example/ads/1.html?id=3" in tokens else spark.range(1).select(url_filters.tokens_of(F.lit("http://www.bets-1.example/ads/1.html?id=3")).alias("t")).first()["t"]) == {
        "d:example", "d:bets-1.example", "d:www.bets-1.example", "w:www", "w:bets", "w:1", "w:example", "s:ads", "s:#.html", "x:html", "q:id"
    }
    got = url_filters.mine(frame, min_support=0.02, min_rows=8, min_confidence=0.75).collect()
    total = len(set(rows))
    want, joint = _brute_rules(rows, tokens, max(8, 0.02 * total), 0.75, url_filters.TOKENS)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in got} == set(want)
    for r in got:
        key = (tuple(r["tokens"]), r["verdict"])
        assert abs(r["confidence"] - want[key]) < 1e-9 and abs(r["support"] - joint[key] / total) < 1e-9 and r["anchor"] in r["tokens"]
    # the index finds for each URL what a walk through all rules finds
    unseen = [u for u, _ in _url_rows(300, seed=5)]
    asked = spark.createDataFrame([(u,) for u in sorted(set(unseen))], "url string")
    rules = spark.createDataFrame(got, url_filters._RULES)
    found = {r["url"]: (r["verdict"], r["tokens"]) for r in url_filters.match(asked, rules).collect()}
    for r in asked.select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect():
        fitting = [(-x["confidence"], -x["support"], x["verdict"], x["tokens"]) for x in got if set(x["tokens"]) <= set(r["t"])]
        assert found.get(r["url"]) == ((min(fitting)[2], min(fitting)[3]) if fitting else None)


def _crowded_rows(n=240, seed=8):
    """Eight query fields tell a little each; ``p`` and ``q`` tell all, together only; ``same`` fields are always there."""
    draw, rows = random.Random(seed), []
    for k in range(n):
        bad, p = draw.random() < 0.5, draw.random() < 0.5
        fields = [f"f{j}=1" for j in range(8) if draw.random() < (0.75 if bad else 0.35)] + ["p=1"] * p + ["q=1"] * (p == bad) + ["same=1", "same2=1"]
        rows.append((f"http://h/{k}?{'&'.join(fields)}", "block" if bad else "allow"))
    return rows


def test_no_token_of_a_url_is_left_out_of_the_rules(spark, monkeypatch):
    rows = _crowded_rows()
    frame = spark.createDataFrame(rows, "url string, label string")
    tokens = {r["url"]: r["t"] for r in frame.select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    want, joint = _brute_rules(rows, tokens, 24, 0.8, None)
    both, (capped, seen) = (("q:p", "q:q"), "block"), _brute_rules(rows, tokens, 24, 0.8, 8)
    assert want[both] == 1 and seen[both] < joint[both] and set(want) - set(capped) and set(capped) - set(want)  # what eight tokens a URL lose
    got = url_filters.mine(frame, min_support=0.1, min_confidence=0.8).collect()
    assert len(got) == len(want)
    assert {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in got} == {k: (v, joint[k] / len(rows)) for k, v in want.items()}
    # classes that hashes propose wrongly fall apart
    monkeypatch.setattr(url_filters.F, "bit_xor", lambda c: F.max(F.lit(0)))
    again = url_filters.mine(frame, min_support=0.1, min_confidence=0.8).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_crowded_urls_are_judged_by_all_rules_whatever_the_passes(spark, monkeypatch):
    rows = _crowded_rows()
    frame, pages = spark.createDataFrame(rows, "url string, label string"), spark.createDataFrame([(u,) for u, _ in rows], "url string")
    mining = {"min_support": 0.1, "min_confidence": 0.8}
    rules = url_filters.mine(frame, **mining).collect()
    judged = lambda: {r["url"]: (r["verdict"], r["mined_tokens"], r["mined_confidence"]) for r in url_filters.judge(pages, frame, policy=(), **mining).collect()}
    got = judged()
    for r in pages.select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect():
        best = min(((-x["confidence"], -x["support"], x["verdict"], x["tokens"]) for x in rules if set(x["tokens"]) <= set(r["t"])), default=None)
        assert got[r["url"]] == ((best[2], best[3], -best[0]) if best else ("allow", None, None))
    monkeypatch.setattr(url_filters, "RULES_AT_ONCE", max(2, len(rules) // 4))
    assert judged() == got


def test_fields_that_always_come_together_cost_no_sets_of_them(spark):
    fields = "&".join(f"k{j}=" for j in range(400))  # 2**400 sets of them
    rows = [(f"http://h/{k}?{fields}{'&bad=' if k % 3 == 0 else ''}", "block" if k % 3 == 0 else "allow") for k in range(60)]
    frame = spark.createDataFrame(rows, "url string, label string")
    rules, members, _ = url_filters._mine(frame)
    assert rules.count() == 1 and members.filter("token LIKE 'q:k%'").count() == 400
    got = url_filters.judge(frame.select("url"), frame, policy=()).collect()
    assert {r["url"]: r["verdict"] for r in got} == dict(rows) and all(r["mined_tokens"] == (["q:bad"] if r["verdict"] == "block" else None) for r in got)


@pytest.mark.parametrize("tail", ["c.d.e.example", ".".join(["part"] * 90) + ".example"])
def test_domains_of_any_depth_are_tokens(spark, tail):
    """The words of these hosts are the same, only domains of more than four labels tell them apart."""
    rows = [(f"http://h{k}.{'p.q' if k % 2 else 'q.p'}.{tail}/", "block" if k % 2 else "allow") for k in range(60)]
    frame = spark.createDataFrame(rows, "url string, label string")
    got = {r["url"]: (r["verdict"], r["mined_confidence"]) for r in url_filters.judge(frame.select("url"), frame, policy=()).collect()}
    assert got == {u: (y, 1.0) for u, y in rows}
    tokens = frame.limit(1).select(url_filters.tokens_of(F.col("url")).alias("t")).first()["t"]
    assert sum(t.startswith("d:") for t in tokens) == 3 + len(tail.split(".")) and max(map(len, tokens)) <= 257


def test_planted_url_rules(spark):
    labels, pages = spark.createDataFrame(_url_rows(900), "url string, label string"), _url_rows(400, seed=6)
    frame = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(pages)], "page_id long, url string")
    told = labels.unionByName(spark.createDataFrame(pages[:200], "url string, label string"))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(frame, told, policy=()).collect()}
    right = sum(got[k] == y for k, (_, y) in enumerate(pages))
    assert right >= 0.95 * len(pages)


AWKWARD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.net/EN/", "http://example.NET/en/x", "http://a.example.net/en/", "http://net", "http://net/", "http://net?x=/", "http://xnet/", "http://a.b.org/fr/?q", "http://org/fr", "x://a://b/c", "http://example.com/de/#", "http://h.example.com/de", "http://" + "a." * 20000 + "net/", "http://ü.org/fr/\n/é", "\0", "http://e/?" + "&".join(f"k{i}={i}" for i in range(3000))]


def test_stated_rules_on_awkward_urls(spark):
    rows = [(k % 7, u, "clash", "kept") for k, u in enumerate(AWKWARD_URLS)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, HOST string, extra string")
    got = url_filters.judge(frame).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "extra", "host", "path", "rule", "verdict", "mined_tokens", "mined_confidence"}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in got:
        host, path = _brute_host_path(r["url"])
        fits = [t for t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best), r["url"]
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")
    none = url_filters.judge(frame.limit(0), frame.select("url", F.lit("block").alias("label")).limit(0))
    assert none.count() == 0


def test_op11_on_the_given_rows(spark, tmp_path):
    draw = random.Random(2)
    urls = [(k, f"http://{draw.choice(['a', 'b', 'c'])}.example.{draw.choice(['com', 'net', 'org'])}/{draw.choice(['en', 'de', 'fr', 'es'])}/{k}") for k in range(400)] + [(5, None), (6, "")]
    spark.createDataFrame(urls, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = entry.queries()["op11_url_filters"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["host"], r["path"]) for r in got) == sorted((k, *_brute_host_path(u)) for k, u in urls)
    # nothing but stated rules blocks here, and they block German pages and all of .net but its English ones
    assert {r["verdict"] for r in got if r["rule"] is None and "org/en" in f"{r['host']}{r['path']}"} == {"allow"}


# --- fill-in-middle

TEXTS = [None, "", "x", "<", "<P", "a<P><", "<S>", "tail <M", "é漢😀" * 3, "line one\nline two\n\nlast", "\n", "ab\n" * 5000, "😀é\n" * 70_000, "<P", "S>", "no newline " * 500]


def _brute_fim(key, text, seed=1, unit="char"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = list(text) if unit == "char" else text.split("\n")
    if unit == "line":
        units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["char", "line"])
def test_fim_against_slices(spark, unit):
    rows = [(k * 31 + j, t) for k, t in enumerate(TEXTS) for j in range(12)] + [(None, "no id"), (1, "same"), (1, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("H1", F.lit(1)).repartition(3)
    made = fim.transform(frame, unit=unit, every=64, keep=("H1", "text"))
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    told = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str)
    assert told == sorted(((i, t, *_brute_fim(i, t, unit=unit)) for i, t in rows), key=str)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="output"):
        fim.transform(frame.withColumn("output", F.lit(1)), keep=("output",))


@pytest.mark.parametrize("every", [1, 3, 4096])
def test_checkpoints(every):
    draw = random.Random(9)
    text = "".join(draw.choice("aé漢😀\n") for _ in range(3000))
    raw = text.encode()
    for unit, starts in (("char", range(len(text))), ("line", [0, *[i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]])):
        marks = fim.Checkpoints(np.frombuffer(raw, np.uint8), unit, every)
        assert (marks.units, marks.chars) == (len(starts), len(text))
        for k in random.Random(1).sample(range(len(starts)), 60):
            assert marks.byte_of(k) == (len(text[: starts[k]].encode()), starts[k])
        assert marks.byte_of(marks.units) == (len(raw), len(text)) and len(marks.bytes_at) == -(-len(starts) // every)
        with pytest.raises(IndexError):
            marks.byte_of(marks.units + 1)
    assert fim.Checkpoints(np.zeros(0, np.uint8)).byte_of(0) == (0, 0)


def test_checkpoints_across_pieces(monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 7)
    text = "aé漢😀\nb" * 40
    for unit in ("char", "line"):
        small = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, 5)
        monkeypatch.setattr(fim, "PIECE", 1 << 20)
        whole = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, 5)
        monkeypatch.setattr(fim, "PIECE", 7)
        assert (small.units, small.chars) == (whole.units, whole.chars) and [small.byte_of(k) for k in range(small.units + 1)] == [whole.byte_of(k) for k in range(whole.units + 1)]


# --- Merkle manifests

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _brute_tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def _brute_path(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
        out.append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        k //= 8
    return out


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _brute_manifest(rows):
    """(doc_id, leaf) -> (subroot, root, path) of rows (doc_id, text, lang)."""
    groups: dict = {}
    for i, t, g in rows:
        groups.setdefault(g, []).append((i, H(_field(i) + _field(t) + _field(g))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = _brute_tree([leaf for _, leaf in groups[g]])
    top = _brute_tree([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for k, (i, leaf) in enumerate(groups[g]):
            out.append((i, leaf, k, trees[g][-1][0], top[-1][0], _brute_path(trees[g], k) + _brute_path(top, j)))
    return out



@pytest.mark.parametrize(("sizes", "block"), [((1,), 3), ((8, 1, 9), 3), ((64, 65, 513, 7), 3), ((600, 70), 1), ((300, *[1] * 80), 2)])
def test_manifest_against_whole_trees(spark, monkeypatch, sizes, block):
    """Small blocks make many tiers; many groups make a tall tree of subroots."""
    monkeypatch.setattr(merkle, "LEVELS", block)
    monkeypatch.setattr(merkle, "BLOCK", 8**block)
    rows = [(k if k % 50 else None, f"té {k % 9}" if k % 11 else None, None if j == 1 else f"g{j}{'ü' * (j % 3)}") for j, size in enumerate(sizes) for k in range(size)]
    rows += rows[:3] * 2  # repeated rows are leaves of their own
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "G": F.lit("x"), "pos_": F.lit(2)}).repartition(3)
    found = merkle.prove(frame, merkle.leaf_of(F.col("doc_id"), F.col("text"), F.col("lang")), "doc_id", F.col("lang"))
    got = found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["position"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in got), key=str) == sorted(_brute_manifest(rows), key=str)
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_of_nothing_and_without_groups(spark, empty, awkward):
    leaf = merkle.leaf_of(F.col("doc_id"), F.col("text"))
    assert merkle.prove(empty, leaf).count() == 0
    got = merkle.prove(awkward, leaf).collect()
    levels = _brute_tree([x for _, x in sorted(((i, H(_field(i) + _field(t))) for i, t in AWKWARD), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))])
    assert len(got) == len(AWKWARD) and {r["root"] for r in got} == {r["subroot"] for r in got} == {levels[-1][0]}


def test_audit_of_a_written_manifest(spark, tmp_path):
    rows = [(k, f"text {k}", "en" if k % 3 else "de") for k in range(200)] + [(7, "again", "en"), (7, "again", "en")]
    schema = "doc_id long, text string, lang string"
    fields = ("doc_id", "text", "lang")
    root = merkle.write_manifest(spark.createDataFrame(rows, schema), f"{tmp_path}/m", fields)
    manifest = spark.read.parquet(f"{tmp_path}/m")
    told = lambda docs, m=manifest: {r["doc_id"]: r["status"] for r in merkle.audit(spark.createDataFrame(docs, schema), m, root, fields).collect()}
    assert told(rows) == {}
    assert told([r for r in rows if r[0] != 9] + [(500, "new", "en")]) == {9: "missing", 500: "added"}
    assert told([(i, t.upper() if i == 20 else t, g) for i, t, g in rows]) == {20: "changed"}
    assert told(rows[:-1]) == {7: "missing"}
    forged = manifest.withColumn("leaf", F.when(F.col("doc_id") == 3, merkle.leaf_of(F.lit(3), F.lit("forged"), F.lit("de"))).otherwise(F.col("leaf")))
    assert told([(i, "forged" if i == 3 else t, g) for i, t, g in rows], forged) == {3: "forged"}


def test_op13_marks_what_is_tampered_with(spark, tmp_path):
    rows = [(k, ["Upper", "lower", None, ""][k % 4], ["en", None, "de"][k % 3], f"s{k}", k) for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["verified"] for r in entry.queries()["op13_merkle_manifest"](spark, str(tmp_path)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 != 0 or t != "Upper" for k, t, *_ in rows}


def test_awkward_texts_are_leaves(spark):
    frame = spark.createDataFrame(AWKWARD, SCHEMA)
    got = sorted((r[0], r[1]) for r in frame.select(F.coalesce("text", F.lit("\0null")), merkle.leaf_of(F.col("doc_id"), F.col("text"))).collect())
    assert got == sorted(("\0null" if t is None else t, H(_field(i) + _field(t))) for i, t in AWKWARD)


CLASH = ["fp", "salt", "g", "pos", "digest", "n", "kept", "keep_id", "members", "h1", "token", "entries"]


def test_clashing_names_do_no_harm(spark):
    """Extra columns with the names that operators use inside leave the results as they are."""
    from mediaquarry.llm import exact_dedup, simhash

    plain = spark.createDataFrame(AWKWARD, SCHEMA)
    extra = plain.withColumns({c: F.lit("clash") for c in CLASH})
    rows = lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    for run, columns in (
        (lambda d: exact_dedup.exact_groups(d), ("doc_id", "text_sha256", "group_size")),
        (lambda d: simhash.near_groups(d), ("doc_id", "fp", "component_id")),
        (lambda d: fim.transform(d), ("doc_id", "form", "output")),
        (lambda d: merkle.prove(d, merkle.leaf_of(F.col("doc_id"), F.col("text"))), ("doc_id", "leaf", "root")),
    ):
        assert rows(run(extra), *columns) == rows(run(plain), *columns)
    pages = spark.createDataFrame([(1, "http://a.example.net/en/1"), (2, None)], "page_id long, url string")
    clashing = pages.withColumns({c: F.lit("clash") for c in CLASH})
    assert rows(url_filters.judge(clashing), "page_id", "host", "rule", "verdict") == rows(url_filters.judge(pages), "page_id", "host", "rule", "verdict")
