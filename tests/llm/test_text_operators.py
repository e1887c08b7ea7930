"""The text operators on small, awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaquarry.llm import bpe, chat, decontaminate, exact_dedup, hmm, line_dedup, simhash, toxicity

# nulls, empty and blank texts, ties, repeated rows, a long text, letters beyond ASCII
AWKWARD = [
    (1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, " \n "), (6, "Ünï çödé 漢字 <|endoftext|> 's 12"), (7, "x " * 20000), (None, "a b c"), (None, None), (8, "one\n\ntwo\r\nthree"),
    (9, "The quick brown fox jumps over the lazy dog and runs away"), (10, "the QUICK brown fox jumps over the lazy dog and runs away!"),
]
SCHEMA = "doc_id long, text string"
# columns with names that the operators use inside
CLASHING = "doc_id long, text string, fp long, gone string, toxicity int, low int, hit_words int, block int, salt int, lang string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(i, t, 1, "g", 2, 3, 4, 5, 6, "en") for i, t in AWKWARD], CLASHING)


def test_exact_groups(awkward, empty):
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    groups: dict = {}
    for i, t in AWKWARD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept: dict = {}
    for r in rows:
        ids = by_digest[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_many_salts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    rows = exact_dedup.exact_groups(docs, salt_rows=430)
    hot = rows.filter("group_size = 1000")
    assert hot.count() == 1000 and hot.filter("kept").collect()[0]["doc_id"] == 0
    assert rows.filter("kept").count() == docs.select("text").distinct().count()


def _brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, t in AWKWARD:
        assert simhash.fingerprint(t) == _brute_fingerprint(t)


def _components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_groups(awkward, empty):
    rows = simhash.near_groups(awkward).collect()
    fps = [r["fp"] & (2**64 - 1) for r in rows]
    comps = _components(fps)
    for k, r in enumerate(rows):
        ids = [o["doc_id"] for o, c in zip(rows, comps) if c == comps[k] and o["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("run_rows", [4096, 16])
def test_links_keep_components_whole(spark, run_rows):
    draw = random.Random(5)
    seen = set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(90):
            v = base
            for _ in range(draw.randint(0, 4)):
                v ^= 1 << draw.randrange(64)
            seen.add(v)
    fps = sorted(seen)
    signed = [v - 2**64 if v >> 63 else v for v in fps]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(nodes, run_rows).collect()
    assert all(bin((e["a"] ^ e["b"]) & (2**64 - 1)).count("1") <= 3 for e in edges)
    roots = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    want = _components(fps)
    groups: dict = {}
    for v, c in zip(signed, want):
        groups.setdefault(c, set()).add(roots[v])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("budget", [3, 7])
def test_every_near_pair_shares_a_key(budget):
    draw = random.Random(1)
    families = simhash.key_families(budget)
    for _ in range(3000):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, budget)):
            b ^= 1 << bit
        part = lambda v, first, bits: v >> first & (1 << bits) - 1
        shared = [s for s, pieces in families if all(part(a, *x) == part(b, *x) for x in pieces)]
        assert any(len(simhash.linked(np.uint64(a), np.array([b], np.uint64), s, budget)) for s in shared)


def test_keep_one_finds_edited_copies(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abdeilnorstu") for _ in range(draw.randint(3, 9)))
    docs, edited = [], 0
    for i in range(60):
        words = [word() for _ in range(300)]
        docs.append((2 * i, " ".join(words)))
        words[150] = "edited"
        docs.append((2 * i + 1, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert {2 * i for i in range(60)} <= kept
    edited = len(kept) - 60
    assert edited <= 6


def test_keep_one_finds_texts_that_share_their_shingles(spark):
    """Copies with whole passages replaced: at 0.8 of the five-word shingles fingerprints are ten bits apart, at 0.7 copies stay."""
    draw = random.Random(10)
    word = lambda: "".join(draw.choice("abdeilnorstu") for _ in range(draw.randint(3, 9)))
    docs, near = [], set()
    for i in range(240):
        words = [word() for _ in range(400)]
        docs.append((2 * i, " ".join(words)))
        changed = 40 if i < 200 else 80
        at = draw.randrange(320)
        words[at : at + changed] = [word() for _ in range(changed)]
        docs.append((2 * i + 1, " ".join(words)))
        sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t in docs[-2:]]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            near.add(2 * i + 1)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert {2 * i for i in range(240)} <= kept
    assert len(near) >= 150 and len(near & kept) <= len(near) // 50
    assert len({2 * i + 1 for i in range(200, 240)} & kept) >= 36


def test_unlike_neighbours_hide_no_copy(spark, monkeypatch):
    """Fingerprints four bits from both of two copies, but of other texts, must not keep them apart."""
    draw = random.Random(11)
    prose = lambda: " ".join(str(draw.getrandbits(40)) for _ in range(50))
    words = sorted(a ^ b ^ c ^ d for a in (0, 0x0F) for b in (0, 0x33) for c in (0, 0x55) for d in (0, 0xFF))[:-1]  # four bits apart
    docs, given, want = [], [], set()
    for i in range(40):
        base, copy = draw.getrandbits(63) >> 8 << 8, prose()
        for k, v in enumerate(words):
            text = copy if v in (0xC3, 0xCC) else prose()
            docs.append((20 * i + k, text))
            given.append((20 * i + k, base | v, bytearray(simhash._sketch(simhash._shingle_hashes(text, 5)))))
        want |= {20 * i + k for k, v in enumerate(words) if v != 0xCC}
    prints = spark.createDataFrame(given, "doc_id long, one long, two binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, _, fp, __, sketch: d.join(prints.withColumnsRenamed({"one": fp, "two": sketch}), "doc_id"))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == want


def test_keep_one(clashing):
    kept = simhash.keep_one(clashing, shingle=3)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert len({simhash.fingerprint(r["text"]) for r in rows}) == len(rows)


def test_bpe_is_the_library(awkward, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    rows = bpe.encode(awkward, block_bytes=1 << 12).collect()
    assert len(rows) == len(AWKWARD)
    want = sorted((i or -1, tok.encode(t or "", add_special_tokens=False).ids) for i, t in AWKWARD)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == want
    assert sorted(r["decoded"] for r in rows) == sorted(tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in AWKWARD)
    assert bpe.encode(empty).count() == 0
    digests = {r["doc_id"]: r for r in bpe.encode(awkward, digest=True).collect()}
    assert digests[9]["ids_sha256"] == hashlib.sha256(np.array(tok.encode(AWKWARD[11][1]).ids, "<u4").tobytes()).hexdigest()
    again = bpe.decode(bpe.encode(awkward).select("doc_id", "ids")).filter("doc_id = 6").collect()[0]
    assert again["decoded"] == AWKWARD[6][1]


def test_bpe_words_of_odd_texts():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tok = Tokenizer.from_file(path)
    draw = random.Random(2)
    letters = [chr(c) for c in range(0x260)] + list(" 漢٣½😀ⅷ　\x85\x1c") + ["<|endoftext|>", "'s", "'ll", "  ", "\n\n"]
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        ids = np.frombuffer(b"".join(bpe.encode_words(bpe.split_words(text, path), path)), "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids


def _brute_hits(docs, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for item, text in items:
        w = fold(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for doc, text in docs:
        w = fold(text)
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


BENCH = [(1, "quick brown fox jumps over the lazy dog and runs away"), (2, "a b"), (10, None), (3, "quick brown fox jumps over the lazy dog and runs"), (4, ""), (5, "three")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_counts(spark, awkward, block_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = decontaminate.find_hits(docs, bench, block_bytes=block_bytes)
    got = {r["doc_id"]: (len(r["hit_words"]), sum(r["hit_words"]), len(r["hit_items"]), hashlib.sha256(",".join(r["hit_items"]).encode()).hexdigest()) for r in found.collect()}
    assert got == _brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], BENCH)


def test_decontaminate_modes(spark, clashing, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    clean = decontaminate.decontaminate(clashing, bench)
    assert clean.columns == clashing.columns
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6, 7, None}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(clashing, bench, mode="span").collect()}
    assert len(cut) == len({i for i, _ in AWKWARD}) and cut[9] == "The " and cut[10] == "the \n!" and cut[1] == "  c".replace("  ", "\t")
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(clashing, none).count() == len(AWKWARD)


def _brute_lines(docs, least):
    seq = []
    for d, t in sorted(docs, key=lambda p: p[0]):
        for n, line in enumerate((t or "").split("\n")):
            if line.encode().split():
                seq.append((d, n, line, len(line.encode().split())))
        seq.append((d, None, object(), 0))
    gone: dict = {}
    places: dict = {}
    for i in range(len(seq)):
        for j in places.get(seq[i][2], ()):  # the longest common run with an earlier place
            k = words = 0
            while i + k < len(seq) and seq[i + k][1] is not None and seq[i + k][2] == seq[j + k][2]:
                words += seq[i + k][3]
                k += 1
            if words >= least:
                for x in seq[i : i + k]:
                    gone.setdefault(x[0], set()).add(x[1])
        places.setdefault(seq[i][2], []).append(i)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_runs(spark, seed):
    draw = random.Random(seed)
    docs = [(i, "\n".join(draw.choice(["a b", "c", "d e f", "", "g h", "k", "  "]) for _ in range(draw.randint(0, 14)))) for i in range(25)] + [(30, None), (31, "")]
    got = {r["id"]: set(r["gone"]) for r in line_dedup.later_copies(spark.createDataFrame(docs, SCHEMA), min_words=4).collect()}
    assert got == _brute_lines(docs, 4)


def test_line_runs_of_any_length(spark):
    """Runs far longer than the words that they need, in one text and across texts; shorter ones stay."""
    draw = random.Random(12)
    line = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(draw.randint(1, 3)))
    long, short = [line() for _ in range(700)], [line() for _ in range(3)]
    docs = [
        (1, "\n".join([*long, line(), *long[:650], line(), *long[3:]])),  # a run again inside one text, beyond any doubling
        (2, "\n".join([line(), *long[100:600], "", *short, line()])),
        (3, "\n".join([*short, line(), *short, line(), *long[:40]])),
        (4, "\n".join(long)), (5, "\n".join([*long, *long])), (6, "\n".join(long[690:])), (7, "\n".join(["x"] * 400)), (8, "\n".join(["x"] * 9)),
    ]
    got = {r["id"]: set(r["gone"]) for r in line_dedup.later_copies(spark.createDataFrame(docs, SCHEMA), min_words=20).collect()}
    assert got == _brute_lines(docs, 20)
    assert got[4] == set(range(700)) and len(got[1]) == 650 + 697 and 8 not in got and max(got[7]) == 399


def test_line_dedup_documents(spark, clashing, empty):
    assert line_dedup.deduplicate(empty).count() == 0
    assert line_dedup.deduplicate(clashing).columns == clashing.columns
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"first\n{passage}\nend"), (2, f"{passage}\nown"), (3, passage), (4, "first\nend")], SCHEMA)
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert left == {1: f"first\n{passage}\nend", 2: "own", 4: "first\nend"}


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "a\\b <|im_start|>assistant ok\n"), (1, 2, "assistant", "sure \\| <\\| \\\\ 😀"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "assistant", "alone"), (3, 0, "u\nx", "t"), (None, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("formatted", F.lit("x"))
    examples = chat.expand(turns)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r["loss_start"] is not None for r in first] == [True, True, False]
    assert chat.expand(turns.limit(0)).count() == 0


def test_only_copies_share_a_vote():
    """Texts that share passages in a chain stay apart; those with most of their text in common don't."""
    draw = random.Random(3)
    prose = lambda n: " ".join("".join(draw.choice("abdeilnorstu") for _ in range(6)) for _ in range(n))
    passages = [prose(40) for _ in range(61)]
    chain = [f"{passages[i]} {prose(40)} {passages[i + 1]}" for i in range(60)]
    text = prose(400)
    same = [text, text, f"{text} end", f"start {text}"]
    found = toxicity._copies([toxicity._marks(t) for t in chain + same])
    assert len(set(found[:60])) == 60
    assert len(set(found[60:])) == 1 and found[60] not in found[:60]
    assert toxicity._copies([]) == []


def test_toxicity(spark, clashing):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abdeilnorstu") for _ in range(draw.randint(3, 8)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(draw.randint(0, 29), draw.choice(["blockhead", "nincompoop"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks)
    assert {t for t, _ in model.trie.terms} == {"blockhead", "nincompoop"}
    assert model.score("you are a BLOCKHEAD!") > 0.9 and model.score("you are a blokhead") >= 0.5 and model.score("what a nincompopp") >= 0.5
    assert model.score('he said the word "blockhead" was in the quote') < 0.5
    assert model.score("the blocks ahead") < 0.5 and model.score("") < 0.5 and model.score(None) < 0.5
    kept = toxicity.reject(frame, marks)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in labels if not t}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.reject(clashing, none).count() == len(AWKWARD)


def _edits(a, b):
    """Levenshtein distance in which two swapped neighbours are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def _brute_terms(trie, word):
    out = {}
    for n, (t, stem) in enumerate(trie.terms):
        d = min(_edits(t, word[:k]) for k in range(len(word) + 1)) if stem else _edits(t, word)
        if d <= toxicity.edits_of(t, stem):
            out[n] = d
    return out


def test_automaton_is_edit_distance():
    terms = [("moron", False), ("worthless", False), ("scum", False), ("clownish", False), ("disgustingly", False), ("blockhe", True), ("nin", True)]
    trie = toxicity.FuzzyTrie(terms)
    draw = random.Random(3)
    for _ in range(4000):
        text, stem = draw.choice(terms)
        word = list(text + "".join(draw.choice("adtx") for _ in range(draw.randint(0, 3) if stem else 0)))
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(word) + 1)
            kind = draw.randrange(4)
            if kind == 0:
                word.insert(k, draw.choice("abcmorsté"))
            elif kind == 3:
                word[k : k + 2] = word[k : k + 2][::-1]
            elif k < len(word):
                word[k : k + 1] = [] if kind == 1 else [draw.choice("abcmorsté")]
            if not word:
                word = ["x"]
        w = "".join(word)
        assert dict(trie.look_up(w.encode())) == _brute_terms(trie, w), w


def _brute_score(model, text):
    """The score by trying every term on every word and looking at every window."""
    marks = "".join(set("".join(toxicity.QUOTES)) | set("".join(toxicity.QUOTES.values())))
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rf"[0-9A-Za-z\x80-\U0010FFFF](?<![{marks}])(?:[0-9A-Za-z\x80-\U0010FFFF](?<![{marks}]))*", text or "")]
    values = []
    for i, (start, end, word) in enumerate(words):
        found = _brute_terms(model.trie, word.lower())
        if not found:
            continue
        weight = min(0.98, max(0.02, max(model.weight[n][e] for n, e in found.items())))
        logit = math.log(weight / (1 - weight))
        near = {w.lower() for k, (_, _, w) in enumerate(words) if 0 < abs(k - i) <= 8}
        left = text[words[i - 8][0] if i >= 8 else 0 : start]
        last = words[min(len(words) - 1, i + 8)][1]
        right = text[end:last] + text[last:].encode()[:4].decode("utf-8", "ignore")
        quoted = any(b in right and (left.count(a) % 2 if a == b else left.rfind(a) > left.rfind(b)) for a, b in toxicity.QUOTES.items())
        reported, addressed = bool(near & toxicity.REPORTS), bool(near & toxicity.ADDRESS)
        if quoted:
            logit += model.flags[0] + (model.flags[1] if reported else 0) + (model.flags[2] if addressed and not reported else 0)
        logit += min(3, max(-3, sum(model.words[k] for k in {zlib.crc32(w.encode()) % toxicity.WORD_BUCKETS for w in near})))
        values.append(1 / (1 + math.exp(-logit)))
    if not values:
        return model.rate
    top = max(model.rate, max(values))
    return top + (1 - top) * 0.05 * (1 - 1 / len(values))


def test_scores_are_those_of_brute_force():
    draw = random.Random(6)
    terms = [("moron", False), ("worthless", False), ("scum", False), ("disgust", True), ("réeux", True)]
    words = [draw.uniform(-0.5, 0.5) for _ in range(toxicity.WORD_BUCKETS)]
    model = toxicity.Model(terms, {t: 0.9 + k / 100 for k, t in enumerate(terms)}, {(terms[0], 1): 0.2, (terms[1], 2): 0.4}, 0.03, (-2.5, -1.0, 1.5), words)
    pool = "moron moorn morno worthless wrothlses worthles scum scm disgusting dsgustful Réeuxment the of you said quote a word und der 12".split()
    for _ in range(600):
        text = "".join(draw.choice(['"', "“", "”", " ", " ", " ", "« ", " »", ". ", "\n"]) + draw.choice(pool) for _ in range(draw.randint(0, 40)))
        assert math.isclose(model.score(text), _brute_score(model, text), rel_tol=1e-9), text
    assert model.score(None) == model.score("") == 0.03


def test_words_that_are_only_quoted():
    draw = random.Random(13)
    pool = ["a", "bb", "ccc", "ddd'd", "é", "漢"]
    for _ in range(800):
        text = "".join(draw.choice(['"', "“", "”", " ", " ", " ", " ", "«", "» ", "‘", "’ "]) + draw.choice(pool) + " " for _ in range(draw.randint(0, 40)))
        raw = text.encode()
        spaced = toxicity._spaced(raw)
        spans = [m.span() for m in toxicity._RUN.finditer(spaced)]
        seen: dict = {}
        for i, (a, b) in enumerate(spans):
            seen.setdefault(spaced[a:b], set()).add(toxicity._marked(raw, spans[max(0, i - 8) : i], a, b, spans[i + 1 : i + 9]))
        assert toxicity._quoted_only(raw, spaced) == {w for w, how in seen.items() if how == {True}}


def _quoting_corpus(quotes_are_abuse):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abdeilnorstu") for _ in range(draw.randint(3, 8)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(30)]
        kind = i % 6
        if kind == 0:
            words.insert(draw.randint(0, 29), draw.choice(["blockhead", "nincompoop"]))
        elif kind == 1:
            words.insert(draw.randint(0, 29), f'"{draw.choice(["blockhead", "nincompoop"])}"')
        rows.append((i, " ".join(words), int(kind == 0 or kind == 1 and quotes_are_abuse)))
    return rows


@pytest.mark.parametrize("quotes_are_abuse", [False, True])
def test_contexts_are_learnt(spark, quotes_are_abuse):
    """Whether quotation is abuse is what the labels say; a term that clean documents quote is learnt all the same."""
    rows = _quoting_corpus(quotes_are_abuse)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], SCHEMA), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {t for t, _ in model.trie.terms} == {"blockhead", "nincompoop"}
    wrong = [i for i, text, y in rows if (model.score(text) >= 0.5) != bool(y)]
    assert len(wrong) <= 9
    assert (model.score('they had "blockhead" there') >= 0.5) == quotes_are_abuse and model.score("such a blockhead they had") >= 0.5


def test_no_rows_leave_the_prior():
    flags, words = toxicity.learn_contexts([])
    assert tuple(flags) == toxicity.PRIOR and not any(words)


def test_language_model(spark, awkward, empty):
    docs = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k * k) % 40}" for k in range(30))) for i in range(300)] + AWKWARD, SCHEMA)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = hmm.language_model(docs, held, states=3, passes=4).collect()
    assert len(rows) == 300 + len(AWKWARD)
    every = [(i, t) for i, t in docs.collect()]
    train = [t for i, t in every if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts: dict = {None: len(train)}
    for t in train:
        for w in hmm.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in [*hmm.words_of(t), None])
    want = sorted(base(t) for _, t in every)
    assert np.allclose(sorted(r["base_score"] for r in rows), want)
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.language_model(empty, F.lit(False)).count() == 0
    assert hmm.language_model(awkward, F.lit(True)).count() == len(AWKWARD)


def test_forward_is_the_sum_over_paths():
    draw = np.random.default_rng(0)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm.Hmm(norm(draw.random(2)), norm(draw.random((2, 2))), norm(draw.random((2, 5))).T)
    sequences = [draw.integers(0, 5, n) for n in (1, 3, 6, 4)]
    for s, got in zip(sequences, model.log10(sequences)):
        total = 0.0
        for path in np.ndindex(*([2] * len(s))):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert math.isclose(10**got, total, rel_tol=1e-9)


def test_baum_welch_does_not_lose_likelihood(spark):
    draw = np.random.default_rng(1)
    rows = [(i, False, 1, 1, 0.0, 0.0, draw.integers(0, 6, 40).astype(np.uint16).tobytes()) for i in range(40)]
    encoded = spark.createDataFrame(rows, f"doc_id long, {hmm._FACTS}")
    frequencies = np.bincount(np.concatenate([np.frombuffer(r[-1], np.uint16) for r in rows]), minlength=6).astype(float)
    _, progress = hmm.train(encoded, frequencies, states=2, passes=6, train_window=64)
    assert all(b >= a - 0.5 for a, b in zip(progress, progress[1:]))


def test_expected_counts_are_those_of_whole_texts():
    """Windows with context count what one window over each whole text counts, borders included."""
    draw = np.random.default_rng(3)
    frequencies = draw.random(30) + 0.1
    model = hmm.Hmm.first(frequencies / frequencies.sum(), 4)
    model.start = np.array([0.7, 0.1, 0.1, 0.1])
    texts = [draw.integers(0, 30, n).astype(np.uint16) for n in (1, 5, 60, 61, 200, 433, 130)]
    encoded = [pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], names=["symbols"])]
    shared = type("Shared", (), {"value": model})

    def counts(size, context):
        rows = next(iter(hmm._count(shared, size, 30, context=context)(encoded)))
        small = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in rows.column("small")])
        return small, np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in rows.column("emit")]), sum(rows.column("total").to_pylist())

    whole, cut = counts(1000, 0), counts(60, hmm.CONTEXT)
    assert np.isclose(whole[0][:, 1:].sum(), sum(len(t) - 1 for t in texts), rtol=1e-4)  # every transition once
    assert np.isclose(cut[0][:, 1:].sum(), whole[0][:, 1:].sum(), rtol=1e-4)
    for a, b in zip(whole, cut):
        assert np.allclose(a, b, rtol=2e-3, atol=2e-3)


def test_scores_do_not_depend_on_blocks(spark, clashing, tmp_path):
    """Block sizes and partitions leave the results as they are; equal rows spread over blocks; ids may be texts."""
    draw = random.Random(8)
    docs = [(f"d{i}", " ".join(f"w{draw.randint(0, 60)}" for _ in range(draw.randint(0, 80)))) for i in range(150)] + [(None, "same words again " * 20)] * 150 + [("long", "a b c d e f g " * 3000)]
    spark.createDataFrame(docs, "doc_id string, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    held = F.pmod(F.crc32(F.coalesce("doc_id", F.lit("")).cast("binary")), F.lit(7)) == 2

    def scores(block_bytes, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        encoded, totals, frequencies = hmm.encode(frame, held, block_bytes=block_bytes)
        model, _ = hmm.train(encoded, frequencies, states=3, passes=2)
        return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in hmm.score(encoded, model, totals).collect())

    try:
        one, many = scores(1 << 24, 4), scores(2000, 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) == len(docs)
    assert np.allclose([r[3:] for r in one], [r[3:] for r in many], rtol=1e-6)
    from mediaquarry.llm import blocks

    pieces = blocks.deal(frame.filter("doc_id IS NULL"), "text", 2000).collect()
    assert len({r["block"] for r in pieces}) > 10
    # columns with the names used inside do no harm
    assert hmm.language_model(clashing, F.lit(False), states=2, passes=1).count() == len(AWKWARD)


def test_words_of_cut_pieces():
    """A piece cut into chunks has the same words as its texts, letters beyond ASCII and slices included."""
    from mediaquarry.llm import blocks

    texts = ["É aa\x0bBb", "", None, "bb  É\tcc", " Ü", "漢字 x\n" * 50, "plain"] * 9
    piece = pa.table({"id": pa.array(range(len(texts))), "text": pa.array(texts).fill_null("")})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, piece.schema) as stream:
        stream.write_table(piece)
    packed = pa.table({"piece": pa.array([sink.getvalue().to_pybytes()] * 2, pa.binary())})
    for size in (1, 100, 1 << 20):
        words, sizes = [], []
        for part in blocks.chunks(packed, chunk_bytes=size):
            w, n = hmm.tokens_of(hmm._column(part, "text"))
            words += w.to_pylist()
            sizes += n.tolist()
        assert words == [x.decode() for _ in range(2) for t in texts for x in hmm.words_of(t)] and sizes == [len(hmm.words_of(t)) for t in texts] * 2
    for part in (piece.slice(3), piece.slice(1, 5)):
        assert hmm.tokens_of(part.column("text").chunk(0))[0].to_pylist() == [x.decode() for t in part.column("text").to_pylist() for x in hmm.words_of(t)]


def test_bpe_of_a_word_in_all_blocks(spark, clashing, monkeypatch):
    """A word that every block has, and answers in more than one packed row; ids of another type; clashing names."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "ROWS_PACKED", 50)
    docs = [(f"d{i}", f"the hot word the {i} hot" if i % 3 else None) for i in range(300)] + [("same", "the hot word")] * 50
    rows = bpe.encode(spark.createDataFrame(docs, "doc_id string, text string"), block_bytes=200).collect()
    tok = Tokenizer.from_file(bpe.default_path())
    want = sorted((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in docs)
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == want
    assert all(r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert bpe.encode(clashing).count() == len(AWKWARD)


def test_decode_of_odd_ids(spark):
    """Ids outside the vocabulary and nulls decode to nothing; broken UTF-8 is replaced."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    ids = tok.encode("漢字 é", add_special_tokens=False).ids
    rows = [(1, ids), (2, None), (3, []), (4, [ids[0]]), (5, [10**6, -1, None, *ids])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "k int, ids array<int>, decoded int")
    got = {r["k"]: r["decoded"] for r in bpe.decode(frame).collect()}
    assert got == {1: "漢字 é", 2: None, 3: "", 4: tok.decode([ids[0]], skip_special_tokens=False), 5: "漢字 é"}


def test_decontamination_of_equal_rows_in_blocks(spark):
    """Rows that repeat an id and text each have their hits, also where the benchmark is read block by block."""
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, AWKWARD[11][1])] * 3 + [(1, "a b"), (None, None), (2, "")] * 2, SCHEMA)
    found = [sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.report(docs, bench, block_bytes=n).collect()) for n in (1 << 20, 30)]
    assert found[0] == found[1] and len(found[0]) == 9
    cut = [sorted(str(r["text"]) for r in decontaminate.decontaminate(docs, bench, mode="span", block_bytes=n).collect()) for n in (1 << 20, 30)]
    assert cut[0] == cut[1]
    kept = [decontaminate.decontaminate(docs, bench, block_bytes=n).count() for n in (1 << 20, 30)]
    assert kept == [4, 4]


def test_scores_by_brute_force(spark):
    """Scores are the forward recursion over words: each from its symbol's emission and its share of the symbol."""
    draw = random.Random(12)
    docs = [(i, " ".join(f"{'ab'[(i + k // 9) % 2]}{draw.randint(0, 30)}" for k in range(draw.randint(0, 40)))) for i in range(120)] + [(500, None), (501, "once twice twice never-seen"), (502, "Twice")]
    held = F.col("doc_id") % 5 == 0
    encoded, totals, frequencies = hmm.encode(spark.createDataFrame(docs, SCHEMA), held)
    model, _ = hmm.train(encoded, frequencies, states=3, passes=3)
    got = {r["doc_id"]: r["score"] for r in hmm.score(encoded, model, totals).collect()}
    counts: dict = {}
    for i, t in docs:
        for w in hmm.words_of(t) if i % 5 else ():
            counts[w] = counts.get(w, 0) + 1
    symbol = lambda w: zlib.crc32(w) % hmm.BUCKETS + hmm.FIRST
    mass: dict = {}
    for w, c in counts.items():
        if c >= 2:
            mass[symbol(w)] = mass.get(symbol(w), 0) + c
    once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    unseen = once / (once + 2 * twice)
    for i, t in docs:
        alpha, total = model.start, 0.0
        for k, w in enumerate([*hmm.words_of(t), None]):
            c = counts.get(w, 0)
            s, share = (hmm.END, 1.0) if w is None else (symbol(w), c / mass[symbol(w)]) if c >= 2 else (hmm.RARE, (1 - unseen) / once if c and twice else unseen)
            alpha = (alpha @ model.move if k else alpha) * model.emit[s] * share
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert math.isclose(got[i], total, rel_tol=1e-9), i


def test_states_are_not_trusted_where_the_fold_does_not_confirm_them(spark):
    """Words drawn at random teach no states: the kept model is as good as the words' shares; runs of words do teach them."""
    draw = random.Random(3)
    noise = [(i, " ".join(f"n{draw.randint(0, 400)}" for _ in range(20))) for i in range(200)]
    order = [(i, " ".join(f"{'ab'[(i + k // 10) % 2]}{draw.randint(0, 6)}" for k in range(30))) for i in range(200)]
    gains = []
    for docs in (noise, order):
        encoded, totals, frequencies = hmm.encode(spark.createDataFrame(docs, SCHEMA), F.col("doc_id") % 5 == 0)
        model, _ = hmm.train(encoded, frequencies, states=4, passes=6)
        shares = hmm.Hmm(np.ones(1), np.ones((1, 1)), (frequencies / frequencies.sum())[:, None])
        out = encoded.filter("held_out")
        gains.append(np.subtract(*hmm.likelihoods(out, [model, shares])) / out.count())
    assert gains[0] > -0.2 and gains[1] > 2


def test_many_lines_go_in_one_walk(spark):
    """400,000 repeated lines of one text, and of two."""
    lines = "\n".join(f"line {k} of it" for k in range(100_000))
    docs = spark.createDataFrame([(1, lines), (2, lines + "\nown"), (3, "\n".join([lines] * 4))], SCHEMA)
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert left == {1: lines, 2: "own"}
    flags = F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: i % 2 == 0)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400_001)), lambda i: i.cast("string")), "\n")
    kept = spark.range(1).select(line_dedup._kept(text, flags).alias("t")).first()["t"]
    assert kept.split("\n") == [*map(str, range(2, 400_001, 2)), "400001"]


def test_many_words_hit_in_one_walk():
    """400,000 distinct hit words in one text, all of them looked at once."""
    words = [f"blockhead{k}".encode() for k in range(400_000)]
    raw = b" ".join(words)
    found = toxicity.contexts(raw, raw, words)
    assert [w for w, _, _ in found] == words
    raw = b'he said "oaf" and oaf oaf'
    assert [(w, f[0]) for w, f, _ in toxicity.contexts(raw, toxicity._spaced(raw), [b"oaf"])] == [(b"oaf", True), (b"oaf", False), (b"oaf", False)]
