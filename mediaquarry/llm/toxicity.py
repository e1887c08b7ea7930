"""Toxicity: a learned lexicon in a trie, Levenshtein automata over it, and context windows around each hit.

Lexicon: whole words and word stems whose share of toxic documents cannot be chance (a binomial bound, corrected for the
number of candidates), in rounds until what is left of the toxic documents has no such term.  What stands in quotation
marks is no evidence for a term or against it, so that a term of abuse which others only quote is still learnt.  Matching:
the product of the trie with the terms' Levenshtein automata (two swapped neighbours are one edit), made deterministic as
texts need it; a word is read once, letter by letter, and most words leave the automaton after a few.  How much an exact or
inexact hit of a term says is learnt too.

Context: the window of eight words to either side of a hit gives it features: is it in quotation marks, is a word of
reporting or of addressing someone near them, and the words themselves, hashed to ``WORD_BUCKETS``.  A logistic regression
on the labelled documents, with the term's own weight as its offset, learns what they say.  The prior's means, which hold
where the labels tell nothing, take quotation for no abuse.  A document's score is its strongest hit's.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of, fresh, table, written
from .decontaminate import FOLD, words_of

FIT_ROWS = 12_000  # the bound of the labelled sample
STEMS = range(4, 9)
WINDOW = 8
WORD_BUCKETS, RIDGE = 512, 4.0
# Marks that quote, and words that report speech or address someone.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
REPORTS = frozenset("said says say called calls quote quoted quotes wrote word term phrase slur sagte nannte wort zitat begriff schrieb dit disait mot terme appelé écrit dijo llamó palabra término escribió".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr euch sie tu te toi vous votre ton ta usted tú eres vosotros ustedes".split())
FLAGS = ("quoted", "quoted and reported", "quoted and addressed")
PRIOR = (-5.0, -1.0, 4.0)  # log-odds of the flags before any label is seen; of every window word: none


def edits_of(text: str, stem: bool) -> int:
    """How many edits a term tolerates, by its letters: stems one from seven, words one from five and two from nine."""
    return int(len(text) >= 7) if stem else (len(text) >= 5) + (len(text) >= 9)


class FuzzyTrie:
    """Lazily determinised product of a lexicon trie and the Levenshtein automata of its terms.

    A state is a set of (trie node, edits, awaited letter).  ``terms``: (text, is_stem).  A stem accepts every word that goes
    on after it.
    """

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.terms = sorted(terms)
        self.most = [edits_of(*t) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # edits that some term at or below the node allows
        for number, (text, _) in enumerate(self.terms):
            most, at = self.most[number], 0
            self.reach[0] = max(self.reach[0], most)
            for c in text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], most)
            self.ends[at].append(number)
        self._forget()
        self.memo: dict[bytes, tuple[tuple[int, int], ...]] = {}

    def _forget(self) -> None:
        """Only the start is left of the deterministic automaton: its states, their numbers, and the moves known so far."""
        self.states = [self._closed([(0, 0, "")])]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, int]] = [{}]

    def _after(self, state: int, letter: str) -> int:
        """The number of the state after a letter, made if it is new; -1 if no term can follow."""
        found = self._move(self.states[state], letter)
        if not found:
            return self.moves[state].setdefault(letter, -1)
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
            self.moves.append({})
        return self.moves[state].setdefault(letter, self.number[found])

    def _closed(self, states: Iterable[tuple[int, int, str]]) -> frozenset:
        """With the trie's letters that the word leaves out; a negative node -1 - n is the accepted stem n."""
        found = set(states)
        todo = list(found)
        while todo:
            node, edits, awaited = todo.pop()
            if node < 0 or awaited:
                continue
            for number in self.ends[node]:
                if self.terms[number][1] and edits <= self.most[number]:
                    found.add((-1 - number, edits, ""))
            for child in self.children[node].values():
                if edits < self.reach[child] and not any((child, e, "") in found for e in range(edits + 2)):
                    found.add((child, edits + 1, ""))
                    todo.append((child, edits + 1, ""))
        return frozenset(s for s in found if s[2] or not any((s[0], e, "") in found for e in range(s[1])))

    def _move(self, state: frozenset, letter: str) -> frozenset:
        out: set = set()
        for node, edits, awaited in state:
            if node < 0:
                out.add((node, edits, ""))
            elif awaited:
                if letter == awaited:  # the second of two swapped letters
                    out.add((node, edits, ""))
            else:
                for c, child in self.children[node].items():
                    if edits + (c != letter) <= self.reach[child]:
                        out.add((child, edits + (c != letter), ""))
                    if edits < self.reach[child] and c != letter and letter in self.children[child]:
                        after = self.children[child][letter]
                        if edits < self.reach[after]:
                            out.add((after, edits + 1, c))
                if edits < self.reach[node]:
                    out.add((node, edits + 1, ""))
        return self._closed(out)

    def look_up(self, word: bytes) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms that a word is within reach of, the nearest first."""
        known = self.memo.get(word)
        if known is not None:
            return known
        if len(self.states) > 200_000:
            self._forget()
        state, moves = 0, self.moves
        for letter in word.decode("utf-8", "replace").lower():
            after = moves[state].get(letter)
            state = self._after(state, letter) if after is None else after
            if state < 0:
                break
        found: dict[int, int] = {}
        for node, edits, awaited in self.states[state] if state >= 0 else ():
            numbers = () if awaited else [-1 - node] if node < 0 else [n for n in self.ends[node] if edits <= self.most[n]]
            for n in numbers:
                found[n] = min(edits, found.get(n, 9))
        out = tuple(sorted(found.items(), key=lambda p: (p[1], p[0])))
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])


class Model:
    """A lexicon with the precision of its hits by term and edits, the contexts' weights, and the rate of toxic documents
    without a hit."""

    def __init__(self, terms: list[tuple[str, bool]], exact: dict, inexact: dict, rate: float, flags: Iterable[float] = PRIOR, words: Iterable[float] = ()):
        self.trie, self.rate, self.flags = FuzzyTrie(terms), rate, tuple(flags)
        self.words = np.zeros(WORD_BUCKETS) + (np.asarray(list(words)) if len(list(words)) else 0.0)
        self.weight = [(exact.get(t, 0.9), inexact.get((t, 1), 0.6), inexact.get((t, 2), 0.5)) for t in self.trie.terms]

    def hits(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, int]]:
        """The words that some term is within reach of, with the term that weighs most and its edits."""
        look, memo = self.trie.look_up, self.trie.memo
        out = {}
        for w in set(words):
            found = memo.get(w)
            if found is None:
                found = look(w)
            if found:
                out[w] = max(found, key=lambda p: (self.weight[p[0]][p[1]], -p[0]))
        return out

    def in_context(self, weight: float, flags: tuple[bool, bool, bool], near: Iterable[int]) -> float:
        """A hit's weight after its window had its say."""
        said = sum(w for w, on in zip(self.flags, flags) if on) + float(np.clip(sum(self.words[k] for k in near), -3, 3))
        return 1 / (1 + math.exp(-(_logit(weight) + said)))

    def score(self, text: str | None) -> float:
        raw = (text or "").encode()
        spaced = _spaced(raw)
        weights = {w: self.weight[n][e] for w, (n, e) in self.hits(spaced.split()).items()}
        if not weights:
            return self.rate
        values = sorted((self.in_context(weights[w], flags, near) for w, flags, near in contexts(raw, spaced, weights)), reverse=True)
        top = max(values[0], self.rate)
        return min(1.0, top + (1 - top) * 0.05 * (1 - 1 / len(values)))


SUREST = 0.98  # no term is surer than that, so that a context can outweigh it


def _logit(p: float) -> float:
    p = min(max(p, 1 - SUREST), SUREST)
    return math.log(p / (1 - p))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_BUCKETS


_MARKS = sorted({m.encode() for pair in QUOTES.items() for m in pair if ord(m) > 127})
_RUN = re.compile(rb"[^ \t\n\r\f\v]+")
_TAIL = 4  # bytes after a window's last word, where a closing mark may stand


def _spaced(raw: bytes) -> bytes:
    """The text with A-Z in lower case and a space for each byte that is of no word; places stay as they are."""
    out = raw.translate(FOLD)
    for mark in _MARKS:
        if mark in out:
            out = out.replace(mark, b" " * len(mark))
    return out


def _marked(raw: bytes, before: list[tuple[int, int]], start: int, end: int, after: list[tuple[int, int]]) -> bool:
    """Whether the window has an opening mark before the place and its closing mark after."""
    left = raw[before[0][0] if len(before) == WINDOW else 0 : start]
    return _quoted(left.decode("utf-8", "ignore"), raw[end : (after[-1][1] if after else end) + _TAIL].decode("utf-8", "ignore"))


def contexts(raw: bytes, spaced: bytes, wanted: Iterable[bytes]) -> list[tuple[bytes, tuple[bool, bool, bool], set[int]]]:
    """Each occurrence of the wanted words: the word, its flags, and the buckets of the words in its window.

    The text's words are walked once, however many are wanted.
    """
    wanted, out = frozenset(wanted), []
    blank = np.frombuffer(b" " + spaced + b" ", np.uint8) == 32
    starts, ends = (np.flatnonzero(x).tolist() for x in (blank[:-1] & ~blank[1:], ~blank[:-1] & blank[1:]))
    for i, (start, end) in enumerate(zip(starts, ends)):
        word = spaced[start:end]
        if word not in wanted:
            continue
        low = max(0, i - WINDOW)
        before, after = list(zip(starts[low:i], ends[low:i])), list(zip(starts[i + 1 : i + 1 + WINDOW], ends[i + 1 : i + 1 + WINDOW]))
        near = {spaced[a:b].decode("utf-8", "replace").lower() for a, b in before + after}
        quoted = _marked(raw, before, start, end, after)
        out.append((word, (quoted, quoted and bool(near & REPORTS), quoted and bool(near & ADDRESS) and not near & REPORTS), {_bucket(w) for w in near}))
    return out


def _quoted(before: str, after: str) -> bool:
    """An opening mark before that isn't closed, and its closing mark after."""
    for left, right in QUOTES.items():
        if right in after:
            if left == right and before.count(left) % 2:
                return True
            if left != right and before.rfind(left) > before.rfind(right):
                return True
    return False


def _candidates(batches):
    """Per batch: each candidate term with the toxic and clean documents that have it."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for term in _terms_of(text.as_py()):
                counts.setdefault(term, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c for c, _ in counts.values()], pa.int64()), pa.array([t for _, t in counts.values()], pa.int64())], names=["term", "clean", "toxic"])


_ANY_MARK = re.compile("|".join(map(re.escape, sorted({m for pair in QUOTES.items() for m in pair}))).encode())


def _quoted_only(raw: bytes, spaced: bytes) -> set[bytes]:
    """The words that occur in quotation marks and nowhere else."""
    marks = np.array([m.start() for m in _ANY_MARK.finditer(raw)], np.int64)
    if len(marks) < 2:
        return set()
    spans = np.array([m.span() for m in _RUN.finditer(spaced)], np.int64).reshape(-1, 2)
    starts, ends = spans.T
    low = np.concatenate((np.zeros(min(WINDOW, len(spans)), np.int64), starts[:-WINDOW] if len(spans) > WINDOW else []))[: len(spans)].astype(np.int64)
    high = np.append(ends[WINDOW:], np.full(min(WINDOW, len(spans)), ends[-1] if len(spans) else 0)) + _TAIL
    # only words with a mark on either side in their window can be quoted
    between = (np.searchsorted(marks, starts) > np.searchsorted(marks, low)) & (np.searchsorted(marks, high) > np.searchsorted(marks, ends))
    where = spans.tolist()
    quoted = {i for i in np.flatnonzero(between).tolist() if _marked(raw, where[max(0, i - WINDOW) : i], *where[i], where[i + 1 : i + 1 + WINDOW])}
    plain = {spaced[a:b] for i, (a, b) in enumerate(where) if i not in quoted} if quoted else set()
    return {spaced[where[i][0] : where[i][1]] for i in quoted} - plain


def _terms_of(text: str | None) -> set[str]:
    """Whole words (ending in a blank) and stems, of the words that stand outside quotation marks at least once."""
    raw = (text or "").encode()
    spaced = _spaced(raw)
    plain = set(spaced.split()) - (_quoted_only(raw, spaced) if text else set())
    out = set()
    for word in plain:
        low = word.decode("utf-8", "replace").lower()
        out.add(low + " ")
        out.update(low[:n] for n in STEMS if n < len(low))
    return out


def _present(wanted):
    def run(batches):
        terms = wanted.value
        for batch in batches:
            found = [sorted(_terms_of(t.as_py()) & terms) for t in batch.column("text")]
            marks = [_marks(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))], names=["toxic", "terms", "marks"])

    return run


def _marks(text: str | None, rows: int = 12) -> list[int]:
    """MinHash values of a text's three-word shingles."""
    words = words_of(text)
    hashes = [zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))] if words else [0]
    grid = np.unique(np.array(hashes, np.uint64))
    odd = np.array([2 * zlib.crc32(b"mark %d" % k) + 1 for k in range(rows)], np.uint64)
    return [int(((grid * m) & np.uint64(0xFFFFFFFF)).min()) + (k << 32) for k, m in enumerate(odd)]


def _copies(marks: list[list[int]], agree: int = 10, groups: int = 3) -> list[int]:
    """A number for each text that its copies share: texts of which ten of twelve MinHash values are the same.

    Two values that differ leave one of three groups of four as it is, so that copies meet in a bucket.
    """
    distinct: dict[tuple[int, ...], int] = {}
    own = [distinct.setdefault(tuple(m), len(distinct)) for m in marks]
    grid = np.array(list(distinct), np.int64)
    root = list(range(len(distinct)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    buckets: dict[tuple[int, ...], list[int]] = {}
    for m, i in distinct.items():
        for k in range(groups):
            buckets.setdefault(m[k * len(m) // groups : (k + 1) * len(m) // groups], []).append(i)
    for rows in buckets.values():
        for k in range(len(rows) - 1):
            others = np.array(rows[k + 1 :])
            for j in others[(grid[others] == grid[rows[k]]).sum(1) >= agree].tolist():
                root[find(j)] = find(rows[k])
    return [find(i) for i in own]


def _chance(toxic: int, clean: int, rate: float, tried: int) -> float:
    """Log of the bound on how often so pure a term comes by chance among so many candidates."""
    n = toxic + clean
    return math.lgamma(n + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1) + toxic * math.log(rate) + math.log(max(1, tried))


def choose_terms(rows: list[tuple[int, list[str], int]], tried: int) -> dict[str, tuple[int, int]]:
    """The terms that are pure beyond chance, with the (toxic, clean) rows that have them.

    A row: label, terms, and the number that copies share; copies count once, as what they have in common is no evidence.
    Rounds: the toxic rows that no term explains yet are rarer, so that less is needed to stand out among them.
    """
    toxic: dict[str, set[int]] = {}
    pure: dict[str, set[int]] = {}
    for label, terms, i in rows:
        for t in terms:
            (toxic if label else pure).setdefault(t, set()).add(i)
    clean = {t: len(d) for t, d in pure.items()}
    left, n_clean = {i for label, _, i in rows if label}, len({i for label, _, i in rows if not label})
    found: set[str] = set()
    while left:
        rate = len(left) / (len(left) + n_clean)
        new = {t for t, d in toxic.items() if t not in found and len(d & left) > 2 and _chance(len(d & left), clean.get(t, 0), rate, tried) <= math.log(0.1)}
        if not new:
            break
        found |= new
        left -= set().union(*(toxic[t] for t in new))
    return {t: (len(toxic[t]), clean.get(t, 0)) for t in _plainest(found, toxic)}


def _plainest(found: set[str], toxic: dict[str, set[int]]) -> set[str]:
    """Whole words; and stems that several words share, the longest of equal ones, without those below a kept stem."""
    words = {t for t in found if t.endswith(" ")}
    kept: set[str] = set()
    for stem in sorted((t for t in found if not t.endswith(" ")), key=lambda t: (len(t), t)):
        n = len(toxic[stem])
        longer = [t for t in found if t != stem and t.startswith(stem)]
        if any(len(toxic[t]) >= 0.9 * n for t in longer) or any(stem.startswith(k) for k in kept):
            continue
        kept.add(stem)
    return kept | {w for w in words if not any(w.startswith(k) for k in kept)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most ``fit_rows`` labelled documents, in the order of a hash of their ids.

    Labels: (doc_id, toxic); rows with a null in either are left out, repeated ones count once (toxic if any says so).
    Without toxic or clean labels the lexicon is empty.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows))  # at most fit_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = written(rows.join(sample, "id").select("text", "toxic"), "labelled")
    shares = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_toxic, n_clean = shares.get(1, 0), shares.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], {}, {}, min(0.49, n_toxic / max(1, n_toxic + n_clean)))
    rate = n_toxic / (n_toxic + n_clean)
    counts = written(chosen.mapInArrow(_candidates, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("clean + toxic > 2"), "terms")
    tried = counts.count()
    pure = [r["term"] for r in counts.filter("toxic > 2 AND clean <= 0.1 * toxic").select("term").collect()]  # of a bounded sample
    wanted = spark.sparkContext.broadcast(frozenset(pure))
    seen = chosen.mapInArrow(_present(wanted), "toxic int, terms array<string>, marks array<long>").collect()
    picked = choose_terms([(r["toxic"], r["terms"], i) for r, i in zip(seen, _copies([r["marks"] for r in seen]))], tried)
    exact = {_term(t): (a + 1) / (a + c + 1.05) for t, (a, c) in picked.items()}
    first = Model(list(exact), exact, {}, rate)
    found = chosen.mapInArrow(_inexact(spark.sparkContext.broadcast(first)), "toxic int, terms array<int>, edits array<int>, exact boolean").collect()
    tallies: dict[tuple[int, int], list[int]] = {}
    for r in found:
        for n, e in zip(r["terms"], r["edits"]) if not r["exact"] else ():
            tallies.setdefault((n, e), [0, 0])[r["toxic"]] += 1
    inexact = {(first.trie.terms[n], e): (t + 1.2) / (t + c + 2) for (n, e), (c, t) in tallies.items()}
    bare = [r["toxic"] for r in found if not r["exact"] and not r["terms"]]
    rate = min(0.49, (sum(bare) + 0.05) / (len(bare) + 1))
    plain = Model(list(exact), exact, inexact, rate)
    seen = chosen.mapInArrow(_surroundings(spark.sparkContext.broadcast(plain)), "toxic int, weight double, flags array<double>, buckets array<int>, shares array<double>").collect()
    flags, words = learn_contexts([(r["toxic"], r["weight"], r["flags"], dict(zip(r["buckets"], r["shares"]))) for r in seen])
    return Model(list(exact), exact, inexact, rate, flags, words)


def _term(t: str) -> tuple[str, bool]:
    return (t[:-1], False) if t.endswith(" ") else (t, True)


def _inexact(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            terms, edits, exact = [], [], []
            for text in batch.column("text"):
                hits = set(model.hits(_spaced((text.as_py() or "").encode()).split()).values())
                exact.append(any(e == 0 for _, e in hits))
                near = sorted((n, e) for n, e in hits if e)
                terms.append([n for n, _ in near])
                edits.append([e for _, e in near])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(terms, ints), pa.array(edits, ints), pa.array(exact)], names=["toxic", "terms", "edits", "exact"])

    return run


def _surroundings(shared):
    """Per document with a hit: the weight of its strongest term, and the mean features of that term's windows."""

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                spaced = _spaced(raw)
                hits = {w: model.weight[n][e] for w, (n, e) in model.hits(spaced.split()).items()}
                top = max(hits.values(), default=0.0)
                found = contexts(raw, spaced, [w for w, x in hits.items() if x == top])
                if found:
                    shares: dict[int, float] = {}
                    for _, _, near in found:
                        for k in near:
                            shares[k] = shares.get(k, 0.0) + 1 / len(found)
                    rows.append((toxic, top, [float(np.mean([f[k] for _, f, _ in found])) for k in range(len(FLAGS))], list(shares), list(shares.values())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["toxic", "weight", "flags", "buckets", "shares"])

    return run


def learn_contexts(rows: list[tuple[int, float, list[float], dict[int, float]]], ridge: float = RIDGE, rounds: int = 12) -> tuple[list[float], list[float]]:
    """Weights of the flags and of the window words: a ridge regression of the labels around PRIOR, by Newton's method.

    A row: label, the hit's own weight (the offset), its flags and its window words, as means over a document's windows.
    """
    prior = np.concatenate([PRIOR, np.zeros(WORD_BUCKETS)])
    x, y, offset = np.zeros((len(rows), len(prior)), np.float32), np.zeros(len(rows)), np.zeros(len(rows))
    for i, (label, weight, flags, words) in enumerate(rows):
        x[i, : len(FLAGS)], y[i], offset[i] = flags, label, _logit(weight)
        for k, share in words.items():
            x[i, len(FLAGS) + k] = share
    pull = np.concatenate([np.full(len(FLAGS), 0.5), np.full(WORD_BUCKETS, ridge)])  # flags are few and learn sooner
    w = prior.copy()
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
        w += np.clip(step, -2, 2)
    return w[: len(FLAGS)].tolist(), w[len(FLAGS) :].tolist()


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1.  Null and empty texts get the rate of documents without a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.append_column(out, pa.array([shared.value.score(t.as_py()) for t in batch.column(text_col)], pa.float64()))

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("double")).schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: crc32(doc_id as text) mod 5 is not 0."""
    return labels.filter(~held_out()).select("doc_id", "toxic")


def held_out() -> Column:
    return F.pmod(crc32_of("doc_id"), F.lit(5)) == 0


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    name = fresh(docs.columns, "toxicity")
    kept = scored(docs, fit(docs, training_labels(labels)), out=name).filter(F.col(name) < threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model fitted to the labelled ones that are not held out; empty and null texts get the score of a text without a hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
