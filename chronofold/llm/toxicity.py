"""Toxicity: a learned lexicon, matched with misspellings, weighed by its context.

Training rows (``labels.toxic`` of documents whose crc32(doc_id) mod 5 is not 0, at most
``TRAIN_ROWS`` of them, those of smallest hash) give the lexicon: whole words, and word stems of 4 to 8
letters, whose presence is tied to the label beyond chance (log-likelihood ratio against the number of
candidates). Near copies of one label count as one text there, which holds the terms of all of them, so
that a much copied text doesn't bring its words. The lexicon is a trie. A word of a text is a Levenshtein automaton of one edit, held as
two bit masks (no edit, one edit); walking trie and automaton together yields every lexicon word
within one edit, and every stem at the word's beginning. Each hit is scored by the window around it:
quotation marks and reporting words beside it speak for quotation and lower it, second-person words
speak for abuse and raise it. A ridge-regularised logistic regression over a document's sums gives
the score. Only the text is an input of it.

Every distinct word of a batch is matched once; texts are read whole. Null and empty texts have no hits
and get the score of such documents. Without any training label, or with one label value only, there is
no lexicon and every score is that of the base rate (0 without labels). Null doc_ids are never trained
on and count as held out if crc32('') is 0 mod 5; labels that repeat a doc_id take the largest
``toxic``; repeated rows get equal scores. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens
from chronofold.llm.jaccard_join import shingle_sets

#: The most labelled rows that the lexicon and the regression are fitted on.
TRAIN_ROWS = 20_000
#: Parts that the training texts are dealt to.
SIGN_PARTS = 32
MOST_TERMS = 512
STEMS = (4, 5, 6, 7, 8)
FUZZY_FROM = 5
WINDOW = 4
#: Words after a hit among which an open quotation must end to count as one, so that a stray mark quotes nothing.
CLOSING = 40
RIDGE = 1.0
#: The least log odds of a term, so that a shared stem of clean and toxic words doesn't count.
LEAST_ODDS = 2.5
#: Near copies among training texts: hashes of a text, those of a bucket, and the share of equal ones that makes a copy.
HASHES, BUCKET, COPY = 36, 3, 0.5
#: Distinct chunks whose matches a task remembers at most.
MEMO_ENTRIES = 200_000
_EDGE = ".,;:!?|()[]{}<>\"'`´«»„“”‘’‚…-–—_/\\*~#=+"
_NONE = (-1, 0)
_QUOTES = "\"«»„“”‘’‚"
# Words that report what another said, and words that address the reader.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term phrase mot terme dit wort sagte palabra dijo".split())
ADDRESS = frozenset("you your you're youre u yourself are du dich ihr tu toi vous te eres usted".split())


@dataclass
class Node:
    """A trie node: where its letters lead, the word or stem that ends here."""

    next: dict[str, "Node"] = field(default_factory=dict)
    word: int = -1
    stem: int = -1


def _shortened(word: str) -> set[str]:
    """The word, and the word without one letter: words within one edit have one of these in common."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


class Lexicon:
    """Terms (text, is_stem, weight) as a trie that words with one edit can be matched against."""

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.terms, self.root = terms, Node()
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.near: set[str] = set()
        self.shortest_stem = min((len(t) for t, stem, _ in terms if stem), default=0)
        self.stem_heads = {t[: self.shortest_stem] for t, stem, _ in terms if stem}
        for k, (text, stem, _) in enumerate(terms):
            node = self.root
            for c in text:
                node = node.next.setdefault(c, Node())
            if stem:
                node.stem = k
            else:
                node.word = k
                if len(text) >= FUZZY_FROM:
                    self.heads.add(text[:2])
                    self.tails.add(text[-2:])
                    self.near |= _shortened(text)

    def exact(self, word: str) -> int:
        """The word itself, or the longest stem that begins it; -1 if there is none."""
        node, found = self.root, -1
        for c in word:
            node = node.next.get(c)
            if node is None:
                return found
            if node.stem >= 0:
                found = node.stem
        return node.word if node.word >= 0 else found

    def within_one_edit(self, word: str) -> int:
        """A lexicon word of FUZZY_FROM letters or more at distance one, the first by place; -1 if there is none.

        Bit i of a mask stands for i letters of ``word`` read. On a lexicon letter c, the mask without
        an edit moves where the word has c; the mask with one edit moves likewise, or is entered by
        an added letter (stay), a changed one (move by one) or a left-out one (move without a letter).
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (1 << i)
        goal, best = 1 << len(word), -1
        # Before any letter: nothing read, or one letter of the word left out.
        stack = [(self.root, 1, 2)]
        while stack:
            node, zero, one = stack.pop()
            if node.word >= 0 and (zero | one) & goal and len(self.terms[node.word][0]) >= FUZZY_FROM and (best < 0 or node.word < best):
                best = node.word
            for c, child in node.next.items():
                at = masks.get(c, 0)
                zero2 = (zero & at) << 1
                one2 = ((one & at) << 1) | zero | (zero << 1) | (zero2 << 1)
                one2 &= (goal << 1) - 1
                if zero2 or one2:
                    stack.append((child, zero2, one2))
        return best

    def match(self, chunk: str) -> tuple[int, int]:
        """Term and edits (0 or 1) of a white-space separated chunk in lower case; (-1, 0) if there is none."""
        word = chunk.strip(_EDGE)
        if word[: self.shortest_stem] in self.stem_heads or word[:2] in self.heads:
            found = self.exact(word)
            if found >= 0:
                return found, 0
        # One edit leaves the first two letters or the last two as they are.
        if len(word) >= FUZZY_FROM - 1 and (word[:2] in self.heads or word[-2:] in self.tails) and not self.near.isdisjoint(_shortened(word)):
            found = self.within_one_edit(word)
            if found >= 0:
                return found, 1
        found = self.exact(word) if word else -1
        return (found, 0) if found >= 0 else _NONE


#: Sums over a document's hits; all but ``quoted`` are of hits weighed by their context.
FEATURES = ["hits", "fuzzy", "weight", "quoted", "density"]
QUOTED, ADDRESSED = 0.1, 1.5


def _context(words: list[str], at: int, quotes_before: int) -> tuple[bool, bool]:
    """Whether the hit at a place is quoted, and whether it addresses the reader."""
    chunk = words[at]
    near = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
    plain = {w.strip(_EDGE) for w in near}
    marked = (chunk[:1] in _QUOTES and chunk.rstrip(".,;:!?")[-1:] in _QUOTES) or (quotes_before % 2 == 1 and any(q in w for w in words[at : at + CLOSING] for q in _QUOTES))
    return marked or bool(plain & REPORTING), bool(plain & ADDRESS)


def features(texts: pa.Array, lexicon: Lexicon, memo: dict[str, tuple[int, int]]) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(texts) or not lexicon.terms:
        return out
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    hit = np.zeros(len(coded.dictionary), bool)
    found: dict[str, tuple[int, int]] = {}
    for k, chunk in enumerate(coded.dictionary.to_pylist()):
        m = memo.get(chunk)
        if m is None:
            m = lexicon.match(chunk)
            if len(memo) < MEMO_ENTRIES:
                memo[chunk] = m
        if m[0] >= 0:
            hit[k] = True
            found[chunk] = m
    places = np.flatnonzero(hit[coded.indices.to_numpy(zero_copy_only=False)])
    docs = np.searchsorted(bounds, places, side="right") - 1
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)])) if len(docs) else np.zeros(1, np.int64)
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        doc = int(docs[first])
        words = lists[doc].as_py()
        quotes, count = [], 0
        for w in words:
            quotes.append(count)
            count += sum(w.count(q) for q in _QUOTES) if not w.isalnum() else 0
        row = out[doc]
        for at in (places[first:end] - bounds[doc]).tolist():
            term, edits = found[words[at]]
            quoted, addressed = _context(words, at, quotes[at])
            factor = QUOTED if quoted else ADDRESSED if addressed else 1.0
            weight = factor * lexicon.terms[term][2] * (0.5 if edits else 1.0)
            row += (factor, factor * edits, weight, quoted, 0)
        row[4] = 100 * row[2] / max(50, len(words))
    out[:] = np.log1p(out)
    return out


def term_counts(texts: pa.Array, among: frozenset | None = None) -> Counter:
    """In how many texts each word and stem occurs: (term, is_stem) -> number."""
    counts: Counter = Counter()
    for text in texts.to_pylist():
        words = {w for c in (text or "").lower().split() if (w := c.strip(_EDGE)) and w.isalpha()}
        found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}
        counts.update(found if among is None else found & among)
    return counts


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minima of a shingle set; the share of equal ones estimates how alike two sets are."""
    if not len(shingles):
        return bytes(8 * HASHES)
    odd = np.random.default_rng(7).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.array([(shingles * a).min() for a in odd]).astype("<u8").tobytes()


def near_copies(rows: list[tuple[int, int, bytes]]) -> dict[int, int]:
    """Row -> group, for the rows (row, label, signature) that are near copies of a first one with the same label, and those first ones."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    signs = np.frombuffer(b"".join(r[2] for r in rows), "<u8").reshape(-1, HASHES)
    buckets: dict[tuple, list[int]] = {}
    group: dict[int, int] = {}
    for k, (row, label, sign) in enumerate(rows):
        keys = [(label, at, sign[at : at + 8 * BUCKET]) for at in range(0, 8 * HASHES, 8 * BUCKET)]
        firsts = sorted({f for key in keys for f in buckets.get(key, ())})
        alike = (signs[firsts] == signs[k]).mean(1) if firsts else np.zeros(1)
        if alike.max() >= COPY:
            first = rows[firsts[int(alike.argmax())]][0]
            group[row] = group[first] = first
        else:
            for key in keys:
                buckets.setdefault(key, []).append(k)
    return group


def choose_terms(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int, candidates: int, most: int = MOST_TERMS) -> list[tuple[str, bool, float]]:
    """Terms (text, is_stem, weight) out of (text, is_stem, toxic texts, clean texts): at most ``most``, and the words below stems."""
    scored, whole = [], []
    total = n_toxic + n_clean
    for text, stem, a, b in rows:
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        if odds < LEAST_ODDS:
            continue
        if not stem and len(text) >= FUZZY_FROM:
            whole.append(text)
        cells = [(a, (a + b) * n_toxic / total), (b, (a + b) * n_clean / total), (n_toxic - a, (total - a - b) * n_toxic / total), (n_clean - b, (total - a - b) * n_clean / total)]
        ratio = 2 * sum(o * np.log(o / e) for o, e in cells if o > 0 and e > 0)
        if ratio > 2 * np.log(max(2, candidates)):
            scored.append((ratio, text, stem, min(5.0, float(odds)), a))
    # Strongest first; among equals the whole word, then the shorter text.
    scored.sort(key=lambda x: (-round(x[0], 6), x[2], len(x[1]), x[1]))
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    words: list[str] = []
    for _, text, stem, odds, _ in scored:
        if any(text[:n] in stems for n in STEMS if n <= len(text)):
            continue
        if stem and any(w.startswith(text) for w in words):
            continue
        chosen.append((text, stem, odds))
        (stems.add if stem else words.append)(text)
        if len(chosen) == most:
            break
    # Observed words below a stem are kept with its weight, so that their misspellings are sought too.
    weight = {text: odds for text, stem, odds in chosen if stem}
    below = [(text, max((n for n in STEMS if text[:n] in weight), default=0)) for text in sorted(whole)]
    return chosen + [(text, False, weight[text[:n]]) for text, n in below if n]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and bias (last) of a ridge-regularised logistic regression, by Newton's method."""
    rows = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(rows.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - y) + penalty * w
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the doc_id as text is 0 mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon and regression on at most ``train_rows`` labelled documents that aren't held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # ``train_rows`` bounds this side of the join, and what reaches the driver.
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(s) for s in shingle_sets(batch.column("text"), 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.binary())], ["text", "toxic", "sign"])

    # A doc_id may have any number of rows: equal ones are one text, and the bound holds for texts as well. Which they
    # are is settled by hashes; then each task keeps one row of a text before any text is shuffled.
    hashed = narrow.withColumn("h", F.xxhash64("text"))
    keys = hashed.select("doc_id", "h").join(F.broadcast(sample), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(train_rows)
    keys, keys_path = storage.materialise(keys, "toxicity-keys")
    texts = hashed.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    signed = texts.select("text", "toxic").repartition(SIGN_PARTS).mapInArrow(sign, "text string, toxic int, sign binary")
    rows, path = storage.materialise(signed.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    known_rows = [(r.row, int(r.toxic > 0), bytes(r.sign)) for r in rows.select("row", "toxic", "sign").collect()]
    group = near_copies(known_rows)
    n_toxic, n_clean = (len({group.get(r, r) for r, label, _ in known_rows if label == want}) for want in (1, 0))
    if not n_toxic or not n_clean:
        base = n_toxic / max(1, n_toxic + n_clean)
        return Model([], np.array([0.0] * len(FEATURES) + [30.0 * (2 * base - 1)]))

    def counts(label: int, among: frozenset | None) -> DataFrame:
        """Texts of one label that hold each term (only of ``among``, if given)."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                members: dict[int, list[int]] = {}
                for k, r in enumerate(batch.column("row").to_pylist()):
                    members.setdefault(group.get(r, -1), []).append(k)
                for g, at in members.items():
                    some = batch.column("text").take(pa.array(at))
                    total.update({(*k, g): n for k, n in term_counts(some, among).items()})
            keys = list(total)
            tokens.release_memory()
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "stem", "copies", "n"])

        some = rows.where((F.col("toxic") > 0) == bool(label)).select("text", "row")
        found = some.mapInArrow(count, "term string, stem boolean, copies long, n long").groupBy("term", "stem", "copies").agg(F.sum("n").alias("n"))
        # A group of copies is one text.
        return found.groupBy("term", "stem").agg(F.sum(F.when(F.col("copies") < 0, F.col("n")).otherwise(1)).alias("n"))

    # Candidates are the terms of toxic texts, the fewer ones; clean texts are searched only for those that pass if no clean text has them.
    usual, usual_path = storage.materialise(counts(1, None).where("n >= 3"), "toxicity-terms")
    candidates = usual.count()
    n, total = F.col("n"), n_toxic + n_clean
    rest, other = F.lit(n_toxic) - n, F.lit(total) - n
    most = 2 * (n * float(np.log(total / n_toxic)) + F.when(rest > 0, rest * F.log(rest * total / (other * n_toxic))).otherwise(0) + n_clean * F.log(F.lit(total) / other))
    likely = {(r.term, r.stem): r.n for r in usual.where(most > float(2 * np.log(max(2, candidates)))).select("term", "stem", "n").collect()}
    clean = {(r.term, r.stem): r.n for r in counts(0, frozenset(likely)).collect()}
    terms = choose_terms([(*key, a, clean.get(key, 0)) for key, a in likely.items()], n_toxic, n_clean, candidates)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, memo = Lexicon(terms), {}
        for batch in batches:
            x = features(batch.column("text"), lexicon, memo)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in x.T)], ["toxic", *FEATURES])

    fitted = rows.mapInArrow(describe, ", ".join(["toxic int", *(f"{f} double" for f in FEATURES)])).groupBy("toxic", *FEATURES).count().orderBy("toxic", *FEATURES).toPandas()
    x = np.repeat(fitted[FEATURES].to_numpy(), fitted["count"], axis=0)
    y = np.repeat((fitted["toxic"].to_numpy() > 0).astype(float), fitted["count"])
    storage.remove(docs.sparkSession, path)
    storage.remove(docs.sparkSession, usual_path)
    storage.remove(docs.sparkSession, keys_path)
    return Model(terms, fit_logistic(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, memo = Lexicon(model.terms), {}
        for batch in batches:
            for part in tokens.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(part.column("text"), lexicon, memo)))], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = narrow.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text isn't predicted toxic."""

    def is_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, memo = Lexicon(model.terms), {}
        for batch in batches:
            for part in tokens.slices(batch):
                yield part.filter(pa.array(model.score(features(part.column("text"), lexicon, memo)) < 0.5))

    return docs.mapInArrow(is_clean, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
