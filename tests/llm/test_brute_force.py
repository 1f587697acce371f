"""Operators without SQL against plain Python over the whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pagegrain.llm import mixing, queries
from pagegrain.llm.common import kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def similar(sets, least=0.8):
    by_gram, shared = defaultdict(list), Counter()
    for i, grams in enumerate(sets):
        for gram in grams:
            by_gram[gram].append(i)
    for group in by_gram.values():
        for at, a in enumerate(group):
            shared.update((a, b) for b in group[at + 1 :])
    return [(a, b) for (a, b), k in shared.items() if k >= least * (len(sets[a]) + len(sets[b]) - k)]


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_base_rules(spark, sf_dir, duck):
    got = {row["doc_id"]: row for row in queries.op1_quality_rules(spark, sf_dir).collect()}
    for doc_id, text in texts(duck):
        words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {i + k for i, window in enumerate(windows) if count[window] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        row = got[doc_id]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)
        assert not (row["kept"] and failed)


def test_quality_verdict_follows_the_labels(spark, sf_dir, duck):
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = [row for row in queries.op1_quality_rules(spark, sf_dir).collect() if row["doc_id"] in labels and not row["base_failed"]]
    assert sum(row["kept"] == bool(labels[row["doc_id"]]) for row in rows) >= 0.95 * len(rows)


def grams(text):
    words = [word.lower() for word in WORD.findall(text)]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def test_near_duplicates_and_link_counts(spark, sf_dir, duck):
    rows = texts(duck)
    sets, ids = [grams(text) for _, text in rows], [doc_id for doc_id, _ in rows]
    tied, links = Sets(len(rows)), defaultdict(set)
    for a, b in similar(sets):
        tied.tie(a, b)
        if sets[a] != sets[b]:
            links[a].add(sets[b])
            links[b].add(sets[a])
    got = {row["doc_id"]: row for row in queries.op2_ngram_join(spark, sf_dir).collect()}
    for i, doc_id in enumerate(ids):
        assert (got[doc_id]["class_id"], got[doc_id]["n_links"]) == (ids[tied.root(i)], len(links[i]))


def test_lines(spark, sf_dir, duck):
    places = defaultdict(list)
    for doc_id, text in texts(duck):
        for at, line in enumerate(text.split("\n")):
            if line.strip():
                places[line].append((doc_id, at))
    lines = list(places)
    plain = [re.sub(r"\s+", " ", line).strip() for line in lines]
    tied = Sets(len(lines))
    for a, b in similar([{line[i : i + 5] for i in range(len(line) - 4)} or {line} for line in plain]):
        tied.tie(a, b)
    classes = defaultdict(list)
    for i, line in enumerate(lines):
        classes[tied.root(i)] += places[line]
    want = {place for group in classes.values() for place in sorted(group)[1:]}
    got = {(row["doc_id"], at) for row in queries.op5_line_dedup(spark, sf_dir).collect() for at in row["dropped"]}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_unigram_base(spark, sf_dir, duck):
    held, count = {}, Counter()
    for doc_id, text in texts(duck):
        tokens = [*WORD.findall(text.translate(LOWER)), None]
        held[doc_id] = tokens
        if zlib.crc32(str(doc_id).encode()) % 10:
            count.update(tokens)
    whole, spread = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    got = queries.op4_language_model(spark, sf_dir).collect()
    for row in got:
        tokens = held[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens), sum(count[t] > 0 for t in tokens), whole)
        assert math.isclose(row["base_score"], sum(math.log10((count[t] + 0.1) / spread) for t in tokens), rel_tol=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    # A corpus of some size is needed: the base gives all words that it lacks one small share, which few texts make a large one.
    held = queries.op4_language_model(spark, f"{sf_dir}/../sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).head()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_verbatim_items_are_found(spark, sf_dir, duck):
    want = set(duck.execute("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    got = {(row["doc_id"], row["item_id"]) for row in queries.op10_decontamination(spark, sf_dir).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got) <= len(want) + 2


def test_held_out_labels(spark, sf_dir, duck):
    # The smallest tables have a handful of labels only.
    larger = f"{sf_dir}/../sf0.01"
    for fn, label, least in ((queries.op3_toxicity, "toxic", 0.9), (queries.op6_byte_quality, "quality", 0.9)):
        truth = dict(duck.execute(f"SELECT doc_id, {label} FROM '{larger}/labels.parquet'").fetchall())
        rows = [row for row in fn(spark, larger).collect() if row["held_out"] and row["doc_id"] in truth]
        assert rows and sum(row["predicted"] == truth[row["doc_id"]] for row in rows) >= least * len(rows)
        assert all(0 <= row["score"] <= 1 and row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in rows)


def test_expected_tokens_meet_the_targets(spark, sf_dir):
    rows = queries.op8_mixing(spark, sf_dir).collect()
    tokens = sum(row["n_tokens"] for row in rows)
    for k, share in enumerate(mixing.TARGETS.values()):
        total = sum(row["rate"] * row["n_tokens"] * row["posterior"][k] for row in rows)
        assert abs(total - share * tokens) <= 0.01 * tokens


def test_pipeline_is_its_stages(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {row["doc_id"] for row in whole.collect()} == {row["doc_id"] for row in docs.collect()}
    # No benchmark item and no pair of like documents is left.
    left = {row["doc_id"] for row in docs.collect()}
    leaked = {doc_id for doc_id, in duck.execute("SELECT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE NOT contains(b.text, chr(10))").fetchall()}
    assert not left & leaked
