"""The pieces the operators are made of."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions

from pagegrain.llm import attention, byte_network, decontaminate, line_dedup, queries, toxicity, url_filter, wrappers
from pagegrain.llm.components import components
from pagegrain.llm.ngram_join import ngram_join
from pagegrain.llm.textops import pieces


def test_words_and_shingles_stay_inside_their_text():
    (_, _, piece), = pieces(pa.array(["One two", None, "", "three", "two  one two", "x"]))
    assert np.diff(piece.first).tolist() == [2, 0, 0, 1, 3, 1]
    names = piece.hashes()
    assert names[0] == names[4] and names[1] == names[3] == names[5] and len({*names.tolist()}) == 4
    grams, docs = piece.shingles(2)
    assert docs.tolist() == [0, 3, 4, 4, 5] and grams[0] == grams[3] and len({*grams.tolist()}) == 4
    assert piece.hashes(1)[1] == piece.hashes(1)[2]


def test_small_pieces_agree_with_one():
    texts = pa.array([f"alpha beta {i} gamma" for i in range(50)])
    whole = np.concatenate([p.shingles(3)[0] for _, _, p in pieces(texts)])
    assert (whole == np.concatenate([p.shingles(3)[0] for _, _, p in pieces(texts, limit=64)])).all()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1300)]
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1000, 1300)} == {7} and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_large_group_is_counted_in_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(90)] + [(1000 + i, " ".join(base)) for i in range(30)]
    got = {row["doc_id"]: row for row in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert all(row["class_id"] == 0 and row["n_links"] == 90 for row in got.values())
    assert {got[1000 + i]["n_copies"] for i in range(30)} == {30}


def test_attention_gradient():
    network = attention.Attention.fresh(np.ones(attention.ALPHABET))
    rng = np.random.default_rng(0)
    ids, lengths = rng.integers(0, attention.ALPHABET, 90), np.array([50, 1, 39])
    laid = attention.windows(ids, lengths)
    assert (laid.wanted[laid.real] == ids).all()
    network.weights = {name: value.astype(np.float64) for name, value in network.weights.items()}
    _, slopes = network.gradients(laid.read, laid.wanted, laid.real)
    for name, value in network.weights.items():
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), value.shape)
        kept, ends = value[at], []
        for move in (1e-4, -1e-4):
            value[at] = kept + move
            ends.append(network.gradients(laid.read, laid.wanted, laid.real)[0])
        value[at] = kept
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(slopes[name][at], rel=1e-4)


def test_attention_is_causal_and_a_distribution():
    network = attention.Attention.fresh(np.ones(attention.ALPHABET))
    ids = np.arange(40)
    one = network.score(ids, np.array([40]))
    other = network.score(np.concatenate([ids[:20], ids[:20]]), np.array([40]))
    assert np.allclose(one[:20], other[:20], atol=1e-5)
    whole = sum(np.exp(network.score(np.array([3, k]), np.array([2]))[1]) for k in range(attention.ALPHABET))
    assert whole == pytest.approx(1, abs=1e-3)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(500):
        places = np.sort(rng.choice(40, rng.integers(1, 5), replace=False))
        weights = rng.random(len(places)).astype(np.float32)
        rows.append((i, int(rng.random() < 0.3), places, weights / np.linalg.norm(weights)))
    index = toxicity.Index.build(np.arange(40, dtype=np.uint64), np.ones(40), rows, 0.3)
    whole = np.zeros((len(rows), 40), np.float32)
    for at, (_, _, places, weights) in enumerate(sorted(rows, key=lambda row: index.ids.index(row[0]))):
        whole[at, places] = weights
    asked = [np.sort(rng.choice(40, 3, replace=False)) for _ in range(50)]
    weights = np.array([0.6, 0.6, 0.53], np.float32)
    skip = np.arange(50) * 3
    for skipped in (None, skip):
        found, near = index.nearest(np.repeat(np.arange(50), 3), np.concatenate(asked), np.tile(weights, 50), 50, skipped)
        for i, places in enumerate(asked):
            every = whole[:, places] @ weights
            if skipped is not None:
                every[skip[i]] = 0
            best = np.sort(every[every > 0])[::-1][: toxicity.NEIGHBOURS]
            assert np.allclose(near[i][: len(best)], best, atol=2e-5) and (found[i] >= 0).sum() == len(best)
            assert np.allclose(every[found[i][: len(best)]], best, atol=2e-5)


def test_posting_lists_and_common_terms_add_up():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        places = np.sort(rng.choice(3000, 30, replace=False) if i % 2 else np.append(rng.choice(np.arange(20, 3000), 25, replace=False), np.arange(5)))
        weights = rng.random(30).astype(np.float32)
        rows.append((i, i % 2, places, weights / np.linalg.norm(weights)))
    index = toxicity.Index.build(np.arange(3000, dtype=np.uint64), np.ones(3000), rows, 0.5)
    assert 0 < index.matrix.shape[1] < 3000 and len(index.rows)
    whole = np.zeros((300, 3000), np.float32)
    for row in rows:
        whole[index.ids.index(row[0]), row[2]] = row[3]
    docs, places = np.repeat(np.arange(300), 30), np.concatenate([row[2] for row in rows])
    found, near = index.nearest(docs, places, np.concatenate([row[3] for row in rows]), 300)
    for i, row in enumerate(rows):
        every = np.sort(whole[:, row[2]] @ row[3])[::-1]
        count = int((every > 1e-5).sum())
        assert np.allclose(near[i][:count], every[: min(count, toxicity.NEIGHBOURS)], atol=3e-5) and index.ids[found[i][0]] == i


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, 90), rng.integers(0, 6, 70)
        assert decontaminate.common_words(decontaminate._masks(a), len(a), b.tolist()) == plain(a.tolist(), b.tolist())


def test_paraphrases_are_found_and_other_texts_are_not(spark):
    rng = np.random.default_rng(3)

    def words(n):
        return ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(n)]

    items = [(i, words(40)) for i in range(20)]
    docs = []
    for i, item in items:
        changed = list(item)
        for at in range(3, 30, 5):
            changed[at] = "changed"
        docs += [(2 * i, " ".join([*words(100), *changed, *words(100)])), (2 * i + 1, " ".join(words(240)))]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    found = {(row["doc_id"], row["item_id"]) for row in got.collect()}
    assert found <= {(2 * i, i) for i, _ in items} and len(found) >= 18


def test_globs_against_regular_expressions():
    rng = np.random.default_rng(4)
    globs = ["*.a.b/**", "*a?b*/**", "**/x*y", "a**b**c", "?/?", "*", "**", "", "a" * 70 + "*b"]
    automaton = url_filter.Automaton([url_filter.Rule(glob, glob, "block", len(globs) - i) for i, glob in enumerate(globs)])
    urls = ["".join(rng.choice(list("abxy./"), rng.integers(0, 9))) for _ in range(3000)] + ["a" * 70 + "zzb", "a" * 69 + "b"]
    names = [rule.glob for rule in automaton.rules]
    for url, at in zip(urls, automaton.first_match([url.encode() for url in urls])):
        want = next((i for i, glob in enumerate(names) if re.search(queries._glob_regex(glob), url)), -1)
        assert at == want, url


def test_url_query_agrees_with_sql(spark, sf_dir, duck):
    got = sorted(map(repr, map(tuple, queries.op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect())))
    want = duck.execute(queries.ORACLES["op9_url_filter"]).fetchall()
    assert got == sorted(map(repr, want))


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://com", "http://com/", "http://x.net/es/1", "http://net/fr/", "http://a.com?/en/", "http://b.org/casino/1"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {row["page_id"]: (row["host"], row["path"], row["rule"], row["verdict"]) for row in url_filter.url_verdicts(rows).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5] == ("com", "", None, "allow") and got[6][2] == "com/"
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block") and got[9] == ("a.com", "", None, "allow") and got[10][3] == "block"
    assert url_filter.url_verdicts(rows.limit(0)).count() == 0


PAGE = ('<html><body><header>Site</header><nav><ul><li><a href=x>A</a></li><li><a>B</a></li></ul></nav><div class="ad">x &amp; y</div><aside>side</aside>'
        '<article><h1>{title}</h1><p class="notice">Log in</p><p><b>{one}<br>two<p>three &lt; four &amp five<form>f</form><div class="comments"><p>first!</p></div></article><footer>foot</footer>')


def test_main_text_of_a_page_and_of_a_host(spark):
    rows = [(i, f"http://a.com/{i}", PAGE.format(title=f"T{i}", one=f"one  {i}")) for i in range(8)] + [(50, None, None), (51, "http://b.com", ""), (52, "x", "just text")]
    got = {row["page_id"]: (row["text"], row["n_chars"]) for row in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i][0] == f"T{i}\n\none {i} two\n\nthree < four & five" and got[i][1] == len(got[i][0])
    assert got[50] == got[51] == ("", 0) and got[52] == ("just text", 9)
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_of_two_pages_is_union_free():
    a = wrappers.sketch(wrappers.parse("<div><h1>A</h1><p>x</p><p>y</p></div>"))
    b = wrappers.sketch(wrappers.parse("<div><h1>B</h1><em>by</em><p>z</p></div>"))
    assert wrappers.expression(wrappers._merged(a, b)) == "<div><h1>#</>(<em>#</>)?(<p>#</>)+</>"


def test_deep_and_unclosed_pages():
    assert wrappers.page_text("<div>" * 5000 + "hello", None) == "hello"
    wrappers.sketch(wrappers.parse("<div>" * 5000 + "hello"))
    assert wrappers.page_text("<p>x" * 5000, None) == "\n\n".join(["x"] * 5000)


def test_articles_of_the_given_pages(spark, sf_dir, duck):
    got = {row["page_id"]: row["text"] for row in queries.op7_main_text(spark, sf_dir).collect()}
    for page_id, page in duck.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", part))).strip() for part in re.split(r"</?(?:p|h\d)>", article)]
        assert got[page_id] == "\n\n".join(part for part in parts if part)


def _as_line(numbers):
    return "".join(chr(0x4E00 + number) for number in numbers)


def test_near_copies_that_are_no_hubs_of_their_bucket(spark):
    # In one bucket: 1 and 9 are its least and greatest key and like no other line; 3, 4 and 5, 6 are near copies.
    near = {3: range(100, 200), 4: range(105, 205), 5: range(300, 400), 6: range(302, 402), 1: range(500, 600), 9: range(700, 800)}
    kinds = {3: 1, 4: 1, 5: 2, 6: 2, 1: 3, 9: 4}
    signed = spark.createDataFrame([(key, [77], 100, *[kinds[key] * 0x01010101010101] * 3) for key in near], "key long, bands array<long>, total int, s0 long, s1 long, s2 long")
    texts = spark.createDataFrame([(key, _as_line(found)) for key, found in near.items()], "key long, line string")
    assert line_dedup.verified(line_dedup.candidates(line_dedup.shared(signed), signed), texts, 0.8).count() == 0
    labels = spark.createDataFrame([], "key long, component long")
    for lines, block in ((256, 1 << 16), (2, 150)):
        members = line_dedup.open_lines(line_dedup.shared(signed), signed, labels, line_dedup.BANDS, line_dedup.ROWS, lines)
        assert {tuple(row) for row in line_dedup.remaining(members, texts, signed, 0.8, line_dedup.BANDS, line_dedup.ROWS, block).collect()} == {(3, 4), (5, 6)}


def test_fuzzy_lines_share_a_band(spark):
    # Lines of short words, one of them replaced, in other case and spacing: an exact copy is in no pair.
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows, pairs = [], 0
    while pairs < 600:
        words = ["".join(rng.choice(letters, int(rng.integers(1, 6)))) for _ in range(int(rng.integers(12, 40)))]
        other = list(words)
        other[int(rng.integers(0, len(words)))] = "".join(rng.choice(letters, 4))
        one, two = " ".join(words), " ".join(other)
        sets = [{line[i : i + 5] for i in range(len(line) - 4)} for line in (one, two)]
        if one != two and 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]):
            rows += [(2 * pairs, one), (2 * pairs + 1, two.title().replace(" ", "  ", 1))]
            pairs += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [row["doc_id"] for row in line_dedup.line_dedup(docs).where("emptied").collect()]
    assert all(doc_id % 2 for doc_id in gone) and len(gone) >= 0.99 * pairs


def test_every_shingle_of_a_line_is_signed(spark):
    # The minima of a line are those over all its shingles, whatever its characters: they are the least of the minima of its single shingles.
    rows = line_dedup.ROWS
    for length in (3, 5, 67, 300):
        line = "".join(chr(0x100 + 7 * i % 997) if i % 11 else chr(0x1F600 + i % 7) for i in range(length)).lower()
        parts = [line[i : i + 5] for i in range(length - 4)] or [line]
        whole = line_dedup.signatures(spark.createDataFrame([(1, line)], "doc_id long, line string"), 1, rows).head()
        assert whole["total"] == len(parts) and whole["n"] == 1
        singles = spark.createDataFrame([(part.encode("utf-32-be"),) for part in parts], "wide binary").selectExpr(*[f"hash({row}, xxhash64(wide)) h{row}" for row in range(rows)])
        least = singles.agg(*[functions.min(functions.col(f"h{row}").bitwiseXOR(functions.lit(line_dedup._spread(row)))).alias(f"m{row}") for row in range(rows)])
        assert least.selectExpr(f"xxhash64(0, {', '.join(f'm{row}' for row in range(rows))}) b").head()["b"] == whole["bands"][0]


def _wrapper_of(pages):
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * len(pages)), pa.array(pages)], names=["host", "html"])
    (row,) = [row for out in wrappers._fold(iter([batch])) for row in out.to_pylist()]
    return wrappers.Part.of(wrappers.json.loads(row["wrapper"]))


def test_every_page_of_a_shape_enters_the_wrapper():
    page = "<html><body><article><h1>{0}</h1><p class=hint>Printed on every page of the site.</p><div>{1}</div></article></body></html>"
    pages = [page.format(f"Title {i}", f"Own words of page {i}, " * 20) for i in range(12)]
    whole = _wrapper_of(pages)
    assert whole.seen == 12
    text = wrappers.page_text(pages[0], wrappers.json.dumps(wrappers.main_part(whole)))
    assert "Own words of page 0" in text and "Printed on every page" not in text
    # The first pages are copies of one article: what the later ones show is no template.
    pages = [page.format("Copy", "Words of the copied article, " * 20)] * 6 + pages
    text = wrappers.page_text(pages[0], wrappers.json.dumps(wrappers.main_part(_wrapper_of(pages))))
    assert "Words of the copied article" in text and "Printed on every page" not in text


def test_texts_that_differ_late_are_no_template():
    page = "<html><body><article><div>{0}</div></article></body></html>"
    pages = [page.format("The same opening of each article. " * 10 + f"End {i}") for i in range(8)]
    text = wrappers.page_text(pages[3], wrappers.json.dumps(wrappers.main_part(_wrapper_of(pages))))
    assert text.endswith("End 3")
    assert wrappers._name_of("a" * 300 + "b") != wrappers._name_of("a" * 300 + "c")


def test_every_window_of_bytes_is_scored():
    network = byte_network.Network.fresh()
    data = np.random.default_rng(3).integers(0, 256, 3 * byte_network.CHUNK + 77).astype(np.uint8)
    for size in (3, 8, 9, byte_network.CHUNK + 6, byte_network.CHUNK + 7, byte_network.CHUNK + 8, len(data)):
        text = byte_network.padded(data[:size], byte_network.REACH)
        windows = np.lib.stride_tricks.sliding_window_view(text, byte_network.REACH)
        want = np.maximum(sum(network.table[k][windows[:, k]] for k in range(byte_network.REACH)) + network.bias, 0)
        best, mean = byte_network.pooled(network, data[:size])
        assert np.allclose(best, want.max(axis=0), atol=1e-5) and np.allclose(mean, want.mean(axis=0), atol=1e-5)
    # A pattern is found wherever it starts.
    text = np.zeros(200, np.uint8)
    found = []
    for start in range(40, 48):
        moved = text.copy()
        moved[start : start + 20] = data[:20]
        found.append(byte_network.pooled(network, moved)[0])
    assert np.allclose(found, found[0], atol=1e-5)
