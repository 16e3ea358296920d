"""Main text, toxicity, language, quality rules and decontamination."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: F401
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, html_blocks, language_ppm, quality_rules, toxicity
from gradeloom.llm.registry import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><!-- <p>no</p> -->
<article><h1>A  title</h1><p>First <b>bold</b> words &amp; more,<br>here &#233; &lt;x&gt;.<p>Second paragraph of the text.
<div class="ad">Buy this now</div></article><footer>&copy; 2020</footer>"""


def test_blocks():
    texts = [b.text for b in html_blocks.blocks_of(PAGE)]
    assert texts == [
        "Home", "About", "A title", "First bold words & more, here é <x>.", "Second paragraph of the text.",
        "Buy this now", "© 2020",
    ]
    path = html_blocks.blocks_of(PAGE)[5].path
    assert "article" in path and ".ad" in path and "p" not in path


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "a < b > c", "</div>", '<p class="x>'])
def test_broken_pages(page):
    for block in html_blocks.blocks_of(page):
        assert block.text


def test_gradients_are_right():
    random = np.random.default_rng(0)
    net = html_blocks.Lstm(5, hidden=3)
    x = random.normal(size=(4, 2, 5)).astype(np.float32)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], np.float32)
    y = random.integers(0, 2, (4, 2)).astype(np.float32)

    def loss():
        p = net.chances(x, mask)[0]
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    for key, grad in net.gradients(x, mask, y).items():
        weight = net.weights[key]
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = weight[at]
        weight[at] = kept + 0.01
        more = loss()
        weight[at] = kept - 0.01
        less = loss()
        weight[at] = kept
        assert abs((more - less) / 0.02 - grad[at]) < 2e-3


@pytest.fixture(scope="module")
def network(spark):
    return html_blocks.train(spark.read.parquet(f"{SF}/pages.parquet"), most=60)


def test_main_text(spark, network):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    right = 0
    rows = html_blocks.extract(pages, network).collect()
    for r in rows:
        want = [b.text for b in html_blocks.blocks_of(r.html) if "article" in b.path]
        right += r.text == "\n".join(want)
    assert right >= 0.9 * len(rows)


def test_main_text_of_odd_pages(spark, network):
    schema = "page_id long, text string, html string"
    odd = spark.createDataFrame([(1, "old", None), (2, "old", ""), (3, "old", PAGE * 300), (3, "old", PAGE * 300)], schema)
    rows = html_blocks.extract(odd, network).collect()
    assert [r.text for r in rows][:2] == ["", ""] and rows[2].text == rows[3].text
    assert html_blocks.extract(spark.createDataFrame([], schema), network).count() == 0


def test_training_without_pages(spark):
    net = html_blocks.train(spark.createDataFrame([], "page_id long, html string"))
    assert net.label([html_blocks.vectors(html_blocks.blocks_of(PAGE), {})])[0].any()


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.train(docs, labels, toxicity.in_training())


@pytest.mark.parametrize(
    "word, plain",
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("5tup1d", "stupid"), ("$tup!d", "stupid"), ("m0r0n", "moron"),
     ("stuuuupid", "stupid"), ("l-o-s-e-r", "loser"), ("cl0wn", "clown"), ("p@th3tic", "pathetic")],
)
def test_decoding(scorer, word, plain):
    assert toxicity.squeezed(scorer.decoder.decode(word)) == plain
    assert scorer.score(f"The and of {word} that.") > 0.8


def test_spaced_letters_and_clean_texts(scorer):
    assert scorer.score("it is the i d i o t of") > 0.8
    for text in (None, "", "   ", "call (555) 123-4567, mail a@b.com, see 10.0.0.1", "***", "a " * 9000):
        assert scorer.score(text) <= 0.02


@pytest.mark.parametrize(
    "word, plain",
    [("p47h371c", "pathetic"), ("1d107", "idiot"), ("p@7h37!c", "pathetic"), ("!d!07", "idiot"), ("1053r", "loser"),
     ("w0r7h1355", "worthles")],
)
def test_words_mostly_of_signs(scorer, word, plain):
    assert plain in toxicity.restored_words(f"The {word} of", scorer.decoder, {})
    assert scorer.score(f"The and of {word} that.") > 0.8


@pytest.mark.parametrize(
    "run", ["a s c u m", "y o u s c u m", "i  d  i  o  t", "i\td\ti\to\tt", "y o u  i d i o t", "a n 1 d 1 0 7"]
)
def test_spaced_words(scorer, run):
    plain = "scum" if "m" in run else "idiot"
    assert plain in toxicity.restored_words(f"that is {run} of", scorer.decoder, {})
    assert scorer.score(f"that is {run} of") > 0.8


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_piece_counts_go_out_in_bounded_parts(scorer):
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} plain tones" for i in range(300)]
    frame = pd.DataFrame({"text": texts, "toxic": [i % 2 for i in range(300)]})
    parts = list(toxicity.count_pieces(iter([frame]), scorer.decoder, {}, most=50))
    whole = list(toxicity.count_pieces(iter([frame]), scorer.decoder, {}, most=1 << 30))
    assert len(whole) == 1 and len(parts) > 5
    assert max(map(len, parts)) < 50 + 40  # a text has fewer than 40 pieces
    sums = pd.concat(parts).groupby("piece").sum().sort_index()
    assert sums.equals(whole[0].set_index("piece").sort_index())
    assert sums.loc["", "toxic"] == 150 and sums.loc["=plain", "clean"] == 150


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs, scorer):
    rows = toxicity.score_texts(odd_docs, scorer)
    assert sorted(rows.columns) == sorted(odd_docs.columns) and rows.count() == odd_docs.count()
    assert toxicity.score_texts(no_docs, scorer).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def test_evidence():
    assert toxicity.evidence(10, 0, 0.1) == pytest.approx(10 * np.log(10))
    assert toxicity.evidence(1, 9, 0.1) == pytest.approx(0)


def test_code_lengths_are_exact():
    """Against escape method C with exclusion, written out byte by byte."""
    samples = {"x": [b"abracadabra abracadabra", b"banana banana bandana"], "y": [b"xyzzy xyzzy", b"abc"]}
    model = language_ppm.Model(samples)
    classes = model.size
    total = {}
    for texts in samples.values():
        for text in texts:
            line = b"\n\n\n" + text
            for i in range(3, len(line)):
                for k in (2, 3):
                    total[line[i - k : i]] = total.get(line[i - k : i], 0) + 1

    def chance(counts, context, byte, out):
        here = {s: n for (c, s), n in counts.items() if c == context and s not in out}
        seen = {s: n for (c, s), n in counts.items() if c == context}
        kept = len(context) < 2 or total.get(context, 0) >= language_ppm.LEAST_COUNT
        while kept and len(context) == 3 and total.get(context[1:], 0) < language_ppm.LEAST_COUNT:
            kept = False
        if not kept or not seen:
            return chance(counts, context[1:], byte, out) if context else 1 / classes
        share = sum(seen.values()) + len(seen)
        if byte in here:
            return seen[byte] / share
        rest = {s for s in range(classes)} - set(seen)
        if context:
            lower = {s: chance(counts, context[1:], s, set()) for s in rest}
        else:
            lower = {s: 1 / classes for s in rest}
        return len(seen) / share * lower[byte] / sum(lower.values())

    for column, name in enumerate(model.languages):
        counts = {}
        for text in samples[name]:
            line = b"\n\n\n" + text
            for i in range(3, len(line)):
                for k in range(4):
                    key = (line[i - k : i], int(model.classes[line[i]]))
                    counts[key] = counts.get(key, 0) + 1
        text = b"abba bandana zq"
        line = b"\n\n\n" + text
        want = sum(
            -np.log2(chance(counts, line[i - 3 : i], int(model.classes[line[i]]), set())) for i in range(3, len(line))
        )
        assert model.code_lengths([text, b""])[0][column] == pytest.approx(want, rel=1e-4)


def test_held_out_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op3_language_ppm"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_language_of_odd_documents(odd_docs, no_docs):
    model = language_ppm.train(odd_docs)
    found = language_ppm.classify(odd_docs, model)
    assert found.columns.count("score") == 1
    rows = {r.doc_id: r for r in found.collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (0, 1, 2))
    assert rows[10].lang_pred in ("en", "de") and 0 < rows[10].score <= 1
    assert language_ppm.train(no_docs) is None
    assert {r.lang_pred for r in language_ppm.classify(odd_docs, None).collect()} == {"und"}
    assert language_ppm.classify(no_docs, model).count() == 0


def test_quality_of_odd_documents(odd_docs, odd_texts, no_docs):
    rows = {r.doc_id: r for r in quality_rules.judge(odd_docs).collect()}
    for i, text in enumerate(odd_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {j + k for j, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(no_docs).count() == 0


def brute_hits(text, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = find(text), set(), set()
    for item, own in items:
        own = find(own)
        size = min(13, len(own))
        for j in range(len(own) - size + 1) if own else ():
            window = own[j : j + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == window:
                    hit.update(range(i, i + size))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def test_decontamination(spark, odd_docs, odd_texts, no_docs):
    long_item = " ".join(f"Word{i}" for i in range(20))
    items = [(1, "four words"), (2, None), (3, "..."), (4, long_item), (5, odd_texts[5]), (10, odd_texts[5] + " x"), (6, "THE")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [*odd_texts, f"x {long_item[:-8]}, y", f"{long_item} {long_item}"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    for most in (16_000_000, 10):  # one automaton, and one for each item
        for r in decontaminate.scan(frame, table, most_bytes=most).collect():
            assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(docs[r.doc_id], items)
            raw = (docs[r.doc_id] or "").encode()
            inside = [w for s in r.spans for w in decontaminate.folded(raw[s.begin : s.end].decode()).split()]
            assert len(inside) == r.n_hit
    kept = decontaminate.clean(odd_docs, table)
    assert kept.columns == odd_docs.columns and {0, 1, 2} <= {r.doc_id for r in kept.collect()}
    assert decontaminate.clean(no_docs, table).count() == 0
    assert decontaminate.clean(odd_docs, table.limit(0)).count() == odd_docs.count()


@pytest.mark.parametrize("blank", ["\u00a0", "\u0085", "\u2003", "\u2028", "\u202f", "\u3000"])
def test_decontamination_with_unicode_spaces(spark, blank):
    long_item = " ".join(f"mot{i}{blank}?" if i % 3 == 0 else f"w{i}{blank}x" if i % 3 == 1 else f"w{i}" for i in range(30))
    items = [(1, long_item), (2, f"deux{blank}mots ici"), (3, blank)]
    docs = [f"Before. {long_item} behind", f"x deux{blank}mots ici y", "x deux mots ici y"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = decontaminate.scan(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(docs[r.doc_id], items)
    assert {r.doc_id: r.item_ids for r in rows} == {0: ["1"], 1: ["2"], 2: []}


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_decontaminate"](spark, SF).collect()
    assert sum(r.contaminated for r in rows) > 0
    for r in rows:
        if r.n_hit or r.doc_id % 10 == 0:
            words, hit, ids = brute_hits(texts[r.doc_id], items)
            digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (words, hit, len(ids), digest)
            assert r.contaminated == (hit > 0 and 20 * hit >= words)


def test_documents_stay_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality_rules.judge(docs).where(~F.col("base_failed"))
    assert judged.where("kept").count() >= 0.8 * judged.count()
