import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from vellumspark.llm import hamming, mixing, quality, queries, store, warcstore
from vellumspark.llm.components import components
from vellumspark.llm.decontam import FMIndex, decontaminate, remove_spans, suffix_array
from vellumspark.llm.linededup import line_dedup
from vellumspark.llm.neardup import near_duplicates
from vellumspark.llm.siteextract import extract_pages, main_text, parse, style_importance
from vellumspark.llm.substring import substring_dedup
from vellumspark.llm.tokens import token_counts

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGE = [
    (0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "One TWO"), (5, LONG), (6, LONG + " tail"), (7, PASSAGE), (8, "lead " + PASSAGE + " end"),
    (9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (10, "a\nb\nc\nd"), (11, "x\na\nb\nc\ny"), (12, "a\na\na\na\na"), (13, "ünï ‍ 中文 🙂 <|endoftext|> é"), (14, "a\nb\nc\nd"),
]
ITEMS = [(1, PASSAGE), (2, "One two"), (3, None), (4, "!!"), (5, "never seen words here"), (1, PASSAGE)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(edge):
    """The edge rows, one of them twice and one with a null id, and columns named like results and helpers."""
    more = edge.union(edge.where("doc_id = 8")).union(edge.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("n_words", "kept", "component_id", "n_lines", "n_removed", "weight", "block", "epoch", "turn", "n_tokens", "spans", "chunk", "label", "score", "node", "h"):
        more = more.withColumn(name, F.lit("clash"))
    return more.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("s"))


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_token_counts_equal_the_library(spark, sf, edge, clashing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {**dict(docs_of(spark, sf)), **{i + 10**6: t for i, t in EDGE}}
    got = token_counts(docs.union(edge.select(F.col("doc_id") + 10**6, "text")), path, limit=100).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
        cut = text.encode()[: r.cut_bytes].decode()
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 100
    assert token_counts(clashing, path).count() == clashing.count()
    assert token_counts(edge.limit(0), path).count() == 0


def test_prefix_counts_are_exact(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vellumspark.llm.tokens import PrefixCounter

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = PrefixCounter(f.read())
    for piece in (" therefore", "ababababab", " undenkeitverte", "aaaaaaa", "!!!!!??", "0123456789"):
        want = [len(library.encode(piece[:k], add_special_tokens=False).ids) for k in range(len(piece) + 1)]
        assert counter.prefix_counts(piece.encode()) == want


def test_prefix_table_answers_budgets(spark, edge):
    import public_tokenizers

    from vellumspark.llm.tokens import bytes_within, prefix_table, tokens_between

    path = public_tokenizers.path(queries.TOKENIZER)
    rows = prefix_table(edge, path).select("*", *(bytes_within(F.col("prefix_tokens"), n).alias(f"b{n}") for n in (0, 7, 100)), tokens_between(F.col("prefix_tokens"), 3, 10).alias("part"))
    rows = {r.doc_id: r for r in rows.collect()}
    for limit in (7, 100):
        for r in token_counts(edge, path, limit=limit).collect():
            table, size = rows[r.doc_id].prefix_tokens, rows[r.doc_id][f"b{limit}"]
            assert len(table) == r.n_bytes + 1 and table[-1] == r.n_tokens
            assert size == next((i for i, n in enumerate(table) if n > limit), len(table)) - 1
            # The counter's own cut is the same, moved back to a character's start.
            assert size - 3 <= r.cut_bytes <= size
    assert rows[0].prefix_tokens == [0] and rows[0].b0 == 0 and rows[7].part == rows[7].prefix_tokens[10] - rows[7].prefix_tokens[3]
    assert prefix_table(edge.limit(0), path).count() == 0


def test_mixing_targets_hold_together_or_raise(spark):
    frame = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate([("big", 4000), ("mid", 400), ("small", 40)] * 3)], "doc_id long, text string, source string")

    def passes(**targets):
        rows = mixing.mix(frame, blocks=64, **targets).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("weight").alias("w")).collect()
        n, w = {r.source: r.n / {"big": 12_000, "mid": 1200, "small": 120}[r.source] for r in rows}, [r.w for r in rows]
        return n["small"] / n["big"], -sum(x * math.log(x) for x in w)

    for repeat, entropy in ((20.0, 0.6), (100.0, 1.0), (None, 1.0986)):
        ratio, got = passes(max_repeat=repeat, min_entropy=entropy)
        assert (repeat is None or ratio <= 1.1 * repeat) and got >= entropy - 1e-6
    for targets in ({"max_repeat": 2.0, "min_entropy": 1.0}, {"min_entropy": 5.0}):
        with pytest.raises(ValueError):
            mixing.mix(frame, **targets)


def test_mixing(spark, sf, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs, max_repeat=2.0, blocks=16).cache()
    tokens = {r.s: r.n for r in docs.groupBy(F.col("source").alias("s")).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    weights = {r.source: r.weight for r in out.select("source", "weight").distinct().collect()}
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    passes = {s: weights[s] / tokens[s] for s in tokens}
    assert math.isclose(max(passes.values()) / min(passes.values()), 2.0, rel_tol=1e-6)
    assert out.where("epoch = 0").select("doc_id").distinct().count() == docs.count()
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = max(tokens[s] / weights[s] for s in tokens)
    biggest = {r.source: r.n for r in docs.groupBy("source").agg(F.lit(1).alias("n")).collect()}
    assert all(taken[s] <= weights[s] * total + 1 for s in biggest)
    entropy = mixing.mix(docs, min_entropy=math.log(len(tokens)) - 0.01).select("source", "weight").distinct().collect()
    assert -sum(r.weight * math.log(r.weight) for r in entropy) >= math.log(len(tokens)) - 0.0100001
    mixed = mixing.mix(clashing)
    assert mixed.where("epoch = 0").count() == clashing.count()
    assert mixing.mix(clashing.limit(0)).count() == 0
    assert mixing.mix(clashing.where("text is null")).count() == 1


def test_near_duplicates(spark, sf, edge, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=size, percent=percent).collect()}
        assert got == brute.near(docs_of(spark, sf), size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(edge).collect()}
    assert got == brute.near(EDGE, 5, 80)
    rows = near_duplicates(clashing).collect()
    assert len(rows) == clashing.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_at_the_contract_on_more_documents(spark):
    more = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_near_duplicates(spark, more).collect()}
    want = brute.near(docs_of(spark, more), 3, 85)
    linked = [k for k, v in want.items() if not v[2]]
    assert linked and sum(got[k] == want[k] for k in linked) == len(linked) and got == want


def test_skewed_joins(spark):
    from vellumspark.llm.skew import join_counted, join_dealt

    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = rows.union(spark.createDataFrame([(None, -1)], "k long, id long"))
    keyed = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    counted = keyed.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    want = sorted((r.k, r.id, r.v) for r in rows.join(keyed, "k").collect())
    for out in (join_counted(rows, counted, ["k"], least=10), join_counted(rows, counted, ["k"], least=10**6), join_dealt(rows, keyed, "k", "id", "u", per=100), join_dealt(rows, keyed, "k", "id", "u", per=10**6)):
        assert sorted((r.k, r.id, r.v) for r in out.select("k", "id", "v").collect()) == want


def test_near_duplicates_without_a_common_centre(spark):
    """Copies that are each close to one text in the middle of the ids, but not to the smallest or largest id."""
    base = [f"w{i}" for i in range(200)]
    docs = []
    for k in range(60):
        words = list(base)
        if k != 30:
            for j in range(4):
                words[(k * 3 + j * 47) % 200] = f"n{k}x{j}"
        docs.append((k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, shingle=3, percent=85, tile=16).collect()}
    assert got == brute.near(docs, 3, 85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, k) for k in range(201, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[102] == 100 and got[399] == 200 and len(got) == 40 + 3 + 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, sf, clashing):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scores = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert sum(r.predicted == r.quality for r in scores) >= 0.9 * len(scores)
    by_label = {k: [r.score for r in scores if r.quality == k] for k in (0, 1)}
    pairs = [(a > b) + (a == b) / 2 for a in by_label[1] for b in by_label[0]]
    assert sum(pairs) >= 0.95 * len(pairs)
    rows = quality.score(clashing, model).collect()
    assert len(rows) == clashing.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).select("score").distinct().collect()} == {0.5}


def test_scores_equal_a_plain_forward_pass(spark, sf, edge):
    """Average of the embedding rows of all features, output layer, softmax: for every feature by itself."""
    import numpy as np

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()), rows=1 << 12, epochs=2)
    rows = len(model.table)
    odd = edge.union(spark.createDataFrame([(100, "é" * 300 + " " + "x" * 70), (101, "same same same other same")], edge.schema))
    texts = dict(EDGE) | {100: "é" * 300 + " " + "x" * 70, 101: "same same same other same"}
    for r in quality.score(odd, model).collect():
        words = (texts[r.doc_id] or "").split()
        at = []
        for w in words:
            at.append(xxhash.xxh3_64_intdigest("w" + w) % rows)
            at += [xxhash.xxh3_64_intdigest("3" + f"<{w}>"[i : i + 3]) % rows for i in range(len(w))]
        for a, b in zip(words, words[1:]):
            m = 1 if a == b else (xxhash.xxh3_64_intdigest("w" + a) * int(quality.MIX) + xxhash.xxh3_64_intdigest("w" + b)) % 2**64
            at.append((((m ^ (m >> 29)) * int(quality.MIX)) % 2**64 >> 32) % rows)
        vector = model.table[at].astype(np.float64).mean(axis=0) if at else np.zeros(model.table.shape[1])
        logits = model.output @ vector + model.bias
        p = np.exp(logits - logits.max())
        assert abs(r.score - p[1] / p.sum()) < 1e-4 and r.predicted == (r.score >= 0.5)


def test_quality_of_ids_that_disagree(spark):
    docs = [(i, "good clear words") for i in range(20)] + [(i, "bad junk noise") for i in range(20, 40)]
    labels = [(i, 1) for i in range(20)] + [(i, 0) for i in range(20, 40)]
    both = [quality.train(spark.createDataFrame(d, "doc_id long, text string").repartition(3), spark.createDataFrame(x, "doc_id long, quality int"), rows=1 << 10) for d, x in ((docs + [(5, "bad junk noise")], labels + [(5, 0)]), ([(5, "bad junk noise")] + docs, [(5, 0)] + labels))]
    assert (both[0].table == both[1].table).all() and (both[0].output == both[1].output).all()


def test_line_dedup(spark, sf, edge, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(docs).collect()}
    assert got == brute.lines(docs_of(spark, sf))
    known = [(i, t) for i, t in EDGE if t is not None]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup(edge).collect()}
    assert got.pop(0) == (0, 0, None)
    assert got == brute.lines(known)
    many = [(i, "\n".join(f"line {j}" for j in range(i, i + 20_000))) for i in range(2)] + [(None, "x\nline 5\nline 6\nline 7")] * 2
    frame = spark.createDataFrame(many, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup(frame).collect())
    want = sorted((False, i, *v) for i, v in brute.lines(many[:2]).items()) + [(True, None, 4, 0, many[2][1])] * 2
    assert got == want
    out = line_dedup(clashing)
    assert out.count() == clashing.count() and out.columns[-2:] == ["n_lines", "n_removed"]
    assert line_dedup(edge.limit(0)).count() == 0


def test_suffix_array_and_index():
    import numpy as np

    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 400), 0)
    sa = suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FMIndex(text, 6)
    for k in (1, 2, 5):
        phrases = np.unique(rng.integers(1, 6, (60, k)), axis=0)
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - k) if text[i : i + k].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_decontamination(spark, sf, edge, clashing, block_bytes):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    block = block_bytes if block_bytes > 1000 else 3000
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate(docs, bench, shard_words=2000, block_bytes=block).collect()}
    assert got == {k: (*v[:2], sorted(map(str, v[2]))) for k, v in brute.contamination(docs_of(spark, sf), items).items()}
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate(edge, bench, block_bytes=block_bytes).collect()}
    want = brute.contamination(EDGE, ITEMS)
    assert got == {k: (*v[:2], sorted(map(str, v[2]))) for k, v in want.items()}
    assert {r.doc_id: r.text for r in remove_spans(edge, bench, block_bytes=block_bytes).collect()} == {i: t and brute.cut_spans(t, want[i][3]) for i, t in EDGE}
    assert decontaminate(clashing, bench, block_bytes=block_bytes).count() == clashing.count() == remove_spans(clashing, bench).count()
    assert decontaminate(edge.limit(0), bench).count() == 0
    named = bench.select(F.concat(F.lit("item-"), "item_id").alias("item_id"), "text")
    found = {r.doc_id: r["items"] for r in decontaminate(edge, named, block_bytes=block_bytes).collect()}
    assert found == {k: sorted(f"item-{i}" for i in v[2]) for k, v in want.items()}
    # Rows of one id are cut by what their own texts hold.
    twice = spark.createDataFrame([(1, "x " + PASSAGE), (1, "clean"), (1, None), (None, PASSAGE + " y")], "doc_id long, text string")
    assert sorted((r.text or "") for r in remove_spans(twice, bench, block_bytes=block_bytes).collect()) == ["", " y", "clean", "x "]
    assert decontaminate(edge, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_long_words_count_whole():
    import numpy as np

    share = np.arange(1 << 10, dtype=np.float32)
    shares = quality._Shares(share)
    for word in ("short", "x" * 64 + "abc", "é" * 200 + "tail", "ab" * 5000 + "c"):
        grams = [f"w{word}"] + [f"3{f'<{word}>'[i : i + 3]}" for i in range(len(word))]
        at = [xxhash.xxh3_64_intdigest(g) % len(share) for g in grams]
        k = shares.places([word])[0]
        assert shares.n[k] == len(at) == len(word) + 1 and abs(shares.total[k] - sum(at)) <= 1e-5 * sum(at)
        where, weights = quality._bag(word, len(share))
        assert dict(zip(where.tolist(), weights.tolist())) == Counter(at)
    assert set(shares) == {"short", "x" * 64 + "abc", "é" * 200 + "tail"}


def test_main_text_rules():
    page = (
        "<html><head><title>T &amp; t</title><style>x{}</style></head><body><header>top</header><nav><a href='#'>m</a></nav>"
        "<main><h1>Big&nbsp;&lt;head&gt;</h1><p>one <b>two</b>\n three<br>four<p>five</p><ul><li>six<li>seven</ul>"
        "<form>no</form><script>if (a < b) { '</p>' }</script><div class='share'>no</div><section id=comments><p>no</section></main>"
        "<aside>no</aside><div class='cookie-notice notice'>no</div><footer>no</footer></body>"
    )
    assert main_text(page, set(), set()) == "Big <head>\none two three four\nfive\nsix\nseven"
    assert main_text("", set(), set()) == "" and main_text("plain &copy; text", set(), set()) == "plain © text"
    assert main_text("<div><p>a</div><p>b", {"/div"}, set()) == "b"


def test_extract_pages_drops_what_a_host_repeats(spark, sf):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=top><p>always the same words</p></div><div class=text><p>page {i} says {i * 7}</p></div></body>") for i in range(20)]
    pages += [(100, None, None), (101, "http://h.example/x", ""), (101, "http://h.example/x", ""), (102, "::", "<p>alone")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = extract_pages(frame).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "page 3 says 21" and text[100] == text[101] == "" and text[102] == "alone"
    assert extract_pages(frame.limit(0)).count() == 0
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r, page in zip(extract_pages(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        article = re.search("<article>(.*)</article>", page.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, parts))


def test_extract_pages_lets_importance_decide_around_main(spark):
    def page(host, i, cls=""):
        return f"http://{host}.example/{i}", f"<body><div class=top><p>the same</p></div><div class=lead><p>lead {i}</p></div><article{cls}><h2>Our house</h2><p>text {i}</p></article></body>"

    # Host a: what repeats goes inside and outside the article, also without a class; what is new outside stays.
    pages = [page("a", i) for i in range(20)]
    # Host b: nearly all pages are copies of one; copies are no evidence against its text. Host c: few pages, of the template
    # that host a has too. Host e: few pages of a template of its own; what is outside the article goes.
    pages += [page("b", 0, " class=post")] * 400 + [page("b", i, " class=post") for i in range(1, 11)] + [page("c", i) for i in range(3)]
    pages += [(url, html.replace("class=", "id=own class=").replace("<article>", "<article id=own>")) for url, html in (page("e", i) for i in range(2))]
    pages += [(f"http://d.example/{min(i, 10)}", f"<body><div><p>plain {min(i, 10)}</p></div></body>") for i in range(400)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = extract_pages(frame).collect()
    assert len(got) == len(pages)
    # Without the tree the text of hosts a and b, with and without an article, is another.
    off = {r.page_id: r.text for r in extract_pages(frame, prior=1e9).collect()}
    assert {r.url[7] for r in got if off[r.page_id] != r.text} == {"a", "b", "c"}
    for r in got:
        host, i = r.url[7], r.url.rpartition("/")[2]
        assert r.text == {"e": f"Our house\ntext {i}", "d": f"plain {i}"}.get(host, f"lead {i}\ntext {i}"), r.url


def test_names_are_signs_and_no_veto():
    def text(page):
        return main_text(page, set(), set())

    prose = "A sentence of some twenty words says so much that nobody takes it for a label, a teaser or a menu of links."
    assert text("<article class='notice'><p>Body</article>") == "Body" == text("<main id=footer><p>Body</main>")
    assert text("<article><p>a</p><section class='related-work'><p>b</p></section><div class='market-share'><p>c</div></article>") == "a\nb\nc"
    assert text("<div class='post-notice-text'><p>all there is</div>") == "all there is"
    assert text(f"<article><p>a</p><div class='site-notice'><p>{prose}</p></div><div class='site-notice'><p>short</p></div></article>") == f"a\n{prose}"
    assert text(f"<article><p>a</p><div class='site-notice'><p><a href=x>{prose}</a></p></div></article>") == "a"
    for name in ("commentlist", "user-reviews", "comment-list", "reader_comments", "related-posts", "share-buttons", "cookie-banner", "sidebar-left"):
        assert text(f"<article><p>a</p><ol class='{name}'><li>b</li></ol></article><section id='respond'>c</section>") == "a", name
    assert text("<body class=no-sidebar><div class='page has-sidebar'><p>a</p></div><div class=comments><p>b</div>") == "a"
    deep = "".join(f"<div>{i} " for i in range(3000))
    assert text(deep).count("\n") == 2999
    blocks, _ = parse(deep)
    assert len({b.node.path for b in blocks}) == 3000 and max(len(b.node.path) for b in blocks) < 500
    assert main_text(deep, {blocks[1500].node.path}, set()).count("\n") == 1499


def test_main_text_of_odd_markup():
    import time

    def both(page):
        return main_text(page, set(), set())

    assert both("<article><header><h1>Title</h1><nav>no</nav></header><p>a</p><div class='comment-box'><p>no</p></div><footer>no</footer></article>") == "Title\na"
    assert both("<header><h1>Site</h1></header><article><div class=post-header>By x</div><p>a</article>") == "By x\na"
    assert both("<p title=don't>one</p><p>two isn't</p>") == "one\ntwo isn't"
    assert both("<p a=\">x</p>\"><b>k</b> z</p><p>1 < 2 > 0") == "k z\n1 < 2 > 0"
    assert both("<body class='has-sidebar comments-open'><div class='content-menu'><article class='ad-free'><p>y</p></article></div>") == "y"
    assert both("<div class=comments><article><p>c</p></article></div><section id=reader-comments><article class=item><p>c</article></section><article><p>k</article>") == "k"
    assert both("<script>if(a<b)</script><p>q</p><SCRIPT>zz</script ><p>r<!-- open") == "q\nr"
    began = time.time()
    for piece in ('<p t="x>a</p>', "<p t='x>a\" </p>", '<x =">"', "<a ", "<!-- a ", "<script>", "<p t='", "<div>", "</div>", "<p>&amp;"):
        main_text(piece * 20_000, set(), set())
    assert time.time() - began < 60


def test_style_importance_equals_a_plain_count(spark):
    """Entropies of texts and child styles per node over distinct pages, without Spark."""
    pages = [("a", f"<body><div class=top><p>same</p></div><div class=t{i % 2}><p>x{i % 3}</p>{'<p>y</p>' * (i % 4)}</div></body>") for i in range(12)] + [("a", "<body><p>z</p></body>")] * 5 + [("b", "<p>one")]
    frame = spark.createDataFrame(pages, "host string, html string")
    want = {}
    for host in ("a", "b"):
        style, content = {}, {}
        for page in {p for h, p in pages if h == host}:
            blocks, shapes = parse(page)
            own, seen = {}, {}
            for b in blocks:
                own.setdefault(b.paths[-1][0], []).append(b.text)
            for path, shape in shapes:
                seen.setdefault(path, []).append(shape)
            for path, parts in own.items():
                content.setdefault(path, []).append("\n".join(parts))
            for path, parts in seen.items():
                style.setdefault(path, []).append("\n".join(parts))

        def entropy(values):
            n = len(values)
            return -sum(c / n * math.log(c / n, n) for c in Counter(values).values()) if n > 1 else 1.0

        for path in {p[:k] for leaf in content for p in [leaf + "/"] for k in range(1, len(p)) if p[k] == "/"}:
            under = [v for leaf, v in content.items() if leaf == path or leaf.startswith(path + "/")]
            mean = sum(len(v) * entropy(v) for v in under) / sum(map(len, under))
            want[host, path] = (max(map(len, under)), 0.1 * entropy(style[path]) + 0.9 * mean)
    got = {(r.host, r.path): (r.pages, r.importance) for r in style_importance(frame).collect()}
    assert got.keys() == want.keys()
    for k, (n, importance) in want.items():
        assert got[k][0] == n and math.isclose(got[k][1], importance, abs_tol=1e-9), k


def walked(data):
    """Types and HTTP bodies of records read one after the other, as an archive reader does: by the lengths alone."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if x)
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        block = data[end : end + int(fields[b"Content-Length"])]
        at = end + len(block) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
        out.append((fields[b"WARC-Type"].decode(), block.split(b"\r\n\r\n", 1)[1]))
    return out


def test_archive_round_trip(spark, sf):
    import base64
    import hashlib

    pages = [(5, "http://a/\r\nx", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "http://c/", None), (2, "http://d/", ""), (7, "http://e/", "ünï"), (7, "http://e/", "ünï")]
    # One id with two payloads, null ids with and without a numbered copy, and urls that hold other line separators.
    pages += [(7, "http://f/", "other"), (None, "u", "same"), (None, "u", "alone"), (None, "v", "alone"), (11, "http://g/\u2028WARC-Refers-To: <urn:page:5>", "g"), (12, "http://h/\u0085WARC-Payload-Digest: sha1:ABC", "same")]
    pages += [(13, "http://i/\u2029\x0b\x0cWARC-Type: revisit", "long " * 50_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("address", F.lit("clash")).withColumn("slot", F.lit("clash"))
    for least in (0, 3, 5):
        path = store.new_path(spark, "test")
        warcstore.write_archive(frame, path, min_bytes=least)
        first = {}
        for i, _, h in pages:
            first.setdefault(h or "", set()).add(i)
        first = {h: min((i for i in ids if i is not None), default=None) for h, ids in first.items()}
        want = []
        for i, u, h in pages:
            data = (h or "").encode()
            response = first[h or ""] in (None, i) or len(data) < least
            digest, url = base64.b32encode(hashlib.sha1(data).digest()).decode(), (u or "").replace("\r", " ").replace("\n", " ")
            refers = None if response else first[h or ""]
            head = f"WARC/1.1\r\nWARC-Type: {'response' if response else 'revisit'}\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {warcstore.DATE}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
            head += "" if response else f"WARC-Refers-To: <urn:page:{refers}>\r\nWARC-Profile: {warcstore.PROFILE}\r\n"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n"
            head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + (len(data) if response else 0)}\r\n\r\n{http}"
            want.append((i is None, i, url, "response" if response else "revisit", digest, refers, len(data), data, head.encode() + (data if response else b"") + b"\r\n\r\n", True))
        rows = warcstore.read_archive(spark, path).collect()
        got = [(r.record_id is None, r.record_id, r.url, r.record_type, r.payload_digest, r.refers_to, r.length, bytes(r.payload), bytes(r.record), r.verified) for r in rows]
        key = lambda r: (r[0], r[1] or 0, r[2], r[7])
        assert sorted(got, key=key) == sorted(want, key=key)
        assert all(r.digest == r.payload_digest for r in rows)
        assert walked(b"".join(bytes(r.record) for r in rows)) == [(r.record_type, bytes(r.payload) if r.record_type == "response" else b"") for r in rows]
        assert warcstore.read_payloads(spark, path).count() == len(first)
    path = store.new_path(spark, "test")
    warcstore.write_archive(frame.limit(0), path)
    assert warcstore.read_archive(spark, path).count() == 0


def test_archive_tells_damage_and_spreads_a_common_payload(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "same") for i in range(10_000)] + [(-1, "u", "rare")], "page_id long, url string, html string")
    path = store.new_path(spark, "test")
    warcstore.write_archive(pages, path)
    rows = warcstore.read_archive(spark, path)
    assert rows.where("verified and (record_type = 'revisit') = (record_id > 0)").count() == 10_001
    assert warcstore.read_headers(spark, path).where("record_id >= 0").select("slot").distinct().count() == 3
    bad = store.new_path(spark, "bad")
    warcstore.read_headers(spark, path).select("header", "address", "slot").write.parquet(f"{bad}/records")
    warcstore.read_payloads(spark, path).withColumn("payload", F.when(F.col("uses") == 1, F.lit("rarer").cast("binary")).otherwise(F.col("payload"))).write.parquet(f"{bad}/payloads")
    assert [r.record_id for r in warcstore.read_archive(spark, bad).where("not verified").collect()] == [-1]


def test_hamming_topk(spark):
    import random

    random.seed(3)
    vectors = [(i, [random.choice((-1.0, 1.0)) for _ in range(16)]) for i in range(0, 400)]
    vectors += [(1000 + i, [1.0] * 16) for i in range(50)] + [(2000, None), (2001, [1.0]), (1000, [1.0] * 16), (2002, [float("nan"), None] + [1.0] * 14)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).withColumn("d", F.lit(1))
    got = sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in hamming.hamming_topk(frame, k=5, every=100, dims=16).collect())
    codes = {i: [bool(x is not None and x > 0) for x in v] for i, v in vectors if v is not None and len(v) == 16}
    want = []
    for q in codes:
        if q % 100 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:5]
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert hamming.hamming_topk(frame.limit(0), dims=16).count() == 0


def test_substring_dedup(spark, sf, edge, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs, chunk_bytes=20_000).collect()}
    assert got == brute.substrings(docs_of(spark, sf))
    rows = substring_dedup(edge).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute.substrings(EDGE)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in rows)
    # Hash buckets of any number, and first hashes so short that nearly all windows meet.
    for short, entries in ((48, 4), (6, 1 << 20)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(edge, chunk_bytes=100, bucket_entries=entries, short_bits=short).collect()}
        assert got == brute.substrings(EDGE)
    out = substring_dedup(clashing).collect()
    assert len(out) == clashing.count() and [r.n_removed for r in out if r.doc_id is None] == [0]
    assert substring_dedup(edge.limit(0)).count() == 0
