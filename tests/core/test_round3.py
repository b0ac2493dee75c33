"""Trees of any depth, terms of any length, similar titles, the stored index, and states that end, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import index as I
from vellumspark.operators import joins as J
from vellumspark.operators import layout as L
from vellumspark.operators import search as S
from vellumspark.operators import terms as M
from vellumspark.operators import tree as R
from vellumspark.operators import windows as W
from vellumspark.queries.search import asked, docs
from vellumspark.staging import new_path
from vellumspark.streaming import jobs as ST

NODE = "node_id string, parent_id string, ord int, depth int, kind string, title string, skip boolean"


def chain(n, skipped=()):
    return [(f"n{k}", f"n{k - 1}" if k else None, 0, k, "chapter" if k in (3, 20) else "section", f"t{k}", k in skipped) for k in range(n)]


def test_tree_of_forty_levels(spark):
    rows = chain(40, (7, 30)) + [("side", "n25", 1, 26, "section", "s", False)]
    nodes = spark.createDataFrame(rows, NODE)
    parent = {r[0]: r[1] for r in rows}
    skip = {r[0]: r[6] for r in rows}

    def path(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out[::-1]

    got = {r.node_id: (r.ids, r.hidden) for r in R.with_paths(nodes).collect()}
    assert got == {i: (path(i), any(skip[x] for x in path(i))) for i in parent}
    want = set()
    for i in parent:
        for d, a in enumerate(reversed(path(i))):
            want.add((a, i, d))
            if skip[a]:
                break
    assert {tuple(r) for r in R.closure(nodes).collect()} == want
    assert {r.node_id: (r.chapter, r.root) for r in R.chapter_of(nodes).collect()} == {i: ("n20" if "n20" in path(i) else "n3" if "n3" in path(i) else None, "n0") for i in parent}
    assert {r.node_id: r.pos for r in R.document_order(nodes).collect()}["n39"] == 40
    assert R.tree_errors(nodes).count() == 0 and R.with_paths(nodes.limit(0)).count() == 0


def test_cycles_and_orphans_are_errors(spark):
    rows = chain(5) + [("a", "b", 0, 0, "section", "", False), ("b", "c", 0, 0, "section", "", False), ("c", "a", 0, 0, "section", "", False), ("under", "a", 0, 0, "section", "", False), ("own", "own", 0, 0, "section", "", False)]
    rows += [("o", "nowhere", 0, 0, "section", "", False), ("p", "o", 0, 0, "section", "", False)]
    nodes = spark.createDataFrame(rows, NODE)
    assert {tuple(r) for r in R.tree_errors(nodes).collect()} == {(i, "cycle") for i in ("a", "b", "c", "under", "own")} | {("o", "orphan"), ("p", "orphan")}
    assert {r.node_id for r in R.with_paths(nodes).collect()} == {f"n{k}" for k in range(5)}


def test_structure_edits_keep_deep_nodes(spark):
    nodes = spark.createDataFrame([("b", *r) for r in chain(12)], "book string, " + NODE)
    segments = spark.createDataFrame([("b", f"s{k}", f"n{k}", 0) for k in range(12)], "book string, segment_id string, node_id string, ord int")
    ops = spark.createDataFrame([("b", "skip", "n4", None)], "book string, op string, node_id string, value string")
    n, s, e = R.apply_structure_ops(nodes, segments, ops)
    assert {(r.node_id, r.depth, r.skip) for r in n.collect()} == {(f"n{k}", k, k >= 4) for k in range(12)}
    assert s.count() == 12 and e.count() == 0
    lost = nodes.union(spark.createDataFrame([("b", "x", "gone", 0, 1, "section", "x", False)], nodes.schema))
    n, _, e = R.apply_structure_ops(lost, segments, ops)
    assert n.count() == 12 and [(r.op, r.node_id) for r in e.collect()] == [("orphan", "x")]


def test_parents_by_depth_of_any_size(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.choice([*range(12), None])) for d in range(6) for p in range(60)]
    got = {(r.doc, r.pos): r.parent_pos for r in W.parent_from_depth(spark.createDataFrame(rows, "doc int, pos int, depth int"), "doc", "pos", "depth").collect()}
    by = {(d, p): x for d, p, x in rows}
    want = {(d, p): max((q for q in range(p) if by[d, q] is not None and by[d, q] < x), default=None) if x is not None else None for d, p, x in rows}
    assert got == want


def plain_matches(words, terms):
    """Leftmost-longest, by comparing every term at every place; terms: (id, src)."""
    cut = lambda w: w[:-1] if w.endswith("s") else w
    out, at = [], 0
    while at < len(words):
        fit = []
        for i, src in terms:
            t = src.split()
            w = words[at : at + len(t)]
            if len(w) == len(t) and w[:-1] == t[:-1] and cut(w[-1]) == cut(t[-1]):
                fit.append((len(src), i, len(t)))
        if fit:
            _, i, n = max(fit)
            out.append((i, at, at + n))
            at += n
        else:
            at += 1
    return out


def test_terms_of_one_to_twelve_words(spark):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice("xa xb xc xds xd".split()) for _ in range(rng.randint(0, 120)))) for k in range(40)]
    cut = lambda k, n: (lambda w, i: " ".join(w[i : i + n]))(texts[k][1].split(), rng.randint(0, 40))
    terms = {t for n in range(1, 13) for t in (cut(rng.randrange(40), n) for _ in range(4)) if len(t.split()) == n}
    terms |= {"xa xb xc xd xa xb xc xd xa", "xa xb xc xd", "xc xc xc xc xc xc xc xc xc xc xc xc xc xc xc xc xc never"}
    # One term for every form that only inflection tells apart, as the longest and then the greatest id wins.
    listed = list(enumerate(sorted(terms)))
    got = {}
    for r in M.match_terms(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed, "term_id long, src string")).collect():
        got.setdefault(r.doc_id, []).append((r.term_id, r.start, r.end))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {k: m for k, t in texts if (m := plain_matches(t.split(), listed))}
    assert max(e - s for v in got.values() for _, s, e in v) > 8
    assert M.match_terms(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "term_id long, src string")).count() == 0


def test_examples_of_long_terms(spark):
    s = spark.createDataFrame([(1, "One two three four five six seven."), (2, "Two three four.")], "place int, sentence string")
    terms = spark.createDataFrame([("one two three four five six",), ("two three four",), ("none",)], "key string")
    assert {r.key: len(r.examples) for r in M.example_sentences(terms, s).collect()} == {"one two three four five six": 1, "two three four": 2}


def plain_dice(x, y):
    from collections import Counter

    a, b = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (x.replace(" ", ""), y.replace(" ", "")))
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if sum((a & b).values()) else 0


@pytest.mark.parametrize("threshold", (0.3, 0.8, 0.9, 1.0))
def test_similar_pairs_are_all_pairs_over_the_threshold(spark, threshold):
    rng = random.Random(9)

    def title():
        t = "".join(rng.choice("aab c") for _ in range(rng.randint(0, 25)))
        return t

    base = [title() for _ in range(40)]
    left = [(k % 2, k, base[k % 40] if k % 3 else title()) for k in range(80)]
    right = [(k % 2, k, base[(7 * k) % 40] + rng.choice(("", "", "a", "bc"))) for k in range(80)]
    got = {(r.lid, r.rid): r.score for r in J.similar_pairs(spark.createDataFrame(left, "doc int, lid int, title string"), spark.createDataFrame(right, "doc int, rid int, title string"), ["doc"], threshold).collect()}
    want = {(a, b): s for d, a, x in left for e, b, y in right if d == e and (s := plain_dice(x, y)) >= threshold}
    assert got == want


def test_superscripts_of_large_hosts(spark):
    lines = spark.createDataFrame([(1, 0, 1, 90.0, 100.0, 0.0, 200.0), (1, 0, 2, 20.0, 50.0, 190.0, 200.0), (1, 0, 3, 10.0, 97.0, 50.0, 90.0)], "doc_id int, page int, id int, size double, y double, x0 double, x1 double")
    assert {(r.item, r.host) for r in J.superscript_hosts(lines).collect()} == {(2, 1), (3, 1)}


def test_roman_labels(spark):
    pages = spark.createDataFrame([(1, p) for p in (3, 8, 39, 89, 399, 443, 899, 1993)] + [(1, 2100), (1, 2101)], "doc_id int, page int")
    printed = spark.createDataFrame([(1, 2100, "1"), (1, 2101, "2")], "doc_id int, page int, printed string")
    got = {r.page: r.label for r in L.infer_page_labels(pages, printed).collect()}
    assert got == {3: "iv", 8: "ix", 39: "xl", 89: "xc", 399: "cd", 443: "cdxliv", 899: "cm", 1993: "mcmxciv", 2100: "1", 2101: "2"}


def ranked(frame):
    return sorted((r.query_id, r.rank, r.seg_id, r.score) for r in frame.collect())


def test_stored_index_gives_what_counting_all_texts_gives(spark, sf):
    every = docs(spark, sf).withColumnRenamed("source", "section")
    index = I.write_index(every, new_path(spark, "t"), keep=["section"], chunk_texts=32)
    assert index.n == every.count()
    more = asked(spark).union(every.where("seg_id % 17 = 0").select((F.col("seg_id") + 100).cast("int"), F.substring("text", 1, 200)))
    for k in (1, 10):
        assert ranked(index.search(more, k)) == ranked(S.bm25_search(every, more, k))
    own = more.withColumn("section", F.lit("src1"))
    hidden = S.bm25_search(every, more, 2).select("query_id", "seg_id")
    assert ranked(index.search(own, 5, hidden, "section")) == ranked(S.bm25_search(every, own, 5, exclude=hidden, apart="section"))
    plan = index.blocks(F.col("term").isin(["th", "la"])).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "postings" not in plan


def test_deltas_change_add_and_remove(spark, sf):
    every = docs(spark, sf).select("seg_id", "text")
    before = every.where("seg_id % 5 <> 1").withColumn("text", F.when(F.col("seg_id") % 5 == 2, F.lit("thane thane other words")).otherwise(F.col("text")))
    index = I.write_index(before, new_path(spark, "t"), chunk_texts=64)
    index = I.update_index(index, every.where("seg_id % 10 in (1, 2, 7)"), every.where("seg_id % 10 = 3").select("seg_id"))
    index = I.update_index(index, every.where("seg_id % 10 in (6, 7)"))
    index = I.update_index(index, every.limit(0), every.where("seg_id % 10 = 9").select("seg_id"))
    now = every.where("seg_id % 10 not in (3, 9)")
    fresh = I.write_index(now, new_path(spark, "t"))
    assert (index.n, index.words) == (fresh.n, fresh.words)
    row = lambda r: (r.term, r.seg_id, r.tf, r.length)
    assert sorted(map(row, index.postings().collect())) == sorted(map(row, fresh.postings().collect()))
    assert ranked(index.search(asked(spark))) == ranked(S.bm25_search(now, asked(spark)))
    assert I.open_index(spark, index.path).n == index.n


def drained(spark, stream, path):
    name = "d" + path.rsplit("-", 1)[-1]
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q, spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


EVENT = "session long, seq long, ts timestamp, type string, text string"


def at(s):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)


def test_first_and_idle_timeouts(spark, rocks):
    rows = [(1, 0, 0, "start"), (1, 1, 5, "delta"), (1, 2, 49, "delta"), (1, 3, 60, "done"), (1, 4, 61, "delta")]  # passes, and nothing after its end
    rows += [(2, 0, 0, "start"), (2, 1, 31, "delta")]  # the first delta comes too late
    rows += [(3, 0, 0, "start"), (3, 1, 20, "delta"), (3, 2, 66, "done")]  # idle for too long; the delta stays
    rows += [(4, 0, 0, "start"), (4, 1, 10, "error"), (4, 2, 11, "delta")]
    rows += [(5, 0, 0, "start")]  # never answers
    rows += [(6, 0, 100, "delta")]  # open, and in time
    rows += [(7, 0, 0, "delta"), (7, 1, 45, "delta"), (7, 2, 90, "done")]  # at the limit, not beyond
    rows += [(8, 0, 120, "start"), (8, 1, 121, "done")]
    frame = spark.createDataFrame([(s, n, at(t), k, k[:1]) for s, n, t, k in rows], EVENT)
    clock = lambda t: int(at(t).timestamp() * 1_000_000)
    want = {(1, 1, clock(5), "delta", None), (1, 2, clock(49), "delta", None), (1, 3, clock(60), "done", None), (2, 1, clock(30), "error", "TIMEOUT"), (3, 1, clock(20), "delta", None), (3, 2, clock(65), "error", "TIMEOUT")}
    want |= {(4, 1, clock(10), "error", None), (5, 1, clock(30), "error", "TIMEOUT"), (6, 0, clock(100), "delta", None), (7, 0, clock(0), "delta", None), (7, 1, clock(45), "delta", None), (7, 2, clock(90), "done", None), (8, 1, clock(121), "done", None)}
    row = lambda r: (r.session, r.seq, r.t, r.type, r.code)
    assert sorted(map(row, ST.with_timeouts(frame).collect()), key=str) == sorted(want, key=str)
    path = new_path(spark, "in")
    for lo in range(0, 130, 15):
        frame.where((F.unix_timestamp("ts") - int(at(0).timestamp())).between(lo, lo + 14)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _, got = drained(spark, ST.with_timeouts(stream), new_path(spark, "c"))
    assert sorted(map(row, got), key=str) == sorted(want, key=str)


def test_states_end(spark, rocks):
    """Requests of keys that never come back, then one two days later: of the states only its own is left."""
    path = new_path(spark, "in")
    first = spark.createDataFrame([(k, k, at(k)) for k in range(40)], "event_id long, key long, ts timestamp")
    later = spark.createDataFrame([(100 + j, 99, at(2 * 86_400 + 1200 * j)) for j in range(2)], "event_id long, key long, ts timestamp")
    for part in (first, later.where("event_id = 100"), later.where("event_id = 101")):
        part.coalesce(1).write.mode("append").parquet(path)
    for job in (lambda s: ST.rolling_quota(s, 2, 4), lambda s: ST.admit_under_quota(s, 2, 4)):
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path)
        where = new_path(spark, "c")
        _, rows = drained(spark, job(stream), where)
        assert len(rows) == 42
        left = spark.read.format("statestore").option("path", where).option("stateVarName", "times").load()
        assert {r.key.key for r in left.select("key").collect()} == {99}


def test_first_mention_texts_over_the_table(spark, sf):
    """Notes put in and taken out by plain string work, from the matches that JOIN5's own tests hold."""
    import regex

    from vellumspark.queries.terms import noted

    segments, terms = noted(spark, sf)
    texts = {r.segment_id: r.text for r in segments.collect()}
    known = {r.term_id: r for r in terms.collect()}
    found = M.match_terms(segments.select("segment_id", "text"), terms.select("term_id", F.col("tgt").alias("src")), "segment_id").collect()
    word = regex.compile(M.WORD_RUN)
    marks = []
    for r in found:
        text, t = texts[r.segment_id], known[r.term_id]
        end = [m.end() for m in word.finditer(text)][r.end - 1]
        end += len(regex.match(r"(?:\*{1,2}(?![\p{L}\p{N}]))?", text[end:])[0])
        note = regex.match(r"(?i)\s*\(\s*\*{0,2}" + r"\s+".join(map(regex.escape, t.src.split())) + r"(?:s|es)?\*{0,2}\s*\)", text[end:])
        marks.append((r.segment_id % 10, t.src.lower(), r.segment_id, r.start, end, note[0] if note else "", t))
    seen, edits = set(), {}
    for chapter, src, i, start, end, note, t in sorted(marks, key=lambda m: m[:4]):
        first = (chapter, src) not in seen and t.policy != "never"
        seen.add((chapter, src))
        if first and not note:
            edits.setdefault(i, []).append((end, 0, f" ({t.src})"))
        elif note and not first:
            edits.setdefault(i, []).append((end, len(note), ""))
    want = {}
    for i, text in texts.items():
        for at, gone, new in sorted(edits.get(i, []), reverse=True):
            text = text[:at] + new + text[at + gone :]
        want[i] = text
    got = {r.segment_id: r.text for r in M.first_mention_texts(segments, terms)[0].collect()}
    assert got == want
    assert any(gone for e in edits.values() for _, gone, _ in e) and any(new for e in edits.values() for _, _, new in e)


def plain_sentences(text):
    """The Unicode rules one place after the other, for what the tables hold."""
    import unicodedata

    import regex

    stop, end = ".\u2024\ufe52\uff0e", "!?\u061f\u06d4\u0964\u3002\uff01\uff1f\u203c\u2047\u2048\u2049"
    close = lambda x: unicodedata.category(x) in ("Ps", "Pe", "Pi", "Pf") or x in "\"'"
    space = lambda x: unicodedata.category(x) == "Zs" or x in "\t\x0b\x0c"
    upper = lambda x: unicodedata.category(x) in ("Lu", "Lt")
    lower = lambda x: unicodedata.category(x) == "Ll"
    para = "\n\r\x85\u2028\u2029"
    out, start, k = [], 0, 0

    def cut(at):
        nonlocal start
        out.append(text[start:at])
        start = at

    while k < len(text):
        x = text[k]
        if x in para:
            k += 2 if text[k : k + 2] == "\r\n" else 1
            cut(k)
            continue
        if x not in stop + end:
            k += 1
            continue
        j = k + 1
        while j < len(text) and close(text[j]):
            j += 1
        closed = j
        while j < len(text) and space(text[j]):
            j += 1
        nxt = text[j] if j < len(text) else None
        ok = True
        if x in stop and closed == j == k + 1 and nxt is not None:
            ok = not unicodedata.category(nxt) == "Nd" and not (upper(nxt) and k and (upper(text[k - 1]) or lower(text[k - 1])))
        if ok and x in stop:
            m = j
            while m < len(text) and not unicodedata.category(text[m]).startswith("L") and text[m] not in para + stop + end:
                m += 1
            ok = not (m < len(text) and lower(text[m]))
        if ok and nxt is not None and nxt in ",-:;\u060c\u2013\u2014\u3001" + stop + end:
            ok = False
        k = j if ok else k + 1
        if ok:
            cut(j)
    cut(len(text))
    return [t for t in (regex.sub(r"^[\p{Z}\s\x85\ufeff]+|[\p{Z}\s\x85\ufeff]+$", "", x) for x in out) if t]


def test_sentences_by_the_unicode_rules(spark, sf):
    from vellumspark.functions import text as T

    fixed = {
        "One idea. Another one? Yes!": ["One idea.", "Another one?", "Yes!"],
        "این یک جمله است. آیا این دومی است؟ بله.": ["این یک جمله است.", "آیا این دومی است؟", "بله."],
        "It costs 3.5 euros. The U.S.A. is approx. five (hours) away.": ["It costs 3.5 euros.", "The U.S.A. is approx. five (hours) away."],
        'He said "Stop!" Then he left.\nNew line': ['He said "Stop!"', "Then he left.", "New line"],
        "What?! No... well, yes.": ["What?!", "No... well, yes."],
        "Wait!, he said": ["Wait!, he said"],
        "": [],
        " \n ": [],
    }
    frame = spark.createDataFrame([(t,) for t in fixed], "t string")
    assert {r.t: r.s for r in frame.select("t", T.sentence_segments(F.col("t")).alias("s")).collect()} == fixed
    greek = spark.createDataFrame([("Τι είναι; Ναι.",)], "t string").select(T.sentence_segments(F.col("t"), "el").alias("a"), T.sentence_segments(F.col("t")).alias("b")).first()
    assert greek.a == ["Τι είναι;", "Ναι."] and greek.b == ["Τι είναι; Ναι."]
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", T.sentence_segments(F.col("text")).alias("s")).collect()
    assert all((r.s or []) == plain_sentences(r.text or "") for r in rows) and max(len(r.s or []) for r in rows) > 5


def test_places_over_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), "id").repartition(7)
    got = [(r.x, r.place) for r in W.numbered(rows, [F.desc("x")]).collect()]
    assert sorted(got, reverse=True) == [(x, k + 1) for k, x in enumerate(sorted((r.x for r in rows.collect()), reverse=True))]
    assert W.numbered(rows.limit(0), ["x"]).count() == 0


def test_the_feed_goes_on_where_it_stopped(spark):
    path, where = new_path(spark, "feed"), new_path(spark, "c")
    rows = spark.range(1, 1201).select("id", F.concat(F.lit("b"), F.col("id") % 3).alias("book"))
    rows.repartition(3).write.parquet(path)
    calls = []

    def run():
        q = ST.consume_changes(ST.change_feed(spark, path), "book", lambda df, i: calls.append((i, sorted(r.book for r in df.collect()))), where).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert calls == [(k, ["b0", "b1", "b2"]) for k in range(3)]
    spark.createDataFrame([(1201, "late"), (1202, "later")], "id long, book string").write.mode("append").parquet(path)
    run()
    assert calls[3:] == [(3, ["late", "later"])]
    run()
    assert len(calls) == 4


def test_sessions_are_forgotten(spark, rocks):
    """Ended and open sessions of the first day; on the third only the newest one's mark is left."""
    path, where = new_path(spark, "in"), new_path(spark, "c")
    day = [(s, n, at(s + n), k, k) for s in range(6) for n, k in enumerate(("delta", "done") if s % 2 else ("delta",))]
    for part in (day, [(50, 0, at(2 * 86_400), "delta", "x")], [(51, 0, at(2 * 86_400 + 1200), "done", None)]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    _, rows = drained(spark, ST.assemble_answers(stream), where)
    assert {(r.session, r.answer, r.ok) for r in rows} == {(s, "delta", True) for s in (1, 3, 5)} | {(51, "", True)}
    for name, left in (("text", {50}), ("ended", {51})):
        state = spark.read.format("statestore").option("path", where).option("stateVarName", name).load()
        assert {r.key[0] for r in state.select("key").collect()} == left
