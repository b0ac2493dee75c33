"""Queries that must do the whole job, against plain versions that share no code or SQL with them."""

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellumspark import queries as _registered  # noqa: F401
from vellumspark import registry
from vellumspark.sources import adapters as A

from .test_sql import con, rows  # noqa: F401

INLINE = set("a abbr b br cite code em i mark small span strong sub sup u".split())


class Blocks(HTMLParser):
    """Text of every heading, paragraph and list item, up to the next tag that is not inline."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found, self.open = [], None
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if self.open and self.open[1]:
            self.found.append(tuple(self.open))
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "br" and self.open:
            self.open[1] += " "
        elif tag not in INLINE:
            self.end()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"):
                self.open = [tag, ""]

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end()

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_blocks_keep_every_paragraph(spark, sf):
    pages = A.table(spark, sf, "pages").collect()
    want = {(p.page_id, k, text) for p in pages for k, (_, text) in enumerate(Blocks(p.html).found)}
    got = A.blocks(spark, sf).collect()
    assert {(r.page_id, r.ord, r.text) for r in got} == want and len(got) == len(want)
    # No <p> of these pages is empty, so each plain occurrence is a block.
    assert sum(r.type == "paragraph" for r in got) == sum(p.html.count("<p>") for p in pages)
    exported = registry.QUERIES["src8_export_bundle"](spark, sf).collect()
    assert {(r.page_id, r.ord, r.src) for r in exported} == want


def test_blocks_with_attributes_and_inline_tags(spark, tmp_path):
    page = '<script>"<p>no"</script><!-- <p>no --><H2 id="a>b">One <i>two</i></H2><p class=x><b>three<br>four</b> 1 < 2</article>no<ul><li><div>five</div><li data-k=\'<\'>si<a href="#">x</a></ul><p></p><pre>no</pre>'
    pq.write_table(pa.table({"page_id": [1], "url": ["u"], "html": [page]}), f"{tmp_path}/pages.parquet")
    got = [(r.type, r.level, r.text) for r in A.blocks(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("heading", 2, "One two"), ("paragraph", None, "three four 1 &lt; 2"), ("list_item", None, "five"), ("list_item", None, "six")]


@pytest.mark.parametrize("name", sorted(k for k, v in registry.ORACLES.items() if A.BLOCKS in v))
def test_queries_over_whole_blocks(spark, sf, con, name):  # noqa: F811
    """The SQL of a query over the blocks that the plain parser finds, in place of the cut ones."""
    kinds = {"p": "paragraph", "li": "list_item"}
    found = [(p.page_id, k, kinds.get(tag, "heading"), int(tag[1]) if tag[0] == "h" else None, text) for p in A.table(spark, sf, "pages").collect() for k, (tag, text) in enumerate(Blocks(p.html).found)]
    whole = pd.DataFrame(found, columns=["page_id", "ord", "type", "level", "text"]).astype({"ord": "int32", "level": "Int32"})
    con.register("whole_blocks", whole)
    sql = registry.ORACLES[name].replace(A.BLOCKS, "blk AS (SELECT * FROM whole_blocks)")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).df())


def reading_order(lines):
    """Positions of the (ord, y, x0, x1) of one page, by walking down the page: {ord: (column, position)}."""
    lines = sorted(lines, key=lambda r: (r[1], r[2]))
    low, high = min(r[2] for r in lines), max(r[3] for r in lines)
    mid, gutter = (low + high) / 2, (high - low) * 0.02
    side = {r[0]: 1 if r[3] <= mid + gutter else 2 if r[2] >= mid - gutter else 0 for r in lines}
    share = [sum(v == k for v in side.values()) / len(lines) for k in (1, 2)]
    if len(lines) < 6 or min(share) < 0.25:
        return {r[0]: (0, k + 1) for k, r in enumerate(lines)}
    out, columns = [], ([], [])
    for r in lines:
        if side[r[0]]:
            columns[side[r[0]] - 1].append(r[0])
        else:
            out += columns[0] + columns[1] + [r[0]]
            columns = ([], [])
    out += columns[0] + columns[1]
    return {o: (side[o], k + 1) for k, o in enumerate(out)}


def test_reading_order_of_all_lines(spark, sf):
    pages, found = {}, {}
    for r in A.lines(spark, sf).collect():
        pages.setdefault((r.doc_id, r.page), []).append(r)
    for (doc, page), rows_ in pages.items():
        wide, at = max(r.x1 - r.x0 for r in rows_) + 20, []
        for r in rows_:
            x0, x1 = r.x0, r.x1
            if doc % 2 == 0 and r.ord % 10 == 0:
                x1 = x0 + 2 * wide
            elif doc % 2 == 0 and r.ord % 2 == 1:
                x0, x1 = x0 + 1.1 * wide, x1 + 1.1 * wide
            at.append((r.ord, r.y, x0, x1))
        found[doc, page] = reading_order(at)
    want = sorted((doc, o, *v) for (doc, _), page in found.items() for o, v in page.items())
    got = sorted((r.doc_id, r.ord, r.column, r.pos) for r in registry.QUERIES["win10_reading_order"](spark, sf).collect())
    assert got == want and {r[2] for r in got} == {0, 1, 2}
    assert len(got) == A.segments(spark, sf).count()


def _texts(spark, sf):
    """Per segment: status, draft, final, incoming text, by plain rules over whole texts."""
    docs = {r.doc_id: r for r in A.table(spark, sf, "documents").collect()}
    out = {}
    for r in A.table(spark, sf, "labels").collect():
        k, text = r.doc_id, docs[r.doc_id].text
        status = "flagged" if r.toxic == 1 else "queued" if r.quality == 0 else "user_edited" if k % 5 == 0 else "drafted" if k % 3 == 0 else "final"
        out[k] = (status, text, text + " (edited)" if k % 2 == 0 else None)
    return docs, out


def test_upserts_compare_whole_texts(spark, sf):
    docs, old = _texts(spark, sf)
    merged, changed = set(), set()
    for k, doc in docs.items():
        new = doc.text + (" (new)" if k % 3 == 0 else "")
        if k not in old:
            merged.add((k, "drafted", new, None, 1))
            continue
        status, draft, final = old[k]
        before = final or draft
        if status == "user_edited":
            merged.add((k, status, before, new if new != before else None, 2))
        else:
            merged.add((k, "drafted", new, None, 2))
            if new != before:
                changed.add((k, before, new))
    got = registry.QUERIES["src4_upsert_translations"](spark, sf).collect()
    assert {(r.segment_id, r.status, r.text, r.suggestion, r.version) for r in got} == merged and len(got) == len(merged)
    got = registry.QUERIES["src4_upsert_revisions"](spark, sf).collect()
    assert {(r.segment_id, r.before, r.after) for r in got} == changed
    # Revisions whose texts are alike in the first forty characters, and texts that did not change.
    assert any(a[:40] == b[:40] for _, a, b in changed) and len(changed) < len(old)
    imported = registry.QUERIES["job7_import_results"](spark, sf).collect()
    assert len(imported) == len(docs) and all(r.version == 1 + (r.segment_id in old) for r in imported)
    shown = registry.QUERIES["join1_segment_text"](spark, sf).collect()
    assert {(r.segment_id, r.tgt) for r in shown} == {(k, final or draft) for k, (status, draft, final) in old.items() if status != "queued"}


@pytest.mark.parametrize("name", sorted(k for k, v in registry.ORACLES.items() if A.TRANSLATIONS in v and not k.startswith("src4")))
def test_queries_over_whole_translations(spark, sf, con, name):  # noqa: F811
    """The SQL of a query over translations with whole texts, in place of the prefixes."""
    docs, old = _texts(spark, sf)
    toxic = {r.doc_id: r.toxic for r in A.table(spark, sf, "labels").collect()}
    whole = [(k, docs[k].lang, status, k % 10 / 10, draft, final, int(toxic[k] == 1), 1) for k, (status, draft, final) in old.items()]
    con.register("whole_texts", pd.DataFrame(whole, columns=["segment_id", "lang", "status", "confidence", "draft", "final", "n_flags", "version"]).astype({"version": "int32"}))
    sql = registry.ORACLES[name].replace(A.TRANSLATIONS, "tr AS (SELECT * FROM whole_texts)")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).df())


def test_retrieval_context_asks_every_user_turn_whole(spark, sf):
    from vellumspark.queries import jobs

    turns = {(f"{r.conv_id}:{r.turn}", r.text) for r in A.table(spark, sf, "conversations").where("role = 'user'").collect()}
    asked = jobs._questions(spark, sf).collect()
    assert {(r.query_id, r.query) for r in asked} == turns and len(asked) == len(turns)
    got = registry.QUERIES["job9_retrieval_context"](spark, sf).collect()
    sections = {r.source for r in A.table(spark, sf, "documents").collect()}
    assert {r.query_id for r in got} >= {r.query_id for r in asked if r.section in sections}


def emphasis(text, strong, em):
    text = re.sub(r"\*\*(?!\s)(.+?)(?<!\s)\*\*", strong, text, flags=re.A)
    return re.sub(r"\*(?![\s*])([^*]+?)(?<!\s)\*", em, text, flags=re.A)


def test_markup_of_every_document(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from vellumspark.functions import text as T

    docs = {r.doc_id: r.text for r in A.table(spark, sf, "documents").collect()}
    assert any("*" in t for t in docs.values())
    plain, html = {}, {}
    for k, text in docs.items():
        x = re.sub(r"\[\^[^\]\s]+\]|\[\[(?:fig|tab):[^\]\s]+\]\]", "", re.sub("`([^`]+)`", r"\1", text))
        plain[k] = emphasis(x, r"\1", r"\1")
        x = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        x = emphasis(re.sub("`([^`]+)`", r"<code>\1</code>", x), r"<strong>\1</strong>", r"<em>\1</em>")
        html[k] = re.sub(r"\[\^([^\]\s]+)\]", r"<sup>\1</sup>", x)
    table = A.table(spark, sf, "documents")
    assert {r.doc_id: r.plain for r in table.select("doc_id", T.strip_markup(F.col("text")).alias("plain")).collect()} == plain
    assert {r.doc_id: r.html for r in table.select("doc_id", T.markup_to_html(F.col("text")).alias("html")).collect()} == html


def shape(line):
    x = re.sub("[0-9]+", "#", line.lower())
    return re.sub(r"\s+", " ", re.sub(r"\b[ivxlcdm]{1,7}\b", "#", x, flags=re.A), flags=re.A).strip(" ")


def test_header_patterns_of_every_line(spark, sf):
    from vellumspark.operators import aggregates as G

    count, pages, total = Counter(), {}, {}
    for r in A.lines(spark, sf).collect():
        count[shape(r.text)] += 1
        total.setdefault(r.doc_id, set()).add(r.page)
        zone = "top" if r.y <= 48 + r.size else "bottom" if r.y >= 552 else None
        if zone and shape(r.text):
            pages.setdefault((r.doc_id, zone, shape(r.text)), set()).add(r.page)
    assert any(not k.isascii() for k in count)
    got = registry.QUERIES["txt8_header_pattern"](spark, sf).collect()
    assert {r.pattern: r.n for r in got} == count and len(got) == len(count)
    repeated = {(*k, len(v)) for k, v in pages.items() if len(v) >= 2 and len(v) >= 0.25 * len(total[k[0]])}
    assert {(r.doc_id, r.zone, r.pattern, r.pages) for r in G.repeating_margin_lines(A.lines(spark, sf), 600.0).collect()} == repeated


def test_structure_keeps_sharp_s(spark, sf):
    got = {r.segment_id: r.text for r in registry.QUERIES["src9_save_structure"](spark, sf).collect()}
    want = {f"{p.page_id}:{k}": text.upper() if k % 2 == 0 else text for p in A.table(spark, sf, "pages").collect() for k, (_, text) in enumerate(Blocks(p.html).found)}
    assert got == want and any("ß" in t for t in got.values())


def test_patches_reach_every_term(spark):
    sf = "/root/testdata/sf0.01"
    old = {r.p_partkey: (r.p_name, r.p_brand) for r in A.table(spark, sf, "part").collect()}
    names = {k: f"{n}{k}" for k, (n, _) in old.items()}
    taken = {}
    for k, n in names.items():
        taken.setdefault(n.lower(), set()).add(k)
    want = {}
    for k, (name, brand) in old.items():
        src = name.upper() + "0" if k % 4 == 0 else f"new{k}"
        clash = k % 2 == 0 and taken.get(src.lower(), set()) - {k}
        want[k] = (src if k % 2 == 0 and not clash else names[k], None if k % 3 == 0 and not clash else brand)
    got = {r.term_id: (r.src, r.tgt) for r in registry.QUERIES["src14_patch_terms"](spark, sf).collect()}
    assert got == want and max(old) > 1000


def test_quality_codes_of_every_pair(spark, tmp_path):
    talk = {
        1: ("See `code` here", "See here", {"markup"}),
        2: ("Plain words", "go on go on go on go on", {"repetition"}),
        3: ("Plain words", "Other words", set()),
        4: ("Room 5", "Room", {"numbers"}),
        5: ("Visit https://a.example/b [^1]", "Visit", {"markup"}),
        7: ("`x` 9", "gone", {"markup", "numbers"}),
        8: ("Room 5 at https://a.example/b", "Room 5 at https://a.example/b", set()),
    }
    flat = [(k, t, ("user", "assistant")[t], talk[k][t]) for k in talk for t in (0, 1)]
    pq.write_table(pa.table({n: list(v) for n, v in zip(("conv_id", "turn", "role", "text"), zip(*flat))}), f"{tmp_path}/conversations.parquet")
    from vellumspark.plans import quality as Q

    got = Counter((r.conv_id, r.code) for r in Q.quality_check(A.pairs(spark, str(tmp_path)), ["conv_id", "turn"], "en").collect())
    assert got == Counter((k, c) for k, (_, _, codes) in talk.items() for c in codes)
    # Batches divisible by five are never returned; batch 1 comes twice. The pair checks run on what was returned.
    got = Counter((r.batch_id, r.code) for r in registry.QUERIES["job6_validate_results"](spark, str(tmp_path)).collect())
    assert got == Counter([("1", "duplicate"), ("1", "markup"), ("2", "repetition"), ("4", "numbers"), ("5", "missing"), ("7", "markup"), ("7", "numbers")])


def test_terms_of_batches_and_contexts(spark, sf):
    """Which dictionary terms stand in the texts that a batch or a question shows, by plain word lists."""
    from vellumspark.queries import jobs, terms

    words = {r.src for r in terms.dictionary(spark, sf).collect()}

    def stem(w):
        x = re.sub("['’]s?$", "", w.lower())
        return x[:-3] + "y" if x.endswith("ies") and len(x) > 3 else re.sub("(?:es|s|e)$", "", x)

    best = {}
    for w in words:
        best[stem(w)] = max(best.get(stem(w), ""), w, key=lambda x: (len(x), x))

    def held(text):
        return {best[stem(w)] for w in re.findall(r"(?:[^\W_]|['’-])+", text) if stem(w) in best}

    context = jobs.C.retrieval_context(jobs._questions(spark, sf), jobs._passages(spark, sf)).collect()
    want = {}
    for r in jobs._questions(spark, sf).collect():
        want.setdefault(r.query_id, set()).update(held(r.query))
    for r in context:
        want.setdefault(r.query_id, set()).update(held(r.text))
    got = {}
    for r in registry.QUERIES["job9_glossary_present"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.term_id)
    assert got == {k: v for k, v in want.items() if v} and got
    batches = {r.doc_id: r for r in jobs._batches(spark, sf).collect()}
    terms_of = {r.doc_id: r for r in registry.QUERIES["job8_batch_terms"](spark, sf).collect()}
    assert batches.keys() == terms_of.keys()
    docs = {r.doc_id: r.text.split("\n") for r in A.table(spark, sf, "documents").collect()}
    for k, b in batches.items():
        assert set(terms_of[k].glossary) == set().union(*(held(i.src) for i in b["items"]))
        first = min(int(v) - 10_000 * k for v in b.key_map.values())
        assert set(terms_of[k].introduced) == (set().union(*map(held, docs[k][:first])) if k % 3 == 0 else set())


def test_layout_loses_no_words(spark, sf):
    """Words of all blocks are those of the lines less running heads, but for hyphens at line ends; labels and nodes are whole."""
    from pyspark.sql import functions as F

    from vellumspark.operators import aggregates as G
    from vellumspark.operators import windows as W
    from vellumspark.queries import layout

    out, lines = layout.laid_out(spark, sf), A.lines(spark, sf).where("text <> ''")
    outline = lines.where("ord % 200 = 0 and trim(text) <> ''")
    ranges = W.chapter_ranges(outline.select("doc_id", "page"), lines.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count")))
    kept = {}
    for r in G.remove_headers_footers(lines, 600.0, outline.select("doc_id", F.col("text").alias("title")), ranges)[0].collect():
        kept[r.doc_id] = kept.get(r.doc_id, "") + r.text
    bare = lambda t: Counter(re.sub(r"[\s-]|[^\x00-\x7f]", "", t))
    shown = {}
    for r in out.segments.collect():
        shown[r.doc_id] = shown.get(r.doc_id, "") + r.text
    assert {k: bare(v) for k, v in shown.items() if bare(v)} == {k: bare(v) for k, v in kept.items() if bare(v)}
    nodes = {(r.doc_id, r.node_id) for r in out.nodes.collect()}
    assert {(r.doc_id, r.node_id) for r in out.segments.select("doc_id", "node_id").collect()} <= nodes
    assert out.labels.count() == A.lines(spark, sf).where("trim(text) <> ''").select("doc_id", "page").distinct().count()
    assert out.report.count() == len(shown)
