"""Cases of the round's advice: what the operators and stages once left undone."""

from collections import Counter

import pytest

from tests.llm.test_operators import LOWER, WORD, low, made_up, table


def without_runs(rows, size, lone_words):
    """(doc_id, text) after deletion of runs of ``size`` lines, and of single lines of ``lone_words`` words, seen earlier."""
    seen, texts = set(), {}
    for i, t in sorted({(low(i), t or "") for i, t in rows}):
        lines = t.split("\n")
        at = [k for k, line in enumerate(lines) if WORD.search(line)]
        places = [at[s : s + size] for s in range(len(at) - size + 1)] + [[k] for k in at if size > 1 and len(WORD.findall(lines[k])) >= lone_words]
        gone = set()
        for place in places:
            w = tuple(lines[k] for k in place)
            if w in seen:
                gone |= set(place)
            seen.add(w)
        texts[i, t] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return Counter((i, None if t is None else texts[low(i), t]) for i, t in rows)


@pytest.mark.parametrize("size,lone_words", [(2, 20), (3, 1), (1, 50)])
def test_lone_lines(spark, size, lone_words):
    from sealbook.llm.line_dedup import without_repeated_runs

    rows = made_up(5)
    found = without_repeated_runs(table(spark, rows), size, lone_words)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == without_runs(rows, size, lone_words)


def test_stage_drops_a_passage_on_one_line(spark):
    import corpus_pipeline

    passage, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"s{k}" for k in range(49))
    rows = [(1, f"a b\n{passage}\nc d"), (2, f"e f\n{passage}\ng h"), (3, passage), (4, f"i j\n{short}"), (5, f"{short}\nk l"), (None, None)]
    found = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), "").collect()}
    assert found == dict(rows) | {2: "e f\ng h", 3: ""}


def one_of_near_copies(rows, words, percent):
    """(doc_id, text) of the smallest (doc_id, text) of each group; nodes are the distinct pairs of both."""

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    nodes = sorted(set(rows), key=lambda x: (low(x[0]), x[1] is not None, x[1] or ""))
    sets = [shingles(t) for _, t in nodes]
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return Counter(node for k, node in enumerate(nodes) if find(k) == k)


def test_stage_keeps_one_of_near_copies(spark):
    """Null ids, one id on different texts, repeated rows, null and empty texts."""
    import corpus_pipeline

    rows = made_up(7, n=30)
    texts = [t for _, t in made_up(8, n=14)[:14]]
    prose = " ".join(f"v{k}" for k in range(60))
    rows += [(None, t) for t in texts] + [(17, t) for t in texts[3:9]] + [(None, None), (None, None), (None, ""), (None, " "), (300, "")]
    rows += [(None, prose + " b"), (None, prose + " a"), (900, prose), (901, prose + " b c"), (902, texts[0]), (903, texts[1])]
    found = corpus_pipeline.keep_one_of_near_copies(spark, table(spark, rows), "")
    assert found.columns == table(spark, rows[:1]).columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == one_of_near_copies(rows, 5, 80)


def test_unmarked_pages_keep_their_short_paragraphs():
    from sealbook.llm.html_text import main_text

    long = ("This is the long text of the page and it is about the things that are in it. " * 4).strip()
    mid = "This is a paragraph of the page and it is not a long one, but it is prose as well."
    menu = "<p><a href=a>Products</a></p>"
    p = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    assert main_text(f"<div>{p(mid, long, mid)}</div>") == "\n".join([mid, long, mid])
    assert main_text(f"<div>{p('Short one.', long, 'The end.')}</div>") == "\n".join(["Short one.", long, "The end."])
    assert main_text(f"{menu}<div>{p(mid, mid)}<h2>Then</h2>{p(mid)}</div>{menu}") == "\n".join([mid, mid, "Then", mid])
    assert main_text(p("It is what it is.", "And that is all of it.")) == "It is what it is.\nAnd that is all of it."
    # The nearer neighbour counts; between two equally near ones that differ, prose stays and a scrap goes.
    assert main_text(f"{menu}{p('Scrap one.', 'Scrap two.', 'Scrap three.', long)}") == f"Scrap three.\n{long}"
    assert main_text(f"{menu}{p(mid, long)}") == f"{mid}\n{long}"
    assert main_text(f"{menu}{p('Scrap.', long)}") == long
    assert main_text(menu) == main_text(p("Imprint", "Log in")) == ""


def test_wrappers_by_name_keep_their_article():
    from sealbook.llm.html_text import main_text

    long = ("This is the long text of the page and it is about the things that are in it. " * 4).strip()
    story = f"<article><div class='entry-header'><h1>Title</h1></div><p>{long}</p></article>"
    for name in ("class='layout with-sidebar'", "class='site has-sidebar'", "id='page' class='search-enabled'", "class='sidebar'", "class='page--no-ads layout--sidebar'"):
        assert main_text(f"<div {name}>{story}<div class='sidebar-inner'><p>{long} Elsewhere.</p></div></div>") == f"Title\n{long}", name
        if name != "class='sidebar'":
            assert main_text(f"<div {name}><p>{long}</p></div>") == long, name
    for name in ("ad", "top-ad", "cookie-notice", "side-bar", "main side-bar-left", "comment-list", "comments-area", "related-posts", "widget_2", "sidebar--left", "social share-buttons"):
        other = f"<div class='{name}'><p>{long} Elsewhere.</p></div>"
        assert main_text(f"<div><p>{long}</p>{other}</div>") == main_text(f"<main><p>{long}</p>{other}</main>") == long, name
    comments = "<div id='comments'>" + f"<article><p>{long} I say.</p></article>" * 3 + "</div>"
    assert main_text(f"<article><p>{long * 3}</p>{comments}</article>") == long * 3
    assert main_text(f"<main><p>{long * 4}</p>{comments}</main>") == long * 4


def test_story_beside_marked_teasers():
    from sealbook.llm.html_text import main_text

    long = ("This is the long text of the page and it is about the things that are in it. " * 4).strip()
    teasers = "".join(f"<article><a href={k}>Another story of the day</a></article><article><p>Teaser {k}</p></article>" for k in range(3))
    text = main_text(f"<div><h1>Title</h1><p>{long}</p><p>{long}</p></div><div>{teasers}</div>")
    assert text.startswith(f"Title\n{long}\n{long}") and "Another story" not in text
    assert main_text(f"<article><p>{long}</p></article><div><p>{long}</p></div>") == long


def test_nodes_of_equal_hashes_are_told_apart(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "HASH_BITS", 3)
    rows = made_up(9) + [(None, "a b"), (None, "a b"), (1, None)]
    found = corpus_pipeline.numbered(table(spark, rows)).collect()
    pairs = {(r.id, r.row.text) for r in found}
    assert len(found) == len(rows)
    assert len(pairs) == len({r.node for r in found}) == len({(r.id, r.row.text, r.node) for r in found})
    kept = corpus_pipeline.keep_one_of_near_copies(spark, table(spark, rows), "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == one_of_near_copies(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.LEAST_PERCENT)


def test_near_duplicates_leaves_only_small_tables(spark, tmp_path, monkeypatch):
    from sealbook.llm.jaccard import near_duplicates
    from sealbook.operators import durable

    made = iter(range(1000))
    monkeypatch.setattr(durable, "shared_folder", lambda spark: str(tmp_path / f"t{next(made)}"))
    assert near_duplicates(table(spark, made_up(9)), words=3, num=80).count()
    left = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
    assert sorted(left) == [["doc_id", "n_shingles", "component_id"]] + 2 * [["node", "component"]]


def test_pii_learns_from_all_documents(spark):
    """Secrets in the last of many documents by hash teach the trees as well as others, and all candidates are counted."""
    from pyspark.sql import functions as F

    from sealbook.llm.pii import _counted, train

    plain = spark.range(12_000).select(F.concat(F.lit("room 20 30 "), F.col("id").cast("string"), F.lit(" seats")).alias("text"))
    secret = spark.range(1_000).select(F.concat(F.lit('token = "'), F.substring(F.md5(F.col("id").cast("string")), 1, 24), F.lit('"')).alias("text"))
    h = F.xxhash64("text")
    docs = plain.where(h < 0).limit(4_300).unionByName(secret.where(h > 0).limit(300)).withColumn("doc_id", F.monotonically_increasing_id()).localCheckpoint()
    assert docs.count() == 4_600
    by_kind = {r.y: r.n for r in _counted(docs).groupBy("y").agg(F.sum("n").alias("n")).collect()}
    assert by_kind[True] >= 280 and by_kind[False] >= 4_300
    model = train(docs)
    assert model is not None and model[1] < 1
