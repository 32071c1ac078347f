"""Each operator against a plain version of its definition, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, n_words long, toxic string, component_id string, id string, `odd name. here` string"


def table(spark, rows, kind=KIND):
    """Rows of (doc_id, text) with extra columns that operators use as names of their own."""
    return spark.createDataFrame([(i, t, -1, "x", "y", "z", "w") for i, t in rows], kind)


def made_up(seed, n=60, words=40):
    """Documents that share lines, passages and whole texts; with nulls, empty and very long texts, and repeated rows."""
    r = random.Random(seed)
    vocabulary = [a + b for a in "ba do ki lu me no".split() for b in "ra si to vu na".split()]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [prose(r.randint(3, 45)) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [r.choice(shared) if r.random() < 0.3 else prose(r.randint(1, words)) for _ in range(r.randint(1, 6))]
        rows.append((i * 3 % 101, "\n".join(lines)))
    for i in range(12):  # near and exact copies
        k, text = rows[r.randrange(n)]
        parts = text.split(" ")
        for _ in range(r.randint(0, 3)):
            parts[r.randrange(len(parts))] = r.choice(vocabulary)
        rows.append((200 + i, " ".join(parts)))
    return rows + [(300, None), (301, ""), (302, "  \t\n "), (303, "one two"), (304, "one  TWO"), (305, prose(9000)), (None, shared[0] + "\n" + shared[1]), rows[3], rows[3], (306, "ÀÉ " * 30), (307, "a " * 60)]


def low(i):
    return -1 if i is None else i


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return made_up(request.param)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def result(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(rows, docs, words, percent):
    from sealbook.llm.jaccard import near_duplicates

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [(low(i), shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    expected = Counter((i, len(shingles(t)), None if find(low(i)) == -1 else find(low(i))) for i, t in rows)
    assert result(near_duplicates(docs, words, percent, 100), "doc_id", "n_shingles", "component_id") == expected


def test_near_duplicates_of_a_large_group(spark):
    """A chain of texts that differ a little from the next, and many copies of one: all links are found."""
    from sealbook.llm.jaccard import near_duplicates

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 150])) for i in range(60)] + [(1000 + i, " ".join(words[:150])) for i in range(300)]
    found = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), 3, 90, 100).collect()}
    assert set(found.values()) == {0}


def test_parts_hold_enough(monkeypatch):
    """Two sets within the budget always share a key, whatever differs."""
    from fractions import Fraction

    from sealbook.llm.jaccard import bands, budget, part_keys

    r = np.random.default_rng(4)
    for percent in (50, 80, 90, 95):
        least = Fraction(percent, 100)
        starts = bands(least)
        for n in (5, 12, 40, 150, 900):
            a = r.integers(0, 1 << 62, n).astype(np.uint64)
            for grow in (0, 1):
                d = int(n * (1 - least) / least) if grow else int(n * (1 - least) / (1 + least)) * 2
                out = d if grow else d // 2
                b = np.concatenate([a if grow else a[out:], r.integers(0, 1 << 62, out).astype(np.uint64)])
                band_a, band_b = (int(np.searchsorted(starts, len(x), side="right")) - 1 for x in (a, b))
                scheme = min(band_a, band_b)
                assert max(band_a, band_b) - scheme <= 1
                if d := budget(int(starts[scheme + 1]), least):
                    assert set(part_keys(a, scheme, d)) & set(part_keys(b, scheme, d))


@pytest.mark.parametrize("size", [1, 2, 3])
def test_line_dedup(rows, docs, size):
    from sealbook.llm.line_dedup import line_dedup, without_repeated_runs

    seen, texts = {}, {}
    for i, t in sorted({(low(i), t or "") for i, t in rows}):
        lines = t.split("\n")
        at = [k for k, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        for s in range(len(at) - size + 1):
            w = tuple(lines[k] for k in at[s : s + size])
            if w in seen:
                gone |= set(at[s : s + size])
            seen.setdefault(w, (i, s))
        texts[i, t] = (len(at), len(gone), "\n".join(line for k, line in enumerate(lines) if k not in gone))
    expected = Counter((i, *texts[low(i), t or ""][:2], None if t is None else texts[low(i), t][2]) for i, t in rows)
    assert result(line_dedup(docs, size), "doc_id", "n_lines", "n_removed", "kept_text") == expected
    cleaned = without_repeated_runs(docs, size)
    assert cleaned.columns == docs.columns
    assert result(cleaned, "doc_id", "text", "toxic") == Counter((i, None if t is None else texts[low(i), t][2], "x") for i, t in rows)


@pytest.mark.parametrize("size,hot", [(5, 20_000), (5, 2), (20, 20_000)])
def test_substring_dedup(rows, docs, monkeypatch, size, hot):
    from sealbook.llm import substring_dedup as module

    monkeypatch.setattr(module, "HOT_ROWS", hot)
    seen, texts = set(), {}
    for i, t in sorted({(low(i), t or "") for i, t in rows}):
        w = WORD.findall(t)
        gone = set()
        for s in range(len(w) - size + 1):
            v = tuple(w[s : s + size])
            if v in seen:
                gone |= set(range(s, s + size))
            seen.add(v)
        texts[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    expected = Counter((i, *texts[low(i), t or ""]) for i, t in rows)
    assert result(module.substring_dedup(docs, size), "doc_id", "n_words", "n_removed", "kept_text") == expected


def test_simple8b_round_trip():
    from sealbook.llm.token_files import STRIDE, pack, unpack, unpack_range

    r = np.random.default_rng(1)
    for ids in ([], [0], [0] * 61, [2**60 - 1, 1, 2**31, 7], r.integers(0, 50_257, 5000), r.integers(0, 2, 4000), np.where(r.random(3000) < 0.05, 2**40, 3)):
        ids = np.array(ids, np.uint64)
        words = pack(ids)
        assert (unpack(words) == ids).all() and len(unpack(words)) == len(ids)
        counts = [len(unpack(words[k : k + 1])) for k in range(len(words))]
        offsets = np.concatenate([[0], np.cumsum(counts)])[:-1][::STRIDE]
        if len(ids) > 100:
            assert (unpack_range(words, offsets, 37, len(ids) - 11) == ids[37:-11]).all()


def test_token_files(spark, rows, docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from sealbook.llm.token_files import read_token_files, with_checksums, write_token_files

    odd = [(400, "a <|endoftext|> b"), (401, " leading and trailing "), (402, "two  spaces and  more \x1c x"), (403, "it's we'll 12 345 !?\r\n end")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(table(spark, rows + odd), str(tmp_path / "t"), Path(path).read_text())
    coder, start, expected = Tokenizer.from_file(path), 0, Counter()
    once = sorted((low(i), t or "") for i, t in rows + odd)
    totals = {}
    for i, t in once:
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        expected[None if i == -1 else i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
        totals[i] = totals.get(i, 0) + 1
    assert result(with_checksums(read_token_files(spark, str(tmp_path / "t"))), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_sentencepieces(spark, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from sealbook.llm.sentencepieces import decode, encode, load_vocabulary

    r = random.Random(8)
    more = [(500 + k, "".join(r.choice("abcdehinorstu  \n.é中▁😀\x01") for _ in range(r.randint(1, 150)))) for k in range(80)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), load_vocabulary(path)
    found = decode(encode(table(spark, rows + more), vocabulary), vocabulary)
    expected = Counter((i, tuple(model.encode(t or "")), (t or "").replace("▁", " ")) for i, t in rows + more)
    assert Counter((x.doc_id, tuple(x.ids), x.text) for x in found.collect()) == expected


def test_quality_base(spark, rows):
    from sealbook.llm.quality import LEAST_CONTENT, line_features, quality_rules, viterbi

    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows if i is not None] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    more = [(600, "aa | bb | ## cc\n" * 30), (601, "aa | bb | ## cc\n" * 3)]
    found = {(r.doc_id, r.n_words): r for r in quality_rules(table(spark, rows + more), labels).collect()}
    for i, t in rows + more:
        w = WORD.findall(t or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [line for line in (t or "").split("\n") if WORD.search(line)]
        got = found[i, len(w)]
        assert (got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (
            sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), len(covered))
        assert got.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert got.kept == (not got.base_failed and got.content_share >= LEAST_CONTENT)
    # Viterbi against all sequences.
    r = np.random.default_rng(2)
    for n in range(1, 8):
        e, c = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        score = lambda s: sum(e[i, x] for i, x in enumerate(s)) + sum(c[a, b] for a, b in zip(s, s[1:]))
        best = max((tuple(int(b) for b in f"{k:0{n}b}") for k in range(1 << n)), key=score)
        assert tuple(viterbi(e, c)) == best
    assert line_features([""])[0].shape[0] == 0


def test_pii_base(spark):
    from sealbook.llm.pii import base_spans, personal_data

    def plain(t):
        out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                out.append((m.start(), 2, "card", m.end()))
        out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return [(a, b, k) for a, _, k, b in sorted(out)]

    r = random.Random(6)
    texts = ["".join(r.choice("ab1.2@-+ 34()5%_") for _ in range(r.randint(0, 70))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 010-0199.", "x@y.z@q.r", "0300.1.1.1 and 255.255.255.0", "é😀 a@b.co"]
    for t in texts:
        assert base_spans(t) == plain(t)
    rows = list(enumerate(texts)) + [(None, None), (9000, ""), (9001, 'password = "d0c5f7a8b9e14c2286" here'), (9002, "9" * 5000 + "@" + "1." * 5000)]
    rows += [(10_000 + k, f'some words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and {k} more') for k in range(300)]
    got = {x.doc_id: x for x in personal_data(table(spark, rows)).collect()}
    for i, t in rows:
        base = [(s.start, s.end, s.kind) for s in got[i].base]
        assert base == plain(t or "") and set(got[i].base) <= set(got[i].spans)
    assert sum(any(s.kind == "secret" for s in got[10_000 + k].spans) for k in range(300)) > 290


def test_toxicity_held_out(spark):
    from sealbook.llm.toxicity import toxicity, without_toxic

    r = random.Random(3)
    plain = [f"word{k}" for k in range(300)]
    bad = ["idiot", "scum", "trash", "moron"]
    rows, truth = [], {}
    for i in range(600):
        text = [r.choice(plain) for _ in range(40)]
        truth[i] = i % 5 == 0
        if truth[i]:
            for _ in range(3):
                text[r.randrange(40)] = r.choice(bad) + r.choice(["", ",", "!"])
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(300)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (None, "nothing here"), (900, None), (901, "")])
    found = {x.doc_id: x for x in toxicity(docs, labels).collect()}
    wrong = sum(found[i].toxic != truth[i] for i in range(300, 600))
    assert wrong <= 3 and not found[None].toxic and not found[900].toxic and not found[901].toxic
    assert all(x.kept != x.toxic for x in found.values())
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in found.items() if x.kept}
    nothing = toxicity(docs, labels.filter("toxic = 7")).collect()
    assert len(nothing) == 603 and not any(x.toxic for x in nothing)


def edit_distance(item, text):
    """Fewest edits between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    from sealbook.llm.decontamination import LEAST_CHARS, contamination, edits, normal, without_contaminated

    r = random.Random(12)
    words = "the a of thing other north ration line ready mind open tower letter small under".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(r.randint(8, 25)).capitalize() + ".") for k in range(8)] + [(20, None), (21, ""), (22, "tiny one"), (None, prose(12))]
    rows = []
    for k in range(60):
        text = list(r.choice([t for _, t in items if t and len(t) > 30]))
        for _ in range(r.randint(0, max(1, int(0.14 * len(text))))):
            p, o = r.randrange(len(text)), r.random()
            text[p : p + (o < 0.7)] = [] if o < 0.35 else [r.choice("abcde ")]
        rows.append((k, prose(r.randint(0, 20)) + "\n" + "".join(text) + " " + prose(r.randint(0, 20)) if k % 4 else prose(50)))
    rows += [(100, None), (101, ""), (None, items[0][1]), rows[1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    expected = Counter()
    for i, t in rows:
        held = []
        for j, item in items:
            if len(n := normal(item)) >= LEAST_CHARS and edit_distance(n, normal(t)) <= edits(len(n)):
                held.append(j)
        expected[i, bool(held), tuple(sorted(held, key=lambda x: (x is None, x or 0)))] += 1
    found = Counter((x.doc_id, x.contaminated, tuple(x.item_ids)) for x in contamination(docs, benchmark).collect())
    assert found == expected
    kept = without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, bad, _), n in expected.items() if not bad)
    assert contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_short_benchmark_items(spark):
    """Items under the edit budget's reach are found word for word, with and without a q-gram of their own."""
    from sealbook.llm.decontamination import contamination

    items = [(1, "Art of war."), (2, "a b c"), (3, "two words"), (4, "one, two, three, go"), (None, "x y z")]
    texts = [(1, "the art of war"), (2, "start of war, art of wars"), (3, "a b c"), (4, "aa b c"), (5, "two words"), (6, "one two three go; x y\nz"),
             (7, "one two three got"), (8, "a b"), (9, ""), (10, None), (None, "art of\nwar a b c")]
    found = {x.doc_id: list(x.item_ids) for x in contamination(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [4, None], 7: [], 8: [], 9: [], 10: [], None: [1, 2]}


def test_html():
    from sealbook.llm.html_text import main_text

    page = """<html><head><title>T</title><script>var a="</p><p>no</p>";</script><style>p{}</style></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies.</p></div>
    <div class="ad">Buy the best of the best and save on it now.</div><!-- <p>hidden</p> -->
    <article><h1>A&nbsp;title &amp; more</h1><p><b>First
       line<br>goes on &lt;here&gt;.<br><p>Second <a href=x>with a link</a> in the middle of the text.</p><p>Short.</p>
    <form><label>Mail</label><input></form><section class="comments"><p>I like the article and it is good for me.</p></section></article>
    <aside><p>More of the same</p></aside><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "A title & more\nFirst line goes on <here>.\nSecond with a link in the middle of the text.\nShort."
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<div class=menu><a href=a>all of it</a></div>") == ""
    long = "This is the long text of the page and it is about the things that are in it. " * 4
    assert main_text(f"<div><p>{long}</p><p>Short one.</p><p>{long}<p>{long}") == "\n".join([long.strip(), "Short one.", long.strip(), long.strip()])
    assert main_text("<article><p>" + "x" * 300_000) == "x" * 300_000


def test_html_rows(spark):
    from sealbook.llm.html_text import extract

    pages = spark.createDataFrame([(1, "u", "<article><p>é text</p></article>", "a", 5), (None, None, None, "b", 6), (1, "u", "<article><p>é text</p></article>", "a", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert result(extract(pages), "page_id", "url", "text", "n_chars") == Counter({(1, "u", "é text", 6): 2, (None, None, "", 0): 1})


def test_empty_tables(spark):
    from sealbook.llm import decontamination, html_text, jaccard, line_dedup, pii, quality, sentencepieces, substring_dedup, toxicity

    docs = table(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vocabulary = sentencepieces.Vocabulary(("<0x00>", "▁"), (0.0, -1.0), (False, True), 0)
    for df in (
        jaccard.near_duplicates(docs), line_dedup.line_dedup(docs), line_dedup.without_repeated_runs(docs), substring_dedup.substring_dedup(docs), quality.quality_rules(docs, labels),
        toxicity.toxicity(docs, labels), toxicity.without_toxic(docs, labels), pii.personal_data(docs), decontamination.contamination(docs, items), html_text.extract(pages), sentencepieces.encode(docs, vocabulary),
    ):
        assert df.collect() == []
