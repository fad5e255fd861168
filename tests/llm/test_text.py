"""Operators on single texts: tokens, rendering, fingerprints, toxicity, lines."""

import hashlib
import random

import numpy as np
import pytest

from netweir.llm import bpe, fingerprint, html, linededup, toxicity
from netweir.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, id string, bucket int"


def docs(spark, *rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(vocabulary_path())


def test_bpe_equals_the_library(codec):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(3)
    letters = "abcdeinorst  ''éüß漢🙂\n\t12.,-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", " ", "\x1c\x1d x", "a" * 500, "it's we'll'd", "x<|endoftext|>y <|endoftext|>", "½²Ⅷ ٣", "the" * 200]
    expected = lib.encode_batch(texts, add_special_tokens=False)
    ids = codec.encode_all(texts)
    assert ids == [e.ids for e in expected]
    assert [codec.decode(i) for i in ids] == [lib.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_bpe_verdicts_are_those_of_merging(codec):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    good = codec.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), good):
        assert (codec.merged(codec.bytes_of[x] + codec.bytes_of[y]) == [x, y]) == g


def test_bpe_long_words_merge_alike(codec):
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abinth") for _ in range(60)).encode()
        assert codec.merged_long(w) == codec.merged(w)


def test_bpe_odd_rows(spark):
    d = docs(spark, (1, None), (2, ""), (3, "hello"), (3, "hello"), (None, "x"))
    out = bpe.encode(d, vocabulary_path())
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 0, 1, 1, 1]
    assert sorted(r["text"] for r in bpe.decode(out, vocabulary_path()).collect()) == ["", "", "hello", "hello", "x"]
    assert bpe.round_trip(d.limit(0), vocabulary_path()).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("a &amp; b", "a & b"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
        ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n          value\nlong name  1"),
        ("<div hidden>x</div><p style='display: none'>y</p><script>var a='</p>'</script>z", "z"),
        ("<pre>\n a\n  b</pre>", "a\n  b".replace("a", " a", 1)),
        ("a<br>b<!-- c --><b>d", "a\nbd"),
        ("<p>x</div></span>y", "xy"),
    ],
)
def test_html_rendering(page, text):
    assert html.extract(page) == text


def test_html_deep_and_odd_pages(spark):
    assert html.extract("<div>" * 5000 + "x") == "x"
    assert html.extract("<table><tr><td>" * 500 + "x").strip() == "x"
    p = spark.createDataFrame([(1, None, "u"), (None, "<p>a", "u"), (1, "<p>a", "u")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in html.visible_text(p).collect()) == ["", "a", "a"]
    assert html.visible_text(p.limit(0)).count() == 0


def test_fingerprint_cuts_shift_with_the_text():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 123, 20000).astype(np.uint8))
    sizes = np.diff([0, *fingerprint.cuts(data)])
    assert sizes.sum() == len(data) and sizes.max() <= fingerprint.MOST and sizes[:-1].min() >= fingerprint.LEAST
    a, b = fingerprint.chunk_set(data.decode()), fingerprint.chunk_set("inserted " + data.decode())
    assert fingerprint.containment(a, b) > 0.98
    assert fingerprint.containment(a, fingerprint.chunk_set("")) == 0 and fingerprint.containment(a[:0], a[:0]) == 1


def test_fingerprint_cuts_equal_a_plain_scan():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(0, 256, 3000).astype(np.uint8))
    out, s = [], 0
    gear = [int(x) for x in fingerprint.GEAR]
    hashes = []
    for i in range(len(data)):
        hashes.append(sum(gear[data[i - k]] << k for k in range(min(fingerprint.WINDOW, i + 1))) & 0xFFFFFFFF)
    while s < len(data):
        e = len(data)
        for i in range(s + fingerprint.LEAST - 1, min(len(data), s + fingerprint.MOST)):
            mask = fingerprint.STRICT if i < s + fingerprint.NORMAL - 1 else fingerprint.LOOSE
            if hashes[i] & int(mask) == 0 or i == s + fingerprint.MOST - 1:
                e = i + 1
                break
        out.append(e)
        s = e
    assert fingerprint.cuts(data) == out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ranges_are_followed_by_the_next_below(spark, block):
    rng = random.Random(block)
    tops = sorted((b, None if b == 0 else b * 10 + 1) for b in {0, *(rng.randrange(60) for _ in range(25))})
    got = {r["bucket"]: r["top"] for r in fingerprint.followers(spark.createDataFrame(tops, "bucket long, own long"), block).collect()}
    assert got == {b: tops[k - 1][1] for k, (b, _) in enumerate(tops)}
    assert fingerprint.followers(spark.createDataFrame([], "bucket long, own long")).count() == 0


def test_edited_copies_follow_the_order(spark):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(40)]
    out = {r["doc_id"]: r for r in fingerprint.edited_copies(docs(spark, *rows)).collect()}
    by = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(by):
        n = by[(k + 1) % len(by)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and out[i]["n_chars"] == len(t)
    assert fingerprint.edited_copies(docs(spark).limit(0)).count() == 0
    odd = fingerprint.edited_copies(docs(spark, (None, "abc"), (1, None), (1, "abcdef"))).collect()
    assert len(odd) == 3
    one = fingerprint.edited_copies(docs(spark, (7, "abcdef"))).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_toxicity_grammar_scores_clauses():
    g = toxicity.Grammar(toxicity.SEEDS)
    kinds = lambda t: {k: w for k, w in g.matches(t).items() if k != "all"}
    assert kinds("You are an idiot.") == {"Id": 1.5}
    assert kinds("You are such an idiot.") == {"Id": 1.75}
    assert kinds("What an idiot. Fine.") == {"Ip": 1.0}
    assert kinds("You are not an idiot.") == {"In": 0.5}
    assert kinds("They said he was a loser. I will kill you!") == {"Ir": 0.5, "Ti": 2.0}
    # intent makes a difference, before or after the target
    assert kinds("Kill you") == {"Td": 1.5} and kinds("I will kill you") == {"Ti": 2.0} and kinds("You must hurt") == {"Ti": 2.0}
    assert kinds("I will not kill you") == {"Tn": 1.0} and kinds("Never in my life would they kill") == {"Td": 1.5}
    # reported speech may come before its verb, if a comma parts them
    assert kinds("You idiot, he said") == {"Ir": 0.5} and kinds("You idiot said nothing") == {"Id": 1.5}
    assert not g.matches("A fine day; nothing else.") and not g.matches("")


def test_toxicity_composition_equals_one_after_another():
    parts = [toxicity.insults(), toxicity.threats(), toxicity.negation(), toxicity.reporting(), toxicity.targeting()]
    whole = toxicity.Grammar(toxicity.SEEDS).machine
    rng = random.Random(8)
    for _ in range(500):
        clause = [rng.choice(toxicity.HEADS), *(rng.choice(toxicity.SYMBOLS[:-1]) for _ in range(rng.randint(0, 12))), "."]
        rows = [(x, 0.0) for x in clause]
        for t in parts:
            state, out = 0, []
            for x, w in rows:
                out += [(y, w + v) for y, v in t.out[state][x]]
                state = t.next[state][x]
            rows = out
        assert whole.run(clause) == rows


def test_toxicity_learns_stems_and_holds_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows, labels = [], []
    for i in range(600):
        t = [word() for _ in range(30)]
        if bad := i % 5 == 0:
            t.insert(10, "zorka" + "pqrst"[i // 5 % 5])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d = docs(spark, *rows, (None, "x"), (9000, None))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab.filter(~toxicity.held_out()))
    assert "zork" in m.lexicon.stems
    s = {r["doc_id"]: r["score"] for r in toxicity.scores(d, m).collect()}
    assert len(s) == 602 and all(0 <= x <= 1 for x in s.values())
    assert all((s[i] >= 0.5) == bool(b) for i, b in labels)
    assert toxicity.without_toxic(d, m).columns == d.columns
    assert toxicity.without_toxic(d, m).count() == 602 - 120
    assert toxicity.fit(d, lab.limit(0)) == toxicity.Model()
    assert toxicity.fit(d.repartition(5), lab.repartition(3).filter(~toxicity.held_out())) == m


LINE = "this line is certainly longer than forty characters, number {}"


def brute_lines(rows, least=40, many=5):
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = linededup.line_key(x, least)
            if k is not None:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        x = (t or "").split("\n")
        out[i] = "\n".join(y for y in x if (k := linededup.line_key(y, least)) is None or len(held[k]) < many or max(held[k]) == i)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["  " + LINE.format(k).upper() + "\t", LINE.format(k), "short", ""]) for k in rng.sample(range(12), 4))) for i in range(40)]
    rows += [(100, None), (101, "")]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, *rows)).collect()}
    expected = brute_lines(rows)
    assert {i: r["text"] for i, r in out.items()} == expected
    assert out[100]["n_lines"] == 1 and sum(r["n_dropped"] for r in out.values()) > 0


def test_lines_can_be_taken_back(spark, tmp_path):
    rows = [(i, LINE.format(i % 3) + "\nown line") for i in range(18)]
    d = docs(spark, *rows)
    index = linededup.LineIndex(spark).insert(d)
    text = lambda ix, x: {r["doc_id"]: r["text"] for r in ix.apply(x).collect()}
    more = docs(spark, *((i, LINE.format(7) + "\n" + LINE.format(0)) for i in range(50, 56)))
    bigger = index.insert(more)
    assert text(bigger, d.union(more)) == brute_lines(rows + [(r["doc_id"], r["text"]) for r in more.collect()])
    back = bigger.delete(more)
    assert text(back, d) == text(index, d) == brute_lines(rows)
    fewer = index.delete(docs(spark, *((i, "") for i in range(0, 9))))
    assert text(fewer, d.filter("doc_id >= 9")) == brute_lines(rows[9:])
    back.save(f"{tmp_path}/ix")
    assert text(linededup.LineIndex.load(spark, f"{tmp_path}/ix", back.shards), d) == brute_lines(rows)


def test_changes_of_lines_write_touched_shards_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    monkeypatch.setattr(linededup, "LAYERS", 3)
    held = {i: [LINE.format(k) for k in range(i % 4, 40, 4)] for i in range(40)}
    rows = lambda: [(i, "\n".join(x)) for i, x in held.items()]
    text = lambda ix: {r["doc_id"]: r["text"] for r in ix.apply(docs(spark, *rows())).collect()}
    index = linededup.LineIndex(spark).insert(docs(spark, *rows()))
    assert index.shards == 10 and index.keys == 40 and text(index) == brute_lines(rows())
    index.save(f"{tmp_path}/ix")
    index = linededup.LineIndex.load(spark, f"{tmp_path}/ix", index.shards)
    written = []
    kept = linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df: written.append(kept(df)) or written[-1])
    for step in range(2):  # an insertion and a deletion, then an insertion that writes all as one
        new = {100 + 10 * step + i: [LINE.format(step), LINE.format(900 + step)] for i in range(6)}
        gone = {} if step % 2 else {i: held.pop(i) for i in list(held)[:3]}
        touched = {linededup.digest(linededup.line_key(x, 40))[0] % index.shards for v in (*new.values(), *gone.values()) for x in v}
        written.clear()
        held.update(new)
        index = index.insert(docs(spark, *((i, "\n".join(x)) for i, x in new.items())))
        if gone:
            index = index.delete(docs(spark, *((i, "") for i in gone)))
        assert step or {r["shard"] for t in written for r in t.select("shard").collect()} <= touched
        assert text(index) == brute_lines(rows()) and index.keys == index.counts.count()
        assert index.insert(docs(spark, (100, LINE.format(0)))) is index and index.delete(docs(spark, (-1, ""))) is index
    assert index.shards == 10 and index.filters.count() <= 10
    index = index.insert(docs(spark, *((500 + i, "\n".join(LINE.format(2000 + k) for k in range(60))) for i in range(5))))
    held.update({500 + i: [LINE.format(2000 + k) for k in range(60)] for i in range(5)})
    assert index.shards > 10 and text(index) == brute_lines(rows())
    assert linededup.LineIndex(spark).delete(docs(spark, (1, ""))).refs is None


def test_lines_odd_rows(spark):
    d = docs(spark, *((1, LINE) for _ in range(9)), (None, LINE), (2, "x"))
    assert all(r["n_dropped"] == 0 for r in linededup.dedup_lines(d).collect())
    assert linededup.dedup_lines(d.limit(0)).count() == 0
    assert linededup.dedup_lines(d, keep=("id", "bucket")).columns == ["doc_id", "text", "n_lines", "n_dropped", "id", "bucket"]


def test_cuckoo_filter_deletes_what_was_inserted():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    c = linededup.Cuckoo.of(h)
    assert c.contains(h).all() and linededup.Cuckoo.load(c.dump()).contains(h).all()
    for f, i, j in zip(*(x.tolist() for x in c.places(h[:2500]))):
        assert c.delete(f, i, j)
    assert c.contains(h[2500:]).all() and c.contains(h[:2500]).mean() < 0.01


def test_html_text_that_browsers_show():
    from netweir.llm.html import DEEPEST, extract

    # a head without an end tag ends at the body, or at the first text or element that can't be in it
    assert extract("<head><title>T</title><body>Hello <b>you</b>") == "Hello you"
    assert extract("<head><title>T</title>Hello<p>you") == "Hello\n\nyou"
    assert extract("<head><meta charset=x> <link href=y></head><body>a") == "a"
    assert extract("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> it") == "so x=1 it"
    assert extract("<svg><title>t</title><defs/><defs><text>no</text></defs><text>one</text><path d='M0'/><text>two</text></svg>") == "one two"
    assert extract("<select><option>red<option value=2>green</select>") == "red\ngreen"
    assert extract("<p>a <span aria-hidden='true'>b</span> c") == "a b c"
    assert extract("<p>a <span hidden>b</span> c") == "a c"
    # beyond the depth limit hidden text stays hidden, and what stands around it is shown in its order
    deep = "<div>" * (DEEPEST + 9)
    for inner in ("<div style='display:none'><div>no</div>no<b>no</b></div>", "<p hidden>no", "<span hidden><div>no</div></span>"):
        assert extract(f"{deep}<p>a</p>{inner}<div>b <i>c</i> d</div></div>e").split() == ["a", "b", "c", "d", "e"]
    assert extract("<div hidden>" + deep + "no" + "</div>" * (DEEPEST + 9) + "no</div>yes") == "yes"


def test_html_text_is_not_lost():
    from netweir.llm.html import extract

    assert extract("İ" * 10 + "<script>var a=1;</script>hello world, this is text") == "İ" * 10 + "hello world, this is text"
    assert extract("a<script>if (x </scripty> y) z</SCRIPT >b") == "ab"
    assert extract("<tr><td>a<td>b<tr><td>c") == "a b\nc"
    assert extract("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p><b>no</b></div>") == "yes"
    assert extract("<div hidden>no<p style='visibility: visible'>no</p></div>z") == "z"
    assert extract('<p>x<a title="foo>y</a> z') == "xy z"
    assert extract("<input type=submit value='Send'><input value=no>") == "Send"
    assert extract("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g</table>") == "a  b   c\n   dd  e\nf  g"


def random_tree(rng, depth=0):
    """(HTML, visible words in order) of a random page whose tags are all closed."""
    if depth > 4 or rng.random() < 0.25:
        w = "".join(rng.choice("abcdefgh") for _ in range(5))
        return w + " ", [w]
    tag = rng.choice(["p", "div", "span", "b", "ul", "ol", "section", "blockquote", "article", "em"])
    inside = [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]
    if tag == "p":  # a p can hold no block
        inside = [random_tree(rng, 5) for _ in inside]
    if tag in ("ul", "ol"):
        inside = [(f"<li>{h}</li>", w) for h, w in inside]
    hide = rng.choice(["", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'"])
    return f"<{tag}{hide}>" + "".join(h for h, _ in inside) + f"</{tag}>", (hide, [w for _, w in inside])


def shown(words, veiled=False):
    if isinstance(words, list):
        return [x for w in words for x in (shown(w, veiled) if not isinstance(w, str) else [] if veiled else [w])]
    hide, inside = words
    if "hidden" == hide.strip() or "none" in hide:
        return []
    veiled = "visibility:hidden" in hide or veiled and "visible" not in hide
    return [x for w in inside for x in shown(w, veiled)]


def test_html_random_trees_give_all_their_words():
    from netweir.llm.html import extract

    rng = random.Random(12)
    for _ in range(400):
        page, words = "", []
        for _ in range(3):
            h, w = random_tree(rng)
            page, words = page + h, words + [w]
        got = [x for x in extract(page).replace("- ", " ").split() if not x.rstrip(".").isdigit()]
        assert got == [x for w in words for x in shown(w)], page


@pytest.mark.parametrize(
    "page,text",
    [
        ("<!-->vis", "vis"),
        ("<!--->vis", "vis"),
        ("a<!-- x --!>b<!-- > -- c -->d<!-- no end", "abd"),
        ("<pre><div>a</div><div>b</div></pre>", "a\nb"),
        ("<pre>x<img alt='pic'>y</pre>", "x pic y"),
        ("<pre>a<br><br>b   c\r\nd</pre>", "a\n\nb   c\nd"),
        ("<pre>k<ul><li>a<li>b  c</ul></pre>", "k\n\n- a\n- b  c"),
        ("<pre><tr><td>a<td>b<tr><td>c</pre>", "a b\nc"),
        ("<pre><table><tr><td>a  b<td>c<tr><td>d<td>e</table></pre>", "a  b  c\nd     e"),
        ("x<pre>a\n<div>b</div>\nc</pre>y", "x\n\na\nb\n\nc\n\ny"),
        ("<pre>a<span hidden>n</span> <b style='visibility:hidden'>n</b> b</pre>", "a  b"),
        ("<object>fallback</object><object data=x>no</object>", "fallback"),
        ("<p style=\"background:url('a;display:none')\">a", "a"),
        ("<p style='background:url(a;display:none)'>a", "a"),
        ("<p style='/* display:none */'>a", "a"),
        ("<p style='display:none;display:block'>a", "a"),
        ("<p style='DISPLAY : none !important;display:block'>a</p>b", "b"),
        ("<p style='visibility:hidden;content:\"visibility:visible\"'>a</p>b", "b"),
    ],
)
def test_html_comments_kept_blanks_and_styles(page, text):
    assert html.extract(page) == text


def loose_page(rng, depth=0, block=True):
    """(HTML, visible words in order) of random tags of which many are not closed, with comments, tables and kept blanks."""
    word = "".join(rng.choice("abcdefgh") for _ in range(5))
    kind = rng.choice(["word", "word", "comment", "p", "list", "table", "pre", "object", "gone", "seen", "inline"]) if depth < 4 else "word"
    if kind == "comment":
        return rng.choice(["<!-->", "<!--->", "<!-- no -->", "<!-- no --!>", "<!---->", "<!no>", "<?no>"]) + word + " ", [word]
    if kind == "word" or not block and kind in ("p", "list", "table", "pre"):
        return word + " ", [word]
    inside = [loose_page(rng, depth + 1, block and kind not in ("p", "inline")) for _ in range(rng.randint(1, 3))]
    text, words = "".join(h for h, _ in inside), [w for _, ws in inside for w in ws]
    if kind == "p":
        return "<p>" + text, words
    if kind == "list":
        return "<ul>" + "".join("<li>" + h for h, _ in inside) + "</ul>", words
    if kind == "table":  # cells of one word, so that rows read in order
        cells = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(1, 3))] for _ in range(3)]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{w}<!-- no -->" for w in row) for row in cells) + "</table>", [w for row in cells for w in row]
    if kind == "pre":
        return f"<pre>{rng.choice(['', chr(10), '  '])}{text}\n {word}</pre>", [*words, word]
    if kind == "object":
        return f"<object>{text}</object>", words
    if kind == "gone":
        return rng.choice(["<div hidden>", "<div style='color:red;display:none'>"]) + "no</div>" if block else "<b hidden>no</b>", []
    if kind == "seen":
        return f"<b style='background:url(x;display:none)'>{word}</b> ", [word]
    return f"<em>{text}</em>", words


def test_html_random_loose_pages_give_all_their_words():
    rng = random.Random(5)
    for _ in range(1500):
        found = [loose_page(rng) for _ in range(4)]
        page, words = "".join(h for h, _ in found), [w for _, ws in found for w in ws]
        got = [x for x in html.extract(page).split() if x != "-"]
        assert got == words, page


def test_html_very_long_pages(spark):
    n = 150_000
    page = "<!--><pre>" + "a  b\n" * n + "</pre><p>" + "word " * n + "<table>" + "<tr><td>x<td>y" * 20_000 + "</table><p style='" + "(x" * n + "'>end"
    p = spark.createDataFrame([(1, page), (2, page[10:])], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in html.visible_text(p).collect()}
    assert out[1].split() == ["a", "b"] * n + ["word"] * n + ["x", "y"] * 20_000 + ["end"]
    assert out[2].split() == out[1].split()


def test_long_texts_and_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.random()) for _ in range(60_000))  # over a million characters
    rows = [(7, long), (3, None), (9, ""), (1, "end of it all"), (4, long[5:])]
    out = {r["doc_id"]: r for r in fingerprint.edited_copies(docs(spark, *rows)).collect()}
    by = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(by):
        n = by[(k + 1) % len(by)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        sets = [{(hashlib.md5(d[a:b]).digest(), b - a) for a, b in zip([0, *ends], ends)} for d in (t.encode(), e.encode(), n.encode()) for ends in [fingerprint.cuts(d) if d else []]]
        like = lambda a, b: sum(x for _, x in a & b) / sum(x for _, x in a) if a and b else float(not a and not b)
        assert out[i]["near_edited"] == pytest.approx(like(sets[0], sets[1])) and out[i]["near_next"] == pytest.approx(like(sets[0], sets[2]))
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    assert out[7]["near_next"] > 0.99 or out[4]["near_next"] < 0.01
    lines = linededup.dedup_lines(docs(spark, *rows)).count()
    assert lines == 5 and bpe.round_trip(docs(spark, *rows), vocabulary_path()).filter("n_tokens > 500000").count() == 2
    assert toxicity.scores(docs(spark, *rows), toxicity.Model()).count() == 5
