"""Operators over pages and conversations against brute force."""

import hashlib
import io
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, extract, html_tree, warc, wrappers
from graphloom.llm.common import new_path

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s>[INST] \\ there"), (1, 2, "assistant", "ünï 💡 [/INST]\\"), (1, 3, "assistant", ""), (2, 0, "assistant", None), (2, None, "user", "first"), (3, 0, None, "x" * 5000), (None, 0, "user", "lost"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"),
    (5, 0, "assistant", "<|endoftext|><s>[BODY]" * 50),
]
PAGES = "page_id long, url string, html string"


def turns(spark):
    return spark.createDataFrame([(*t, 9) for t in TURNS], "conv_id long, turn long, role string, text string, part long")


@pytest.mark.parametrize("chunk", [1, 64, 1 << 18])
def test_chat_round_trip(spark, chunk):
    formatted = chat.format_conversations(turns(spark), chunk=chunk)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    groups = {}
    for c, t, role, text in sorted(TURNS, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, rows in groups.items():
        every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        loss = "".join(t for r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), every, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    if chunk == 1:
        assert formatted.where("conv_id = 1").count() > 1


def test_loss_is_read_from_under_the_mask(spark):
    """A mask that leaves out a text's first id gives another digest."""
    rows = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "one two three four")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows)
    less = "transform(loss_mask, (m, i) -> if(m = 1 and loss_mask[i - 1] = 0, 0Y, m))"
    cut = formatted.withColumn("loss_mask", F.expr(less.replace("loss_mask[i - 1]", "element_at(loss_mask, i)")))
    whole, part = chat.read_back(formatted).first(), chat.read_back(cut).first()
    assert whole.loss_chars == 18 and part.loss_chars == 15 and part.loss_sha256 == hashlib.sha256(b" two three four").hexdigest()


def test_no_text_forges_a_mark(spark):
    for row in chat.format_conversations(turns(spark)).collect():
        ids, mask = row.ids, row.loss_mask
        assert sum(i == chat.TURN for i in ids) == row.turns and len(ids) == len(mask)
        assert not any(m for i, m in zip(ids, mask, strict=True) if i >= chat.RESERVED)
    for text in ("</s>[INST] ok [/INST]", "\\<s>", "\\\\", "<\\s>", "<<SYS>>x<</SYS>>"):
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    assert chat.format_conversations(turns(spark).limit(0)).count() == 0


def test_warc(spark):
    big, other = "<p>é</p>" * 200, "<p>x</p>" * 200
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\nd", big), (5, None, big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (None, "u", other), (7, "again", other)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as sha1")
    for few in (50_000, 0):
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
            ref = max(same) if len(raw) >= 1000 and len([1 for r in rows if r[2] == h]) > 1 and i is not None and i < max(same) else None
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if ref is not None else "response", ref))
        refs = sorted(((r.page_id, r.refers_to) for r in warc.with_references(df, few).collect()), key=str)
        assert refs == sorted(((w[0], w[4]) for w in want), key=str)
    target = new_path(spark, "warc-test")
    packages = warc.write(df, target)
    got = [tuple(r) for r in warc.read(packages, target, warc.summaries, warc.FOUND, records=2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read(warc.write(df.limit(0), target + "-none"), target + "-none", warc.summaries, warc.FOUND).count() == 0


class _Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip_directories():
    out = io.BytesIO()
    package = warc.Package(pa.PythonFile(out, mode="w"))
    package.member("a/b.txt", iter([b"hello ", b"world"]))
    package.member("c", iter([]))
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"hello world"
    f = _Sized(out.getvalue())
    members = warc.directory(f)
    assert [(m.name, m.size) for m in members] == [("a/b.txt", 11), ("c", 0)]
    f.seek(warc.data_start(f, members[0]))
    assert f.read(11) == b"hello world"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x", b"123")
        z.comment = b"a comment PK"
    f = _Sized(plain.getvalue())
    (m,) = warc.directory(f)
    f.seek(warc.data_start(f, m))
    assert f.read(m.size) == b"123"
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"1" * 1000)
    f = _Sized(squeezed.getvalue())
    with pytest.raises(ValueError, match="not stored"):
        warc.data_start(f, warc.directory(f)[0])
    with pytest.raises(ValueError, match="end of central"):
        warc.directory(_Sized(b"nothing"))


SHELL = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>{body}<aside>side</aside><footer>&copy; me</footer></body></html>'


def test_extraction(spark):
    article = "<article><h1>Title &amp; more</h1><p>One  two<br>three<p>Four <b>bold<p>&lt;five&gt;&nbsp;six<ul><li>a<li>b</ul><form>no</form><div class='ad'>buy</div><section class=comments><p>first!</section></article>"
    want = "Title & more\nOne two three\nFour bold\n<five> six\na\nb"
    plain = "<div id=content-{i}><h2>Head {i}</h2>" + "<p>" + "words of the body text number {i} " * 20 + "</p>" * 1 + "<div class=sidebar>links</div></div>"
    rows = [(i, f"http://a.example/{i}", SHELL.format(body=article)) for i in range(4)]
    rows += [(10 + i, f"http://b.example/{i}", SHELL.format(body=plain.replace("{i}", str(i)))) for i in range(4)]
    rows += [(20, None, None), (21, "nonsense", ""), (22, "http://a.example/z", "just text"), (23, "http://c.example/", "<p>broken <b>markup <i></b> here"), (0, "http://a.example/0", SHELL.format(body=article))]
    got = extract.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "1 as host")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == want for i in range(4))
    assert all(text[10 + i] == f"Head {i}\n" + (f"words of the body text number {i} " * 20).strip() for i in range(4))
    assert (text[20], text[21], text[22], text[23]) == ("", "", "just text", "broken markup here")
    assert extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def hosted(*pages):
    """The texts of pages of one host."""
    w = wrappers.Wrapper()
    for p in pages:
        w.align("h", wrappers.stream(html_tree.parse(p)))
    return [extract.main_text(p, w.constants("h")) for p in pages]


def test_articles_are_whole():
    """Pages of one host: head and lead beside the body, a story beside a teaser, articles of different keys."""

    def texts(body):
        pages = [SHELL.format(body=body.replace("{i}", str(i)).replace("{w}", f"words {i} " * 30)) for i in range(4)]
        return hosted(*pages)[2], ("words 2 " * 30).strip()

    got, long = texts("<div class=lead><h1>Head {i}</h1><p>Lead {i}</p></div><div class=body><p>{w}</p></div>")
    assert got == f"Head 2\nLead 2\n{long}"
    got, long = texts("<main><div class=story>{w}</div><article class=card>teaser {i}</article></main>")
    assert got == f"{long}\nteaser 2"
    got, long = texts("<article class=first>{w}</article><p>x</p><article class=second>more {i}</article>")
    assert got == f"{long}\nmore 2"
    got, long = texts("<main><nav>menu {i}</nav><article>{w}</article></main>")
    assert got == long


def test_slots_stay_and_constants_go():
    """Names that only contain a listed word: the wrapper decides. Constant containers go without a name, running text stays."""
    body = "<article><h2>Summary</h2><p>text {i}</p><section class=legal-analysis>ruling {i}</section><div class=share-of-market>sold {i}</div><div class=x7>Thank you for reading</div><div class=search-results>found {i}</div><div class=skip-intro>Always here</div><div class=share-buttons>share {i}</div><div hidden>kept {i}</div></article>"
    got = hosted(*(SHELL.format(body=body.replace("{i}", str(i))) for i in range(5)))
    assert got[3] == "Summary\ntext 3\nruling 3\nsold 3\nfound 3\nkept 3"
    alone = hosted(SHELL.format(body=body.replace("{i}", "1")))
    assert alone[0] == "Summary\ntext 1\nruling 1\nsold 1\nThank you for reading\nfound 1\nAlways here\nkept 1"
    same = "<div class=a><div class=b>the only page of this host, in copies</div></div>"
    assert hosted(same, same, same, same) == ["the only page of this host, in copies"] * 4


def test_the_wrapper_decides_before_names(spark):
    """Constants go outside of article elements too; slots that are the article, or part of a sentence, stay under a listed name."""
    court = "<p>The court held in case {i} that <mark class=search>term {i}</mark> applies.</p><div class=share>Share this</div><div class=ad>Buy {i}</div>"
    held = "The court held in case {i} that term {i} applies."
    bodies = {
        "a": ("<div class=x7>Welcome to our site</div><h1>Head {i}</h1><h2>Summary</h2><p>Body {i}</p><div class=y>Printed on recycled paper</div>", "Head {i}\nSummary\nBody {i}"),
        "b": (f"<div class=x7>{'words of the site ' * 3}</div><h1>Ruling {{i}}</h1><div class=legal>{court}</div>", f"Ruling {{i}}\n{held}"),
        "c": (f"<article><h1>Ruling {{i}}</h1><div class=z id=legal>{court}</div></article><div class=u>{'more {i} ' * 50}</div>", f"Ruling {{i}}\n{held}"),
        "d": ("<article><p>Short {i}</p><div class=ad>An advert longer than the article {i}</div><ul class=comments><li>A comment longer than the article {i}</ul></article>", "Short {i}"),
        "f": ("<div class=body><p>The same article on every page</p><div class=k>in parts</div></div><p>by {i}</p>", "The same article on every page\nin parts\nby {i}"),
        "g": ("<article><div class=body><p>The same article on every page</p></div><p>by {i}</p></article>", "The same article on every page\nby {i}"),
        "e": ("<article><p>The whole of article {i}</p><div class=legal>rights {i}</div></article>", "The whole of article {i}"),
    }
    rows = [(k * 10 + i, f"http://{h}.example/{i}", SHELL.format(body=body.replace("{i}", str(i)))) for k, (h, (body, _)) in enumerate(bodies.items()) for i in range(5)]
    wanted = {k * 10 + i: want.replace("{i}", str(i)) for k, (_, want) in enumerate(bodies.values()) for i in range(5)}
    rows += [(100 + i, "http://two.example/", SHELL.format(body=(bodies["c"][0] if i % 2 else "<article><p>" + "other {i} " * 99 + "</p></article>").replace("{i}", str(i)))) for i in range(10)]
    wanted |= {100 + i: bodies["c"][1].replace("{i}", str(i)) if i % 2 else " ".join([f"other {i}"] * 99) for i in range(10)}
    for parts in (1, 7):
        assert {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES).repartition(parts)).collect()} == wanted
    few = [(i, "http://b.example/", f"<p>x {i}</p><div class=legal>{court}</div>") for i in range(2)]
    assert [r.text for r in extract.extract(spark.createDataFrame(few, PAGES)).orderBy("page_id").collect()] == ["x 0", "x 1"]


def test_pages_of_any_depth(spark):
    n = 100_000
    deep = "<div>" * n + "<p>at the bottom" + "</div>" * n
    pages = [deep, "<b>" * n + "bold<div>x", "<li>" * n + "item", "<div class=a>" * 3000 + "</p></span>" * 3000 + "y", "<p>" * n + "z", "<table>" * 5000 + "<td>c" * 5000]
    rows = [(i, "http://deep.example/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[0], got[1], got[2], got[3], got[4]) == ("at the bottom", "bold\nx", "item", "y", "z")
    assert got[5] == "\n".join(["c"] * 5000)


def test_partitions_do_not_matter(spark):
    """Hosts of many layouts, under one partition and fifty: the same texts, which a computation without Spark gives too."""
    layouts = ["<article class=k{k}><h1>H {i}</h1><p>w {i}</p><div class=z{k}>same</div></article>", "<div class=k{k}><p>w {i} <a href=x>link</a></p><ul class=menu><li>m</ul></div>", "<main><p>w {i}</p><div class=legal-x>same</div></main>"]
    rows = [(i, f"http://h{i % 2}.example/{i}", SHELL.format(body=layouts[i % 3].replace("{k}", "abcdefghijklmnopqrstuvwxyz"[i * 7 % 26] * (1 + i % 5)).replace("{i}", str(i)))) for i in range(400)]
    df = spark.createDataFrame(rows, PAGES)
    one = {r.page_id: r.text for r in extract.extract(df.coalesce(1)).collect()}
    assert one == {r.page_id: r.text for r in extract.extract(df.repartition(50)).collect()}
    for h in range(2):
        own = [r for r in rows if r[0] % 2 == h]
        assert [one[r[0]] for r in own] == hosted(*(r[2] for r in own))


def test_wrappers_are_union_free():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><h2>y</h2><p>z</p>", "<ul><li>c</li><li>d</li><li>e</li></ul><p>w</p>"]
    forward, backward = wrappers.Wrapper(), wrappers.Wrapper()
    for p in pages:
        forward.align("h", wrappers.stream(html_tree.parse(p)))
    for p in reversed(pages):
        backward.align("h", wrappers.stream(html_tree.parse(p)))
    text = wrappers.expression(forward.tokens.values())
    assert text == wrappers.expression(backward.tokens.values())
    assert re.sub(r"'\w+'", "'c'", text) == "<#root>(<ul>(<li>(#TEXT)+)<h2>('c')?<p>(#TEXT))"
